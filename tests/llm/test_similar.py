from collections import Counter

import numpy as np

from gaugewright.llm import similar
from gaugewright.llm.common import spaced_words


def sets_of(rows):
    out = []
    for _, text in rows:
        w = spaced_words(text)
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and same and 100 * same >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least[find(i)] if k is not None else None) for i, (k, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted([tuple(r) for r in similar.join(df).collect()], key=repr)


def chains():
    """Documents of which each is linked with the next only, and clusters about a common passage."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 100])) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(80))
    rows += [(100 + i, passage + " " + " ".join(f"r{i}_{j}" for j in range(n))) for i, n in enumerate([0, 3, 6, 9, 12, 14, 16, 18, 22, 30] * 4)]
    return rows


def test_like_brute_force(spark, awkward, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward) == brute(rows)
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(df) == want
    # Everything is frequent, and groups are opened a slice at a time.
    monkeypatch.setattr(similar, "SAMPLED", 1)
    monkeypatch.setattr(similar, "SLICE", 2)
    assert found(df) == want


def test_one_of_each(awkward, clashing, none):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    kept = similar.one_of_each(clashing)
    assert kept.columns == clashing.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    want = {k for k, _, c in brute(rows) if k is not None and k == c}
    assert {k for k in got if k is not None} == want and got[None] == 2 and all(n == 1 for k, n in got.items() if k is not None)
    assert similar.one_of_each(none).count() == 0 and found(none) == []


def test_components(spark):
    rng = np.random.default_rng(0)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], rng.integers(0, 60, (40, 2)).tolist()):
        got = {r["c"]: r["root"] for r in similar.components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")).collect()}
        want = {x: x for e in edges for x in e}
        for _ in range(100):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert got == {k: v for k, v in want.items() if k != v}


def test_prefixes_move_once(spark, monkeypatch):
    """Joins of pairs with their classes move the pairs, not the prefixes of all classes."""
    asked = []
    linked = similar.linked
    monkeypatch.setattr(similar, "linked", lambda pairs, classes, *rest: asked.append((pairs, classes)) or linked(pairs, classes, *rest))
    rows = chains()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = similar.materialize(asked[0][0])
        plan = similar.may_link(pairs, asked[0][1])._jdf.queryExecution().sparkPlan().toString()
        moved = similar.may_link(pairs, asked[0][1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 2 and moved.count("Exchange hashpartitioning") == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gaugewright_")]
