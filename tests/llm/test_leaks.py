import hashlib
import random

from conftest import prose

from gaugewright.llm import leaks
from gaugewright.llm.common import letter_words


def brute(docs, items, width=10):
    windows = {}
    for key, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + width]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = letter_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (keys := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= keys
        ids = sorted(str(k) for k in found if k is not None)
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_of(awkward):
    rng = random.Random(9)
    texts = [r["text"] for r in awkward.collect()]
    cut = lambda i, a, n: " ".join((texts[i] or "").split()[a : a + n]).upper()
    return [
        (1, cut(0, 3, 12)), (2, cut(1, 0, 25) + " unseen words"), (3, cut(0, 3, 12)), (10, "one"), (None, cut(2, 1, 11)), (4, None), (5, ""),
        (6, prose(rng, 30)), (7, "spam spam"), (8, "never met " + cut(5, 2, 14) + " never " + cut(6, 1, 10)),
    ]


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=repr)


def test_like_brute_force(spark, awkward):
    items = items_of(awkward)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in awkward.collect()], items)
    assert found(leaks.overlaps(awkward, bench)) == want
    # Tiny shards and blocks of items give the same.
    assert found(leaks.overlaps(awkward.repartition(3), bench, shard=50, block=100)) == want


def test_longest_matches(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, f"x y {text} z"), (2, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", f"q {text} r")], "item_id string, text string")
    rows = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in leaks.overlaps(docs, bench, width=4, places=True).collect()}
    assert rows == {1: [("a", 1, 2, 8)], 2: [("a", 1, 0, 8)]}


def test_clean_and_empty(spark, awkward, clashing, none):
    bench = spark.createDataFrame(items_of(awkward), "item_id long, text string")
    kept = leaks.clean(clashing, bench)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(not r[-1] for r in found(leaks.overlaps(awkward, bench)))
    assert leaks.clean(none, bench).count() == 0
    assert leaks.clean(awkward, bench.limit(0)).count() == awkward.count()
    marked = leaks.overlaps(clashing, bench)
    assert marked.columns.count("n_words") == 1 and marked.first()["score"] == "kept"
