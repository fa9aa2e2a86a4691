import random

from gaugewright.llm import lines


def distance_at_most_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words(line):
    import re

    return tuple(x for x in re.split(r"[ \t\x0B\f\r]+", line) if x)


def brute(rows, least=8):
    """rows: (doc_id, text), ids distinct and not null; the texts that stay."""
    every = [(k, i, words(x)) for k, t in sorted(rows) for i, x in enumerate((t or "").split("\n"))]
    first = {}
    for k, i, w in every:
        if w:
            first.setdefault(w, (k, i))
    order = list(first)
    gone = set()
    for n, w in enumerate(order):
        if len(w) >= least and any(len(v) >= least and distance_at_most_one(v, w) for v in order[:n]):
            gone.add(w)
    out = {}
    for k, t in rows:
        own = (t or "").split("\n")
        stays = [x for i, x in enumerate(own) if not words(x) or (first[words(x)] == (k, i) and words(x) not in gone)]
        out[k] = (len(own), len(own) - len(stays), "\n".join(stays), bool(own != stays and not any(map(words, stays))))
    return out


def test_like_brute_force(awkward):
    few = awkward.filter("doc_id is not null and doc_id > 1").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in few.collect()]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"] or "", r["gone"]) for r in lines.dedupe(few).collect()}
    assert got == brute(rows)


def test_edits_of_one_word(spark):
    base = "one two three four five six seven eight nine ten"
    w = base.split()
    texts = [base, base.replace("five", "5"), " ".join(w[:-1]), " ".join(w[1:]), base + " eleven", "zero " + base, " ".join(w[:4] + ["x"] + w[4:]),
             " ".join(w[:2] + w[4:]), " ".join([w[1], w[0]] + w[2:]), "a b c d", "a b c e", "a b c d", base.upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"], r["gone"]) for r in lines.dedupe(df).collect()}
    assert got == brute(rows)
    assert got[1][3] and got[6][3] and got[11][3] and not got[10][3] and not got[12][3]


def test_whole_table(awkward, clashing, none):
    out = lines.dedupe(clashing)
    assert out.count() == awkward.count() and out.columns.count("gone") == 1 and out.first()["score"] == "kept"
    same = [(r["text"], r["gone"]) for r in out.filter("doc_id = 0").collect()]
    assert len(set(same)) == 1  # repeated rows share one fate
    assert out.filter("n_chars is null").first()["text"] is None
    assert lines.dedupe(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_edits(rows, per, least=8):
    """The distinct lines that go, all lines with `least` words or more."""
    order = list(dict.fromkeys(words(x) for _, t in sorted(rows) for x in t.split("\n") if words(x)))
    gone = set()
    for n, w in enumerate(order):
        for v in order[:n]:
            k = max(1, min(len(v), len(w)) // per)
            if min(len(v), len(w)) >= least and abs(len(v) - len(w)) <= k and distance(v, w) <= k:
                gone.add(w)
                break
    return order, gone


def test_edits_grow_with_the_line(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        n = rng.choice([9, 23, 24, 25, 28, 36, 47, 90, 111, 149])
        base = [f"é{rng.randrange(3000)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for extra in (0, 0, 1, 1):  # at the bound and one beyond
            w = list(base)
            for _ in range(max(1, n // 12) + extra):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 1)] = [f"new{rng.randrange(10**6)}"] if kind else []
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [(1000 + i, " ".join(f"q{i}_{j}" for j in range(14)) + " " + passage) for i in range(10)]  # a common passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order, gone = brute_edits(rows, 12)
    assert len(gone) > len({k for k, v in brute(rows).items() if v[3]}) + 20  # more than one word apart
    got = {r["doc_id"] for r in lines.dedupe(df, per=12).filter("gone").collect()}
    assert got == {k for k, t in rows if words(t) in gone} and not got & set(range(1000, 1010))
    assert lines.dedupe(df.limit(0), per=12).count() == 0
