import math

import numpy as np

from gaugewright.llm import nearest

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in asked:
            s = sorted((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w in good if i != q)
            out[q] = s[:k]
    return out


def awkward_vectors(n=400):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, [1.0] * 5),
             (2006, []), (None, rows[0][1]), (2008, [1e-30] * 8), (2009, [3e30] * 8)]
    return rows


def test_exact_when_every_cell_is_visited(spark):
    rows = awkward_vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    asked = df.filter("vec_id % 50 = 0 or vec_id in (3, 1007, 2008)")
    want = brute(rows, {r["vec_id"] for r in asked.collect()}, 5)
    got = {}
    for r in nearest.search(df, asked, share=1.0, chunk=64, block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, s in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        # Equal up to rounding; copies of one vector are tied exactly, so the smaller ids come first.
        assert np.allclose([x for _, _, x in own], [-x for x, _ in s], atol=1e-9)
        if q == 1007:
            assert [i for _, i, _ in own] == [3, 1000, 1001, 1002, 1003]


def test_recall(spark):
    rows = [(i, v) for i, v in awkward_vectors(3000) if i is not None and i < 3000 and v and len(v) == 8 and v[0] is not None and i < 2000 or (i or 0) >= 2010]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS)
    asked = df.filter("vec_id % 50 = 0")
    want = brute(rows, {r["vec_id"] for r in asked.collect()}, 5)
    got = {(r["query_id"], r["vec_id"]) for r in nearest.search(df, asked).collect()}
    assert sum((q, i) in got for q, s in want.items() for _, i in s) >= 0.9 * sum(map(len, want.values()))


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (50, [1.0, 1.0], 0), (2, [0.0, 1.0], 0)], ROWS)
    got = [tuple(r)[:3] for r in nearest.search(df, df.filter("vec_id = 50")).collect()]
    assert sorted(got) == [(50, 1, 1), (50, 2, 2)]
    assert nearest.search(df.limit(0), df).count() == 0 and nearest.search(df, df.limit(0)).count() == 0
    assert nearest.search(df.filter("vec_id = 1"), df.filter("vec_id = 1")).count() == 0
    clashing = df.selectExpr("*", "1 as cell", "2 as bits", "3 as query_id", "4 as rank")
    assert nearest.search(clashing, clashing.filter("vec_id = 50")).count() == 2
