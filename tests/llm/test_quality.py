import random

import numpy as np
from conftest import prose

from gaugewright.llm import quality


def labelled(spark, n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(rng, rng.randrange(5, 200))
        rows.append((i, text if good else rng.choice([text.upper().replace(" ", "!! "), " ".join([w for w in text.split()[:12] for _ in range(9)])])))
        labels.append((i, int(good)))
    labels += [(n + 1, 1), (0, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs.filter("doc_id % 2 = 0"), labels)
    rows = quality.score(docs.filter("doc_id % 2 = 1"), model).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in rows]
    assert np.mean(right) >= 0.97


def test_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair decides
    model = quality.boost(x, y)
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    one = model.intercept + sum(t[np.searchsorted(e, x[0, j], side="right")] for j, (t, e) in enumerate(zip(model.tables, model.edges, strict=True)))
    one += sum(t[np.searchsorted(model.coarse[a], x[0, a], side="right"), np.searchsorted(model.coarse[b], x[0, b], side="right")] for a, b, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-one)))


def test_every_row_has_a_score(spark, awkward, clashing, none):
    docs, labels = labelled(spark, 60)
    model = quality.fit(docs, labels)
    rows = quality.score(clashing, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["n_words"] == "kept"
    assert quality.score(none, model).count() == 0
    for constant in (quality.fit(none, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs, labels.filter("quality = 1"))):
        assert len({r["score"] for r in quality.score(awkward, constant, ["doc_id"]).collect()}) == 1


def test_bound_of_the_sample(spark):
    docs, labels = labelled(spark, 90)
    assert quality.score(docs, quality.fit(docs, labels, most=30)).count() == 90
