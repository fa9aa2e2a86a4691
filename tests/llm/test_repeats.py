import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gaugewright.llm import repeats
from gaugewright.llm.common import raw


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out)


def found(df, **options):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["left"])) for r in repeats.dedupe(df, **options).collect())


def small(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    shared = [word(40) for _ in range(4)]
    texts = [word(rng.randrange(0, 60)) + rng.choice(shared)[: rng.randrange(20, 40)] + word(rng.randrange(0, 60)) for _ in range(60)]
    texts += ["ab" * 50, "aba" * 30, "a" * 300, "a" * 19, None, "", "é" * 30, texts[0], texts[0], shared[0] + "c" + shared[1]]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts


@pytest.mark.parametrize("crowd", [4096, 1])
def test_short_strings_like_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    df, texts = small(spark)
    want = brute([raw(t) for t in texts], 20)
    assert found(df, length=20, part=7) == want
    if crowd == 4096:
        assert found(df.repartition(5), length=20, part=20) == want


def test_long_texts_are_walked_in_stretches(spark, monkeypatch):
    df, texts = small(spark)
    joined = "".join(t or "" for t in texts)
    df = spark.createDataFrame([(1, joined), (2, joined[200:900]), (3, "q" + joined[1000:1300])], "doc_id long, text string")
    monkeypatch.setattr(repeats, "STRETCH", 150)
    out = found(df, length=20, part=7)
    assert out == brute([joined.encode(), joined[200:900].encode(), b"q" + joined[1000:1300].encode()], 20)


def test_defaults_and_awkward_rows(awkward, clashing, none):
    rows = [raw(r["text"]) for r in awkward.select("text").collect() if r["text"] is None or len(r["text"]) < 40_000]
    few = awkward.filter("text is null or length(text) < 40000")
    assert found(few.select("doc_id", "text")) == brute(rows, 200)
    more = repeats.dedupe(clashing)
    assert more.columns.count("left") == 1 and more.first()["score"] == "kept"
    assert repeats.dedupe(none).count() == 0


def test_suffixes_come_in_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    at = rng.permutation(450)
    group = np.sort(rng.integers(0, 3, 450))
    order = repeats.suffix_order(repeats.Hashes(data), data, at, group, 50)
    text = data.tobytes()
    got = [(int(g), text[i : i + 50]) for g, i in zip(group[order], at[order], strict=True)]
    assert got == sorted((int(g), text[i : i + 50]) for g, i in zip(group, at, strict=True))
