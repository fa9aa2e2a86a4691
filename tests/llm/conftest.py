import random

import pytest

CLASHING = ("score", "n_words", "n_tokens", "shard", "slot", "bucket", "c", "g", "features", "label", "n_lines", "left", "matches", "gone", "_given")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward_rows(seed=5):
    """Texts with everything that may go wrong: (doc_id, text)."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3]) for i in range(12)]  # copies
    for i in range(12):  # near copies
        words = base[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
    shared = prose(rng, 70)
    rows += [(300 + i, f"{prose(rng, 12)}\n{shared}\n{prose(rng, 15)}") for i in range(8)]  # a passage of many
    rows += [
        (400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "ONE"), (405, "Ünïcode ÉÉ İK K 中文字 𝕏 ▁x\x00y"),
        (406, "spam " * 3000), (407, "x" * 30_000), (408, prose(rng, 15_000)), (409, "a\r\nb\rc\x0bd"),
        (None, base[0]), (None, None), (0, base[0]), (0, base[0]), (1, "another text for the same id"),
        (500, "This is under the MIT License. " + base[3]), (501, "Licensed under the Apache License, Version 2.0."),
        (502, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (503, "Licensed under CC BY-NC 4.0."),
        (504, "line one two three four five six seven eight nine\nline one two three four five six seven eight ten\n\nline one two three four five six seven eight nine"),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(
        [(k, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, (k, t) in enumerate(awkward_rows())],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.lit("kept").alias(c) for c in CLASHING])
