import base64
import random

import pytest

from gaugewright.llm import bytepairs
from gaugewright.llm.tokenizer import PATTERN, RANKS

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytepairs.Merges(RANKS, PATTERN)


def test_random_texts_like_the_library(library, own):
    rng = random.Random(3)
    parts = [
        "a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "é", "ñ", "€", "中", "𝕏", "'s", "'ll", "'S", "!", "0", "12", "\x00", "ing", "the", "abab",
        "aaaa", " " * 31, "\r", ".", "!!", "࢏", "\U0001e6e7", "\x85", " ", "​", "\U000323e7a", "<|endoftext|>",
    ]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = library.encode_ordinary(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == text.encode()


def test_every_kind_of_character(library, own):
    texts = [h + chr(c) + h for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000 for h in ("a", "1", "!")]
    lines = own.encode_pack(texts)
    assert lines == [",".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_long_words_and_packs(library, own, monkeypatch):
    rng = random.Random(4)
    for n in (1, 2, 3, 1000, 30_000):
        for letters in ("a", "ab", "abcdefghiethtion"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert own.encode(text) == library.encode_ordinary(text)
    monkeypatch.setattr(bytepairs, "REPLAYED", 40)
    monkeypatch.setattr(bytepairs, "CACHED", 30)
    small = bytepairs.Merges(RANKS, PATTERN)
    texts = [" ".join("".join(rng.choice("etaoins") for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(60)]
    for i in range(0, 60, 7):
        assert small.encode_pack(texts[i : i + 7]) == [",".join(map(str, library.encode_ordinary(t))) for t in texts[i : i + 7]]


def test_lower_ranks_that_a_merge_brings_forth():
    """Ranks no training would give: ab after bc's own merge, and a token that two pairs make."""
    ranks = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"cd", b"aa", b"bcd", b"aaa", b"ab", b"dd", b"abc", b"cdd", b"bc"]):
        ranks[token] = 300 - i * 3 if i % 2 else 300 + i
    library = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as file:
        file.writelines(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items())
        file.flush()
        own = bytepairs.Merges(file.name, PATTERN)
    rng = random.Random(9)
    for _ in range(2000):
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(4)]
        assert own.encode_pack(texts) == [",".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_table(awkward, clashing, none, library):
    rows = bytepairs.tokenize(awkward, RANKS, PATTERN, digests=True)
    assert rows.count() == awkward.count()
    for r in rows.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "").encode()
    more = bytepairs.tokenize(clashing, RANKS, PATTERN)
    assert more.columns.count("n_tokens") == 1 and more.first()["score"] == "kept"
    assert bytepairs.tokenize(none, RANKS, PATTERN).count() == 0
    back = bytepairs.decode(rows.drop("decoded"), RANKS, PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
