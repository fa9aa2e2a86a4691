import random

import pytest

from gaugewright.llm import pieces
from gaugewright.llm.tokenizer import TOKENIZER

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(TOKENIZER)


def test_random_texts_like_the_library(library, own):
    rng = random.Random(3)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "\t", "▁", "é", "ñ", "€", "中", "𝕏", "<s>", "</s>", "<0x41>", "!", "0", "1", "\x00", "S", "    ", "ing", "the", " " * 31, "\r", ".", "!!"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = library.encode(text) + [2]
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text
        assert own.round_trip(text) == (" ".join(map(str, ids)), len(ids), library.decode(ids)), text


def test_long_words_cross_blocks(library, own):
    rng = random.Random(4)
    for n in (pieces.BLOCK - 1, pieces.BLOCK, pieces.BLOCK + 1, 20_000):
        text = "".join(rng.choice("abcdefghiethtion") for _ in range(n))
        assert own.encode(text) == library.encode(text) + [2]
    assert own.encode(" " * 9000) == library.encode(" " * 9000) + [2]


def test_table(awkward, clashing, none, library):
    rows = pieces.tokenize(awkward, TOKENIZER, digests=True).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        ids = library.encode(r["text"] or "") + [2]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
    more = pieces.tokenize(clashing, TOKENIZER)
    assert more.columns.count("n_tokens") == 1 and more.first()["score"] == "kept"
    assert pieces.tokenize(none, TOKENIZER).count() == 0
