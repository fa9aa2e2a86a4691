"""SentencePiece encoding and decoding by backtracking, for merge-type (BPE) models.

An encoding of merge type is the one way to cut a text into pieces such that merging any two neighbours' characters
anew gives exactly these two pieces. So the encoder walks a text, takes the longest piece that starts at a position
(all matches come from one Aho-Corasick pass), asks whether it goes with the piece before by re-merging the two, and
falls back to shorter pieces, then to earlier positions. A position from which no way leads on is marked in a bit
field and never tried again, which keeps the walk linear.

Results: a null text is encoded as the empty text (only the end id). An empty table gives an empty table. Rows are
independent, so repeated rows and ties need no rule; other columns pass through untouched unless they bear the names
of the added ones, which are then replaced. Texts of any length are walked in blocks, so memory follows the ids.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugewright.llm.common import enter, release

SPACE = "▁"
BLOCK = 4096  # characters matched at a time
CACHED = 150_000  # segments remembered per generation; two generations are kept
SEEN = 1 << 22  # marks of segments met once; only what comes again is remembered


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.text_of = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.text_of[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.silent = {i for i in range(size) if model.is_control(i)}
        normal = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.id_of = {self.text_of[i]: i for i in normal}
        self.plain = frozenset(normal)
        self.score = {self.text_of[i]: model.get_score(i) for i in normal}
        # A piece that merging its own characters doesn't give can't occur in any encoding.
        self.whole = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        self.longest = max(map(len, self.whole), default=1)
        self.matcher = ahocorasick.Automaton()
        for piece in self.whole:
            self.matcher.add_word(piece, len(piece))
        self.matcher.make_automaton()
        self.fits = functools.lru_cache(200_000)(self._fits)
        # Cuts that no piece spans: between characters that are neighbours in no piece; before a run of spaces, and
        # around a line feed.
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        space_inside = any(SPACE in p.lstrip(SPACE) for p in self.score)
        line_inside = any("\n" in p for p in self.score)
        self.cut = re.compile(r"(?s).+" if space_inside or line_inside else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # Ids of segments as text, in two generations; and the decoded text of segments that don't decode to themselves.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.seen = bytearray(SEEN)

    def merged(self, text: str) -> list[str]:
        """Merge rule on a short text: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def split(self, text: str) -> list[str]:
        """The pieces of a text in which spaces are already marked."""
        if text in self.whole:
            return [text]
        n = len(text)
        if n <= BLOCK:
            return self.split_block(text, n)
        failed = 0  # bit per position
        blocks: dict[int, list[list[int]]] = {}

        def lengths(pos: int) -> list[int]:
            """Lengths of the pieces that start here, shortest first; a lone character always counts."""
            k = pos // BLOCK
            if k not in blocks:
                if len(blocks) > 3:
                    del blocks[min(blocks, key=lambda b: -abs(b - k))]
                begin = k * BLOCK
                found: list[list[int]] = [[] for _ in range(min(BLOCK, n - begin))]
                for last, length in self.matcher.iter(text[begin : begin + BLOCK + self.longest]):
                    if (at := last - length + 1) < len(found):
                        found[at].append(length)
                for x in found:
                    if not x or x[0] > 1:
                        x.insert(0, 1)
                blocks[k] = found
            return blocks[k][pos - k * BLOCK]

        ends: list[int] = []  # ends of the pieces so far
        tries: list[int] = []  # which length was taken for each
        pos, before, here = 0, "", lengths(0) if n else []
        k = len(here) - 1
        while pos < n:
            while k >= 0:
                after = pos + here[k]
                if not failed >> after & 1:
                    piece = text[pos:after]
                    if not before or self.fits(before, piece):
                        break
                k -= 1
            if k >= 0:
                ends.append(after)
                tries.append(k)
                pos, before = after, piece
                if pos < n:
                    here = lengths(pos)
                    k = len(here) - 1
            else:
                failed |= 1 << pos
                ends.pop()
                k = tries.pop() - 1
                pos = ends[-1] if ends else 0
                before = text[(ends[-2] if len(ends) > 1 else 0) : pos]
                here = lengths(pos)
        starts = [0, *ends[:-1]]
        return [text[a:b] for a, b in zip(starts, ends, strict=True)]

    def split_block(self, text: str, n: int) -> list[str]:
        """The same walk over a text of one block, which has nearly all segments."""
        starts: list[list[int]] = [[] for _ in range(n)]
        for last, length in self.matcher.iter(text):
            starts[last - length + 1].append(length)
        fits = self.fits
        failed = pos = 0
        before, parts, tries = "", [], []
        here = starts[0]
        if not here or here[0] > 1:
            here.insert(0, 1)
        k = len(here) - 1
        while True:
            while k >= 0:
                after = pos + here[k]
                if not failed >> after & 1:
                    piece = text[pos:after]
                    if not before or fits(before, piece):
                        break
                k -= 1
            if k >= 0:
                parts.append(piece)
                if after == n:
                    return parts
                tries.append(k)
                pos, before = after, piece
                here = starts[pos]
                if not here or here[0] > 1:
                    here.insert(0, 1)
                k = len(here) - 1
            else:
                failed |= 1 << pos
                pos -= len(parts.pop())
                before = parts[-1] if parts else ""
                k = tries.pop() - 1
                here = starts[pos]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.id_of_byte:
                out.extend(self.id_of_byte[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, then the end id."""
        return [i for s in self.segments(text or "") for i in self.ids(s)] + [self.end]

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids, with the space that encoding puts in front still there."""
        if self.plain.issuperset(ids):
            return "".join(map(self.text_of.__getitem__, ids)).replace(SPACE, " ")
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.silent:
                out.append(self.text_of[i].replace(SPACE, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_part(ids).removeprefix(" ")

    def known(self, segment: str) -> str:
        """Ids of a segment as text, remembered for short ones that come again; what they decode to is looked at once."""
        got = self.old.get(segment)
        if got is None:
            if len(segment) > 2 and not segment[-1].isalnum() and segment[-2:] not in self.inside:
                head, mark = segment[:-1], segment[-1]
                got = f"{self.young.get(head) or self.known(head)} {self.young.get(mark) or self.known(mark)}"
                if head in self.odd or mark in self.odd:
                    self.odd[segment] = self.odd.get(head, head.replace(SPACE, " ")) + self.odd.get(mark, mark.replace(SPACE, " "))
            else:
                ids = self.ids(segment)
                got = " ".join(map(str, ids))
                if (decoded := self.decode_part(ids)) != segment.replace(SPACE, " "):
                    self.odd[segment] = decoded
        if len(segment) <= 48:
            at = hash(segment) % SEEN
            if not (self.seen[at] or segment in self.old):
                self.seen[at] = 1
                return got
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
                self.seen = bytearray(SEEN)
            self.young[segment] = got
        return got

    def round_trip(self, text: str | None) -> tuple[str, int, str]:
        """Decimal ids joined by spaces (end id included), number of ids, decoded text."""
        if len(self.odd) > CACHED:
            self.odd, self.young, self.old = {}, {}, {}
        segments, known, young = self.segments(text or ""), self.known, self.young
        parts = []
        for s in segments:
            got = young.get(s)
            if got is None:
                got = known(s)
                young = self.young
            parts.append(got)
        parts.append(str(self.end))
        line = " ".join(parts)
        if self.odd and not self.odd.keys().isdisjoint(segments):
            decoded = "".join([self.odd.get(s) or s.replace(SPACE, " ") for s in segments])
        else:
            decoded = "".join(segments).replace(SPACE, " ")
        return line, line.count(" ") + 1, decoded.removeprefix(" ")


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    """One per worker and model; the model file is read on the machine that encodes."""
    return Pieces(path)


def tokenize(docs: DataFrame, model: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Adds n_tokens and, as asked, ids (array) with decoded, or sha256 digests of both.

    `model` is a path that is valid on every executor (a file of an installed package, or one that
    spark.sparkContext.addFile has sent along).
    """
    added = [("n_tokens", T.LongType())]
    added += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())] if ids else []
    added += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else []
    names = [n for n, _ in added]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces", load.cache_clear)
        release()
        own = load(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out: dict[str, list] = {n: [] for n in names}
                for value in batch.column(text):
                    line, n, decoded = own.round_trip(value.as_py())
                    out["n_tokens"].append(n)
                    if ids:
                        out["ids"].append([int(i) for i in line.split()])
                        out["decoded"].append(decoded)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                columns = [batch.column(f.name) for f in kept]
                columns += [pa.array(out[n], kinds.get(n, pa.string())) for n in names]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + names)

    return docs.mapInArrow(run, schema)
