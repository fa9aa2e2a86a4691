"""Byte-level BPE encoding and decoding by replaying the merges over many words at once.

How a word is cut into tokens depends on the word alone. So the encoder takes the words of a whole pack of documents
that it hasn't met before, writes their bytes as one long row of tokens, and keeps an inverted index from each pair of
neighbours (by the token that the pair makes) to the positions where it stands. The merges are replayed in rank order:
all positions of the lowest rank are merged, from left to right, and only the two pairs at the ends of each new token
enter the index. Entries that a merge has made void are recognised when their turn comes. A merge may bring forth a
pair of lower rank in the same word; the rest of that word then waits until that pair is done, as a word by itself
would have it. Documents are put together from the ids of their words, and decoded from the ids.

Spark deals the documents; nothing is shuffled, sent or collected, and a lost task is simply run again.

Results: a null text is encoded as the empty text (no ids). An empty table gives an empty table. Rows are independent,
so repeated rows and ties need no rule; other columns pass through unless they bear the names of added ones, which are
then replaced. Memory follows one pack (4 MB of text, or one longer text), about 60 bytes for each byte of its longest
word, and what is remembered of earlier words; long words are not remembered.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugewright.llm.common import enter

PACK = 4 << 20  # bytes of text whose words are looked up together
REPLAYED = 1 << 20  # bytes of new words replayed together
CACHED = 600_000  # words remembered per generation; two generations are kept
SHORT = 64  # characters of a word that is worth remembering

# Letters and numbers that Unicode has since version 16. The ranks' own library splits by version 16, for
# which these are neither; the pattern library at hand knows later versions.
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with the letters and numbers of the ranks' library."""
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{NEWER}]]")
    return regex.compile(pattern, regex.V1)


class Merges:
    """Encoder and decoder of one file of ranks (base64 of a token and its rank, a line each)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank_of = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.bytes_of = {r: t for t, r in self.rank_of.items()}
        self.bytes_of_text = {str(r): t for t, r in self.rank_of.items()}
        self.find = splitter(pattern).findall
        self.single = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.first = np.full((256, 256), -1, np.int32)  # rank of each pair of bytes
        for token, rank in self.rank_of.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.makes: dict[int, int] = {}  # pair of tokens -> rank of what they make, or -1
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def pair(self, left: int, right: int) -> int:
        key = left << 32 | right
        rank = self.makes.get(key)
        if rank is None:
            if len(self.makes) > 1_000_000:
                self.makes.clear()
            rank = self.makes[key] = self.rank_of.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (none is empty), all merges replayed in rank order over all words together."""
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        token = array("i", self.single[data].tobytes())  # -1: swallowed by the token before it
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        starts = ends - np.array([len(w) for w in words])
        before[starts] = -1
        # The index at first: positions of byte pairs, in order of rank and place.
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        places = np.argsort(ranks, kind="stable")
        kinds, begin = np.unique(ranks[places], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(kinds, np.split(places, begin[1:])) if r >= 0}
        after, before = array("i", after.tobytes()), array("i", before.tobytes())
        makes, pair = self.makes, self.pair
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            at = index.pop(rank, None)
            if at is None:
                continue
            at.sort()
            held = -1  # positions up to here wait for a lower rank of their word
            for i in at:
                if i < held:
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank].append(i)
                    continue
                left, j = token[i], after[i]
                if left < 0 or j < 0 or makes.get(left << 32 | token[j], -2) != rank and pair(left, token[j]) != rank:
                    continue
                token[i], token[j] = rank, -1
                k, h = after[j], before[i]
                after[i] = k
                lower = False
                if k >= 0:
                    before[k] = i
                    key = rank << 32 | token[k]
                    new = makes[key] if key in makes else pair(rank, token[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(heap, new)
                        lower = new < rank
                if h >= 0:
                    key = token[h] << 32 | rank
                    new = makes[key] if key in makes else pair(token[h], rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heappush(heap, new)
                        lower = lower or new < rank
                if lower:
                    held = int(ends[bisect_right(ends, i)])
        token = np.frombuffer(token, np.int32)
        kept = np.flatnonzero(token >= 0)
        ids = token[kept].tolist()
        cuts = np.searchsorted(kept, starts).tolist() + [len(kept)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: set[str]) -> None:
        """Sees to it that the ids of all these words are at hand."""
        young, old = self.young, self.old
        new: list[str] = []
        coded: list[bytes] = []
        size = 0

        def flush() -> None:
            for word, ids in zip(new, self.replay(coded)):
                young[word] = ",".join(map(str, ids))
            new.clear()
            coded.clear()

        for word in words:
            if word in young:
                continue
            known = old.get(word)
            if known is None:
                data = word.encode("utf-8", "surrogatepass")
                rank = self.rank_of.get(data)  # a word that is a token needs no merges
                if rank is None:
                    new.append(word)
                    coded.append(data)
                    size += len(data)
                    if size >= REPLAYED:
                        flush()
                        size = 0
                    continue
                known = str(rank)
            young[word] = known
        if new:
            flush()

    def encode_pack(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, for each text."""
        split = [self.find(t) for t in texts]
        words = set().union(*split)
        self.learn(words)
        young = self.young
        lines = [",".join(map(young.__getitem__, s)) for s in split]
        for word in words:
            if len(word) > SHORT:
                del young[word]
        if len(young) >= CACHED:
            self.old, self.young = young, {}
        return lines

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_pack([text])[0].split(",") if i]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_line(self, line: str) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, line.split(","))) if line else b""


@functools.lru_cache(2)
def load(path: str, pattern: str) -> Merges:
    """One per worker and file; the file is read on the machine that encodes."""
    return Merges(path, pattern)


def packs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, of bounded bytes (or one longer text)."""
    for batch in batches:
        texts = batch.column(text)
        start = size = 0
        pack: list[str] = []
        for i in range(batch.num_rows):
            value = texts[i]
            data = value.as_buffer() if value.is_valid else b""
            size += len(data) if isinstance(data, bytes) else data.size
            pack.append(bytes(data).decode("utf-8", "replace"))
            if size >= PACK or i + 1 == batch.num_rows:
                yield batch.slice(start, len(pack)), pack
                start, size, pack = i + 1, 0, []


def tokenize(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Adds n_tokens and, as asked, ids (array) with decoded (binary), or sha256 digests of both.

    `ranks` is a path that is valid on every executor (a file of an installed package, or one that
    spark.sparkContext.addFile has sent along); `pattern` cuts texts into the words that merges don't cross.
    """
    kinds: dict[str, pa.DataType] = {"n_tokens": pa.int64()}
    added = [("n_tokens", T.LongType())]
    if ids:
        added += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]
        kinds |= {"ids": pa.list_(pa.int32()), "decoded": pa.binary()}
    if digests:
        added += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
        kinds |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kept = [f for f in docs.schema.fields if f.name not in kinds]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bytepairs", load.cache_clear)
        own = load(ranks, pattern)
        for batch, texts in packs(batches, text):
            out: dict[str, list] = {n: [] for n in kinds}
            for line in own.encode_pack(texts):
                decoded = own.decode_line(line)
                out["n_tokens"].append(line.count(",") + 1 if line else 0)
                if ids:
                    out["ids"].append([int(i) for i in line.split(",") if i])
                    out["decoded"].append(decoded)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column(f.name) for f in kept] + [pa.array(out[n], k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + list(kinds))

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that arrays of ids stand for (null ids: null); an id without a token raises KeyError."""
    kept = [f for f in rows.schema.fields if f.name != decoded]
    schema = T.StructType(kept + [T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bytepairs", load.cache_clear)
        own = load(ranks, pattern)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
