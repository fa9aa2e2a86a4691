"""Interpolated modified Kneser-Ney model over word pairs, counted in Spark and scored from memory-mapped arrays.

Counting. Tasks count words, hash them to 64 bits and send sorted runs of (hash, count) to buckets of the hash range;
each bucket is merged and written as one sorted hash array, so a word's number is its place in the vocabulary. A second
pass counts pairs of numbers in the same way, in buckets of the pair's hash; merging a bucket also gives, per word,
with how many others it stands (before and after), which a last small exchange sums up. Every exchange carries sums,
never occurrences, and buckets are dealt by hash, so frequent words and pairs load no task more than others.

The model is a folder of sorted hash arrays with counts beside them. Workers map these files into memory and look up
whole batches by binary search; only pages that are read take memory, shared by the workers of a machine. The folder
lies in the shared folder, which must be mounted on every machine (spark.checkpoint.dir with a file path).

p(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(w);  p(w) = max(a(w) - D, 0) / A + g / (V + 1), where a(w) is the number
of words seen before w, A their sum, V the distinct tokens, D and g the modified discounts and what they leave.

Results: a null or empty text has one token, its end. Repeated rows count and score each. With no training text every
token has probability 1. Other columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugewright.llm.common import mix, partitions, shared_folder, text_packs

END = xxhash.xxh64_intdigest(b"")  # no word is empty
PAIRS = 1 << 21  # tokens per bucket of pairs
HELD = 400_000  # distinct words that a task gathers before it sends a run


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, the planes of equal weight side by side, deflated lightly."""
    wide = np.ascontiguousarray(values)
    return zlib.compress(wide.dtype.char.encode() + wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    plain = zlib.decompress(data)
    kind = np.dtype(plain[:1].decode())
    return np.frombuffer(plain, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before.astype(np.uint64) + np.uint64(1)) + word.astype(np.uint64))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash space, for a power of two of buckets."""
    bits = buckets.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def store(folder: str, name: str, values: np.ndarray) -> None:
    """Written aside and renamed, so a task that runs twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(aside, values)
    os.replace(aside, f"{folder}/{name}.npy")


@functools.lru_cache(4096)  # each map keeps a file open
def mapped(path: str) -> np.ndarray:
    if not os.path.exists(path):
        return np.zeros(0, np.uint64)
    return np.load(path, mmap_mode="r")


def find(folder: str, name: str, buckets: int, hashes: np.ndarray, wanted: list[str]) -> tuple[np.ndarray, ...]:
    """Looks sorted hashes up: bucket, place in it (-1: absent), and the wanted arrays' values (0: absent)."""
    own = bucket_of(hashes, buckets)
    cuts = np.searchsorted(own, np.arange(buckets + 1))
    at = np.full(len(hashes), -1, np.int64)
    values = [np.zeros(len(hashes)) for _ in wanted]
    for b in np.unique(own).tolist():
        part = slice(cuts[b], cuts[b + 1])
        table = mapped(f"{folder}/{name}-{b}.npy")
        if not len(table):
            continue
        spot = np.searchsorted(table, hashes[part])
        hit = table[np.minimum(spot, len(table) - 1)] == hashes[part]
        at[part] = np.where(hit, spot, -1)
        for v, w in zip(values, wanted, strict=True):
            column = mapped(f"{folder}/{w}-{b}.npy")
            v[part] = np.where(hit, column[np.minimum(spot, len(table) - 1)], 0)
    return own, at, *values


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that every task needs."""

    folder: str
    buckets: int  # of words
    pair_buckets: int
    starts: list[int] = field(default_factory=list)  # number of the first word of each bucket
    words: int = 0  # V
    tokens: int = 0  # N
    texts: int = 0
    pair_cuts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_cuts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    first_left: float = 1.0  # g of a text's beginning
    kinds: int = 0  # A
    left: float = 1.0  # g of the words


def cuts(n: list[int]) -> tuple[float, float, float]:
    """Modified discounts from the numbers of entries counted once to four times."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0, k)) for k in (1, 2, 3))


def taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([counts >= 3, counts >= 2, counts >= 1], [d[2], d[1], d[0]], 0.0)


def coded(pack: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the texts as numbers of these (end: -1), and the tokens of each text."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat: list[int] = []
    sizes = []
    for text in pack:
        words = text.lower().split()
        sizes.append(len(words) + 1)
        flat += [number[w] for w in words]
        flat.append(-1)
    return list(number), np.array(flat, np.int64), np.array(sizes, np.int64)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_runs(text: str, buckets: int):
    """Task: sorted runs of (hash, count) per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        ends = 0

        def flush() -> pa.RecordBatch:
            hashes = np.append(hashed(list(held)), np.uint64(END))
            counts = np.append(np.fromiter(held.values(), np.uint64, len(held)), np.uint64(ends))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], narrow(counts[order])
            at = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            parts = [(b, slice(at[b], at[b + 1])) for b in range(buckets) if at[b] < at[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in parts], pa.int32()),
                pa.array([squeeze(np.diff(hashes[s], prepend=np.uint64(0))) for _, s in parts], pa.binary()),
                pa.array([squeeze(counts[s]) for _, s in parts], pa.binary()),
            ], ["bucket", "a", "b"])

        for _, pack in text_packs(batches, [], text):
            words, flat, sizes = coded(pack)
            ends += len(sizes)
            for w, n in zip(words, np.bincount(flat + 1, minlength=len(words) + 1)[1:].tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            if len(held) >= HELD:
                yield flush()
                held, ends = {}, 0
        if ends:
            yield flush()

    return run


def merge_words(folder: str):
    """Group: one sorted hash array and its counts."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.cumsum(unsqueeze(x.as_py()), dtype=np.uint64) for x in rows["a"]])
        counts = np.concatenate([unsqueeze(x.as_py()).astype(np.uint64) for x in rows["b"]])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        sums = np.bincount(inverse, counts, len(distinct)).astype(np.uint64)
        b = rows["bucket"][0].as_py()
        ends = int(sums[distinct == np.uint64(END)].sum())
        store(folder, f"counts-{b}", narrow(sums))
        store(folder, f"words-{b}", distinct)
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(distinct)], "total": [int(sums.sum())], "ends": [ends]})

    return run


def numbers(model: Model, words: list[bytes], wanted: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vocabulary numbers (-1: unknown) of some words and, last, of the end; and values of wanted arrays for each."""
    hashes = np.append(hashed(words), np.uint64(END))
    order = np.argsort(hashes)
    own, at, *values = find(model.folder, "words", model.buckets, hashes[order], wanted)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    number = np.where(at >= 0, at + np.array(model.starts, np.int64)[own], -1)
    return number[back], [v[back] for v in values]


def pairs_of(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Word before and word of every token; first stands before a text's first token."""
    word = number[flat]  # the end is the last number, which -1 picks
    before = np.concatenate(([first], word[:-1]))
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = first
    return before, word


def pair_runs(text: str, model: Model):
    """Task: runs of (word before, word, count) per bucket of the pair's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            before, word = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((word, before)) if model.words >= 1 << 31 else np.argsort(before << 32 | word)
            before, word = before[order], word[order]
            new = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (word[1:] != word[:-1]))))
            times = np.diff(np.append(new, len(word)))
            before, word = before[new], word[new]
            own = bucket_of(pair_hash(before, word), model.pair_buckets)
            order = np.argsort(own, kind="stable")
            at = np.searchsorted(own[order], np.arange(model.pair_buckets + 1))
            parts = [(b, order[at[b] : at[b + 1]]) for b in range(model.pair_buckets) if at[b] < at[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in parts], pa.int32()),
                pa.array([squeeze(narrow(np.diff(before[s], prepend=0))) for _, s in parts], pa.binary()),
                pa.array([squeeze(narrow(word[s])) for _, s in parts], pa.binary()),
                pa.array([squeeze(narrow(times[s])) for _, s in parts], pa.binary()),
            ], ["bucket", "a", "b", "c"])

        for _, pack in text_packs(batches, [], text):
            words, flat, sizes = coded(pack)
            number, _ = numbers(model, words, [])
            held.append(pairs_of(flat, sizes, number, model.words))
            size += len(flat)
            if size >= PAIRS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def merge_pairs(model: Model):
    """Group: the sorted hash array of a bucket's pairs; per bucket of words, with how many others a word stands."""

    def run(rows: pa.Table) -> pa.Table:
        before = np.concatenate([np.cumsum(unsqueeze(x.as_py()), dtype=np.int64) for x in rows["a"]])
        word = np.concatenate([unsqueeze(x.as_py()).astype(np.int64) for x in rows["b"]])
        times = np.concatenate([unsqueeze(x.as_py()) for x in rows["c"]])
        distinct, first, inverse = np.unique(pair_hash(before, word), return_index=True, return_inverse=True)
        sums = np.bincount(inverse, times, len(distinct)).astype(np.int64)
        before, word = before[first], word[first]
        b = rows["bucket"][0].as_py()
        store(model.folder, f"times-{b}", narrow(sums))
        store(model.folder, f"pairs-{b}", distinct)
        seen, at = np.unique(np.concatenate((before, word)), return_inverse=True)
        left, right = at[: len(before)], at[len(before) :]
        stats = [np.bincount(right, minlength=len(seen))]
        stats += [np.bincount(left[how], minlength=len(seen)) for how in (sums == 1, sums == 2, sums >= 3)]
        own = np.searchsorted(np.array(model.starts), seen, side="right") - 1
        own[seen == model.words] = -1  # a text's beginning
        of = [int((sums == k).sum()) for k in (1, 2, 3, 4)]
        out = []
        for k in np.unique(own).tolist():
            s = own == k
            base = model.words if k < 0 else model.starts[k]
            out.append((k, squeeze(narrow(np.diff(seen[s] - base, prepend=0))), *(squeeze(narrow(x[s])) for x in stats), of if not out else [0] * 4))
        names = ["bucket", "at", "kinds", "n1", "n2", "n3", "of"]
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def merge_stats(model: Model):
    """Group: per word, the words seen before it and what the discounts leave after it."""

    def run(rows: pa.Table) -> pa.Table:
        b = rows["bucket"][0].as_py()
        size = 1 if b < 0 else len(mapped(f"{model.folder}/words-{b}.npy"))
        sums = np.zeros((4, size))
        for row in rows.select(["at", "kinds", "n1", "n2", "n3"]).to_pylist():
            at = np.cumsum(unsqueeze(row["at"]), dtype=np.int64)
            for k, n in enumerate(("kinds", "n1", "n2", "n3")):
                sums[k, at] += unsqueeze(row[n])
        left = np.tensordot(np.array(model.pair_cuts), sums[1:], 1)
        if b < 0:
            return pa.table({"bucket": pa.array([b], pa.int32()), "left": [float(left[0])], "kinds": [0], "of": pa.array([[0] * 5], pa.list_(pa.int64()))})
        total = np.maximum(mapped(f"{model.folder}/counts-{b}.npy").astype(float), 1)
        store(model.folder, f"kinds-{b}", narrow(sums[0].astype(np.uint64)))
        store(model.folder, f"left-{b}", (left / total).astype(np.float32))
        of = [int((sums[0] == k).sum()) for k in (1, 2, 3, 4)] + [int((sums[0] >= 3).sum())]
        return pa.table({"bucket": pa.array([b], pa.int32()), "left": [0.0], "kinds": [int(sums[0].sum())], "of": pa.array([of], pa.list_(pa.int64()))})

    return run


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all texts of the table and writes the model's arrays."""
    spark = docs.sparkSession
    texts = docs.select(text)
    model = Model(shared_folder(spark, "language"), min(1 << 16, power_of_two(partitions(texts) / 2)), 1)
    runs = texts.mapInArrow(word_runs(text, model.buckets), "bucket int, a binary, b binary")
    # One row per bucket, at most 65536.
    made = {r["bucket"]: r for r in runs.groupBy("bucket").applyInArrow(merge_words(model.folder), "bucket int, n long, total long, ends long").collect()}
    for b in range(model.buckets):
        model.starts.append(model.words)
        if b in made:
            model.words += made[b]["n"]
            model.tokens += made[b]["total"]
            model.texts += made[b]["ends"]
    if not model.words:
        return model
    model.pair_buckets = power_of_two(model.tokens / PAIRS)
    runs = texts.mapInArrow(pair_runs(text, model), "bucket int, a binary, b binary, c binary")
    parts = runs.groupBy("bucket").applyInArrow(
        merge_pairs(model), "bucket int, at binary, kinds binary, n1 binary, n2 binary, n3 binary, of array<long>"
    )
    path = f"{model.folder}/parts"
    parts.write.parquet(f"file://{path}")
    parts = spark.read.schema(parts.schema).parquet(f"file://{path}")
    of = parts.selectExpr(*[f"sum(of[{k}])" for k in range(4)]).first()
    model.pair_cuts = cuts([x or 0 for x in of])
    words = parts.drop("of").groupBy("bucket").applyInArrow(merge_stats(model), "bucket int, left double, kinds long, of array<long>").collect()
    model.kinds = sum(r["kinds"] for r in words)
    model.first_left = sum(r["left"] for r in words) / max(1, model.texts)
    of = [sum(r["of"][k] for r in words) for k in range(5)]
    model.word_cuts = cuts(of[:4])
    model.left = float(np.dot(model.word_cuts, [of[0], of[1], of[4]])) / max(1, model.kinds)
    return model


def chances(model: Model, pack: list[bytes]) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text."""
    words, flat, sizes = coded(pack)
    number, (c, kinds, left) = numbers(model, words, ["counts", "kinds", "left"])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    alone = np.maximum(kinds - taken(kinds, model.word_cuts), 0) / max(1, model.kinds) + model.left / (model.words + 1)
    # Distinct pairs, in local numbers; the end is the last word, a text's beginning one beyond.
    last = len(words)
    word = np.where(flat < 0, last, flat)
    before = np.concatenate(([last + 1], word[:-1]))
    before[starts] = last + 1
    pair, inverse = np.unique(before * (last + 2) + word, return_inverse=True)
    b, w = pair // (last + 2), pair % (last + 2)
    number = np.append(number, model.words)
    total, left = np.append(c, model.texts), np.append(left, model.first_left)
    known = np.flatnonzero((number[b] >= 0) & (number[w] >= 0))
    hashes = pair_hash(number[b[known]], number[w[known]])
    order = np.argsort(hashes)
    times = np.zeros(len(pair))
    times[known[order]] = find(model.folder, "pairs", model.pair_buckets, hashes[order], ["times"])[2]
    seen = total[b] > 0
    p = np.where(
        seen, np.maximum(times - taken(times, model.pair_cuts), 0) / np.maximum(total[b], 1) + left[b] * alone[w], alone[w]
    )
    return (
        sizes, np.add.reduceat((c[word] > 0).astype(np.int64), starts), np.add.reduceat(base[word], starts),
        np.add.reduceat(np.log10(p)[inverse], starts),
    )


def score(docs: DataFrame, model: Model, kept: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (all by default), n_tokens, n_known, base_score, score (log10) and perplexity of each text."""
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())]
    names = [c for c in (kept or docs.columns) if c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chances(model, pack) for _, pack in text_packs([batch], [], text)]
            if not parts:
                continue
            n, known, base, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = [n, known, base, value, 10 ** (-value / n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x) for x in columns], [*names, *dict(added)])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)
