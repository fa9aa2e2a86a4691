"""Benchmark decontamination with suffix arrays over shards of the training documents.

A task gathers whole documents into shards of bounded size, builds the suffix array of a shard's words by doubling
(suffixes end at a word that no test item has, as no match can pass it), and binary-searches every suffix of every
test item in it. The neighbours of the insertion point give the longest verbatim match; where it reaches a window,
the range of equal beginnings gives all places. Documents are never cut and never moved, so there is no shuffle.

A window is `width` consecutive words of an item; an item with fewer words, but at least one, is one window.
Results: null or empty texts have no words and match nothing; null items match nothing; items and rows that repeat
count like any other (an item_id that repeats is listed once); item ids are compared as text, a null id is left out of
the list but its matches count. Empty tables give empty or clean results. Other columns pass through, columns named
like the added ones are replaced.

The items are sent to the tasks in blocks of `block` bytes at most, searched one after the other, so a task's memory
has one shard and one block at a time, however large either table is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import enter, letter_words, raw, release

SHARD = 1 << 20  # words


class Items:
    """One block of test items: words as numbers from 1, distinct windows, and which items have them."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], width: int):
        numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        coded = [(key, [numbers[w] for w in words]) for key, words in rows if words]
        self.number_of = dict(numbers)
        self.width = width
        self.longest = max((len(c) for _, c in coded), default=0)
        self.keys = [key for key, _ in coded]
        self.lengths = np.array([len(c) for _, c in coded], np.int64)
        # All items in a row, with zeros behind each so that a suffix never runs into the next item.
        flat: list[int] = []
        begins = []
        for _, c in coded:
            begins.append(len(flat))
            flat += c + [0]
        self.flat = np.array(flat + [0] * (self.longest + 1), np.int64)
        # One suffix per window: where it starts, the window's length, its item.
        spans = [
            (b + i, min(width, len(c)), k)
            for k, (b, (_, c)) in enumerate(zip(begins, coded, strict=True))
            for i in range(max(1, len(c) - width + 1))
        ]
        self.at, self.size, self.item = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        self.offset = self.at - np.array(begins, np.int64)[self.item] if spans else self.at
        self.least = int(self.size.min()) if spans else 0


def suffix_array(words: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Positions of the suffixes that have `least` known words, in order by their first `depth` words.

    words: numbers, 0 for a word that ends every match; depth + 1 zeros must follow the last word.
    """
    live = np.flatnonzero(words)
    if not len(live):
        return live
    rank = words.astype(np.int64, copy=True)
    reach = 1
    while reach < depth:
        pair = rank[live] * (int(rank.max()) + 1) + rank[np.minimum(live + reach, len(rank) - 1)]
        values, inverse = np.unique(pair, return_inverse=True)
        rank[live] = inverse + 1
        reach *= 2
        if len(values) == len(live):
            break
    zeros = np.flatnonzero(words == 0)
    run = zeros[np.searchsorted(zeros, live)] - live
    live = live[run >= least]
    return live[np.argsort(rank[live], kind="stable")]


def compare(words: np.ndarray, sa: np.ndarray, places: np.ndarray, items: Items, which: np.ndarray, size: np.ndarray):
    """Common words of test suffixes with the suffixes at some places of the array, and whether the latter are less."""
    steps = np.arange(int(size.max()) if len(size) else 0)
    test = items.flat[items.at[which][:, None] + steps]
    train = words[np.minimum(sa[places][:, None] + steps, len(words) - 1)]
    stop = (test != train) | (train == 0) | (steps >= size[:, None])
    stop = np.concatenate((stop, np.ones((len(which), 1), bool)), axis=1)
    common = stop.argmax(axis=1)
    at = np.minimum(common, max(0, len(steps) - 1))
    rows = np.arange(len(which))
    less = (common < size) & (train[rows, at] < test[rows, at])
    return np.minimum(common, size), less


def bound(words, sa, items, which, size, after: bool) -> np.ndarray:
    """First place whose suffix isn't less than (or, with after, is beyond) the first `size` words of a test suffix."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        common, less = compare(words, sa, mid, items, which[open_], size[open_])
        right = less | (after & (common >= size[open_]))
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def search(words: np.ndarray, items: Items, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place of every window: its number, the place, and the longest match of its suffix anywhere in the shard."""
    sa = suffix_array(words, max(items.longest, 1), items.least)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(sa):
        for start in range(0, len(items.at), chunk):
            which = np.arange(start, min(start + chunk, len(items.at)))
            rest = items.lengths[items.item[which]] - items.offset[which]
            spot = bound(words, sa, items, which, rest, False)
            longest = np.zeros(len(which), np.int64)
            for near in (spot - 1, spot):
                ok = (near >= 0) & (near < len(sa))
                longest[ok] = np.maximum(longest[ok], compare(words, sa, near[ok], items, which[ok], rest[ok])[0])
            which, longest = which[got := longest >= items.size[which]], longest[got]
            if not len(which):
                continue
            low = bound(words, sa, items, which, items.size[which], False)
            high = bound(words, sa, items, which, items.size[which], True)
            n = high - low
            places = sa[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            out.append((np.repeat(which, n), places, np.repeat(longest, n)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks(benchmark: DataFrame, key: str, text: str, width: int, block: int) -> Iterator[Items]:
    """The items in blocks of bounded bytes, read partition by partition."""
    rows: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(key).cast("string"), F.col(text)).toLocalIterator():
        rows.append((row[0], letter_words(row[1])))
        size += len(raw(row[1])) + 64
        if size >= block:
            yield Items(rows, width)
            rows, size = [], 0
    if rows:
        yield Items(rows, width)


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()), T.StructField("words", T.IntegerType()),
    ]))),
])


def shard_matches(texts: list[list[bytes]], sent: list, places: bool) -> dict[str, list]:
    """The added columns for the documents of one shard."""
    lengths = np.array([len(w) for w in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    edges = np.zeros(int(begins[-1]) + 1, np.int64)
    found: list[set] = [set() for _ in texts]
    spans: list[list] = [[] for _ in texts]
    for block in sent:
        items: Items = block.value
        if not len(items.at):
            continue
        known = items.number_of.get
        numbers = [known(w, 0) for words in texts for w in (*words, b"")]
        words = np.concatenate((np.array(numbers, np.int64), np.zeros(2 * items.longest + 2, np.int64)))
        which, at, _ = search(words, items)
        if not len(which):
            continue
        np.add.at(edges, at, 1)
        np.add.at(edges, at + items.size[which], -1)
        docs = owner[at]
        for pair in np.unique(docs * len(items.keys) + items.item[which]).tolist():
            found[pair // len(items.keys)].add(items.keys[pair % len(items.keys)])
        if places:  # windows side by side on one diagonal are one longer match
            order = np.lexsort((at, at - items.offset[which], items.item[which]))
            w, p = which[order], at[order]
            new = np.ones(len(w), bool)
            new[1:] = (items.item[w][1:] != items.item[w][:-1]) | (p[1:] != p[:-1] + 1) | (items.offset[w][1:] != items.offset[w][:-1] + 1)
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(w)])) - 1
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                d = int(owner[p[a]])
                spans[d].append((items.keys[items.item[w[a]]], int(items.offset[w[a]]), int(p[a] - begins[d]), int(p[b] - p[a] + items.size[w[b]])))
    hit = np.cumsum(edges)[:-1] > 0
    hits = np.bincount(owner[hit[: len(owner)]], minlength=len(texts)).tolist()
    listed = [sorted(k for k in f if k is not None) for f in found]
    out = {
        "n_words": lengths.tolist(), "n_hit": hits, "n_items": [len(x) for x in listed],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed],
        "contaminated": [h > 0 for h in hits],
    }
    if places:
        out["matches"] = [[dict(zip(("item_id", "item_word", "doc_word", "words"), s, strict=True)) for s in sorted(x, key=lambda s: (s[2], s[0] or "", s[1]))] for x in spans]
    return out


def overlaps(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", kept: list[str] | None = None, places: bool = False, shard: int = SHARD, block: int = 8 << 20,
) -> DataFrame:
    """The kept columns (all by default) and, per document, what it has in common with the items.

    n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated; with places also
    matches: longest verbatim matches as (item_id, item_word, doc_word, words).
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(x) for x in blocks(benchmark, item_key, item_text, width, block)]
    added = [f for f in ADDED.fields if places or f.name != "matches"]
    names = [c for c in (kept or docs.columns) if c not in {f.name for f in added}]
    schema = T.StructType([docs.schema[c] for c in names] + added)
    layout = pa.schema([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}.get(
        f.dataType.simpleString(), pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))) for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("leaks")
        release()
        held: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = shard_matches(texts, sent, places)
            rows = pa.Table.from_batches(held).combine_chunks()
            arrays = [rows.column(c).combine_chunks() for c in names]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(out[f.name], f.type) for f in layout], [*names, *layout.names])

        for batch in batches:
            rest = batch.select(names) if names else batch
            column = batch.column(text)
            start = 0
            for i in range(len(column)):
                words = letter_words(column[i].as_py())
                texts.append(words)
                size += len(words) + 1
                if size >= shard:
                    held.append(rest.slice(start, i + 1 - start))
                    yield flush()
                    held, texts, size, start = [], [], 0, i + 1
            if start < len(column):
                held.append(rest.slice(start))
        if texts:
            yield flush()

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any window of any item, with their own columns."""
    marked = overlaps(docs.withColumn("_given", F.lit(1)), benchmark, **options)
    return marked.filter("not contaminated").select(*docs.columns)


def oracle(width: int = 10) -> str:
    """DuckDB SQL for doc_id and the added columns: every window of every text as a string."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def split(key: str, table: str) -> str:
        low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
        return rf"SELECT {key}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"

    return f"""
WITH docs AS ({split('doc_id', 'documents')}), items AS ({split('CAST(item_id AS VARCHAR) AS item_id', 'benchmark')}),
starts AS (SELECT item_id, w, least({width}, len(w)) AS size, unnest(range(1, greatest(2, len(w) - {width} + 2))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, i, p.size FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM places) p JOIN windows USING (size, k)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range({width}) AS t(j) WHERE j < size GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""".strip()
