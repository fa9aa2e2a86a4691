"""Exact similarity join of documents on their word shingles, through a token-group matrix.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least 3/4. Equal sets are one
class from the start. Documents that share a min-hash are compared with the first of them; whoever links to it joins
its group, so a group is known to be connected and needs no look inside. Then each group's token union is taken over
the prefixes of its documents' sets: the matrix of tokens and groups. Two groups that share tokens are opened only if
the number of shared tokens, with all that may lie beyond the prefixes, can reach the threshold. Documents of opened
groups are compared: first by the same bound on their own prefixes, then on whole sets. Components are found by
contraction: whole groups become single nodes before the next links are looked at.

Prefixes follow a global order of tokens: frequent ones last, as seen in one document of `SAMPLED`; the order only
decides how many pairs are looked at, never which links are found. A token of many documents of one group is a single
entry of the matrix; a group is opened a slice at a time first, so that groups that do link are merged before they are
compared in full.

Results: documents with fewer than five words have their whole word sequence as one shingle; without words or text the
set is empty and links with nothing. A null doc_id takes no part and has no component. Rows that repeat count once;
ids that repeat with other texts are separate rows with separate results. Empty tables give empty results. Texts are
never cut. Extra columns are not carried.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.common import enter, mix, partitions, release, small_batches, text_packs
from gaugewright.llm.language import bucket_of, narrow, power_of_two, squeeze, unsqueeze
from gaugewright.session import materialize, materialize_by

WORDS = 5
SAMPLED = 32  # one document of so many shows which tokens are frequent
FREQUENT = 3  # documents of the sample that make a token frequent
MOST_FREQUENT = 1 << 20  # tokens that are put last
SLICE = 32  # documents of an opened group that are compared first
HELD = 1 << 19  # entries or pairs that a task gathers before it sends or adds them up
SENT = 400_000  # rows of a small table that may be sent to every task
HOT = np.uint64(1 << 63)
_STEPS = mix(np.arange(1, WORDS + 1)) | np.uint64(1)
_TURNS = mix(np.arange(101, 104))


@functools.lru_cache(150_000)
def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 63-bit hashes of the shingles of several texts, one after the other, and the size of each set."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(word_hash, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    n = max(0, len(flat) - WORDS + 1)
    total = flat[:n] * _STEPS[0]
    for i in range(1, WORDS):
        total += flat[i : n + i] * _STEPS[i]
    total = mix(total) >> np.uint64(1)
    # A shingle starts at all but the last words of a text; texts with fewer words have their whole as one.
    begins = np.cumsum(counts) - counts
    own = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    out = np.empty(int(own.sum()), np.uint64)
    starts = np.cumsum(own) - own
    for k, (at, size, start) in enumerate(zip(begins.tolist(), own.tolist(), starts.tolist(), strict=True)):
        part = out[start : start + size]
        if len(words[k]) >= WORDS:
            part[:] = total[at : at + size]
            part.sort()
        elif size:
            part[0] = xxhash.xxh64_intdigest(b" ".join(words[k]), 1) >> 1
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[own > 0]] = True
    sizes = np.zeros(len(texts), np.int64)
    sizes[own > 0] = np.add.reduceat(new.astype(np.int64), starts[own > 0]) if len(out) else 0
    return out[new], sizes


def shingles(text: bytes) -> np.ndarray:
    return shingle_sets([text])[0]


def least_shared(a, b):
    """Shared shingles that two sets of these sizes need: 100 I >= 75 (a + b - I)."""
    return -(-3 * (a + b) // 7)


class Order:
    """Tokens as numbers whose order is the global one: frequent tokens last, by how often, the rest by hash."""

    def __init__(self, tokens: np.ndarray):
        """tokens: the frequent ones, rarest first."""
        self.place = np.argsort(tokens).astype(np.uint64)
        self.tokens = np.sort(tokens)
        self.maybe = np.zeros(1 << 22, bool)  # most tokens are ruled out by a few of their bits
        self.maybe[(self.tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Numbers of tokens; those of frequent ones are HOT and more."""
        at = np.flatnonzero(self.maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            spot = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            real = self.tokens[spot] == s[at]
            s = s.copy()
            s[at[real]] = HOT + self.place[spot[real]]
        return s


def frequent(docs: DataFrame, text: str) -> np.ndarray:
    """Tokens that several documents of the sample have, rarest first; a bounded list that only orders the work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("similar", word_hash.cache_clear)
        for _, pack in text_packs(batches, [], text):
            tokens, times = np.unique(shingle_sets(pack)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(times)], ["token", "n"])

    sample = docs.filter(F.pmod(F.xxhash64(F.lit(3), text), F.lit(SAMPLED)) == 0).select(text).distinct()
    rows = (
        sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    )
    return np.array([r["token"] for r in reversed(rows)], np.uint64)


def sketches(docs: DataFrame, key: str, text: str, order: Order) -> DataFrame:
    """Per row: size of its set, a fingerprint of 128 bits, three min-hashes, the prefix in the global order, how many
    frequent tokens the prefix has, and how many tokens of the set are not frequent."""
    schema = f"{key} long, _t long, n int, f1 long, f2 long, turns array<long>, prefix binary, hot int, rare int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("similar", word_hash.cache_clear)
        release()
        for (keys, hashes), pack in text_packs(batches, [key, "_t"], text, 1 << 21):
            tokens, n = shingle_sets(pack)
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]

            def each(f: np.ufunc, values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(n), np.uint64)
                if len(some):
                    out[some] = f.reduceat(values, starts)
                return out.astype(np.int64)

            turns = np.stack([each(np.minimum, mix(tokens ^ t)) for t in _TURNS], axis=1)
            f1, f2 = each(np.add, mix(tokens)), each(np.add, mix(tokens ^ _TURNS[0] ^ np.uint64(1)))
            ordered = order(tokens)
            rare = each(np.add, (ordered < HOT).astype(np.uint64))
            prefixes, hot = [b""] * len(n), [0] * len(n)
            for k, at in zip(some.tolist(), starts.tolist(), strict=True):
                size = int(n[k])
                own = ordered[at : at + size]
                if rare[k] < size:
                    own = np.sort(own)
                prefix = own[: size - (-(-3 * size // 4)) + 1]
                prefixes[k], hot[k] = prefix.tobytes(), len(prefix) - int(np.searchsorted(prefix, HOT))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n, pa.int32()), pa.array(f1), pa.array(f2),
                pa.array([t if m else [] for t, m in zip(turns.tolist(), n.tolist(), strict=True)], pa.list_(pa.int64())),
                pa.array(prefixes, pa.binary()), pa.array(hot, pa.int32()), pa.array(rare, pa.int32()),
            ], [key, "_t", "n", "f1", "f2", "turns", "prefix", "hot", "rare"])
        word_hash.cache_clear()
        release()  # a worker that waits holds little while joins run

    own = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_t"), text)
    return own.mapInArrow(run, schema)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def lengths_fit(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose prefixes leave the threshold in reach.

    Up to the end of the prefix that ends first all shared tokens are seen; beyond it lies no more than the rest of that
    set, nor than the rest of the other one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("similar", word_hash.cache_clear)
        for batch in batches:
            keep = []
            for p, q, m, n in zip(batch["p"], batch["q"], batch["m"].to_pylist(), batch["n"].to_pylist(), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if x[-1] > y[-1]:
                    x, y, m, n = y, x, n, m
                shared = len(np.intersect1d(x, y, assume_unique=True))
                beyond = min(m - len(x), n - int(np.searchsorted(y, x[-1], side="right")))
                keep.append(shared + beyond >= least_shared(m, n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    left = classes.select(F.col("c").alias("a"), F.col("prefix").alias("p"), F.col("n").alias("m"))
    right = classes.select(F.col("c").alias("b"), F.col("prefix").alias("q"), "n")
    both = pairs.join(left, "a").join(right, "b").filter(lengths_fit(F.col("m"), F.col("n")))
    return both.select("a", "b", "p", "q", "m", "n").mapInArrow(run, pairs.select("a", "b").schema)


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets link."""
    spark = docs.sparkSession
    with small_batches(spark, 1024):
        pairs = materialize(may_link(pairs, classes))
    nodes = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().join(classes.select("c", "rep"), "c")
    nodes = materialize(narrowed(nodes.select("c", F.col("rep.k").alias("_k"), F.col("rep.t").alias("_r"))))
    own = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_r"), F.col(text).alias("_x"))
    texts = own.join(sent_if_small(nodes, nodes.count()), ["_k", "_r"]).groupBy("c").agg(F.first("_x").alias("_x"))
    texts = materialize_by(texts, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("similar", word_hash.cache_clear)
        held = functools.lru_cache(64)(shingles)
        for batch in batches:
            keep = []
            for p, q in zip(batch["p"], batch["q"], strict=True):
                x, y = held((p.as_py() or "").encode()), held((q.as_py() or "").encode())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    both = pairs.join(texts.select(F.col("c").alias("a"), F.col("_x").alias("p")), "a").join(
        texts.select(F.col("c").alias("b"), F.col("_x").alias("q")), "b"
    )
    with small_batches(spark, 128):
        return materialize(both.select("a", "b", "p", "q").mapInArrow(run, pairs.schema))


def narrowed(df: DataFrame) -> DataFrame:
    """Few partitions, and so few files, for tables of links and labels, whose rows are a few numbers."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the roots of their ends; a node without a label is its own root."""
    for end in ("a", "b"):
        to = labels.select(F.col("c").alias(end), F.col("root").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def followed(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """Labels (c, root) whose roots have roots themselves; nodes that only the second table knows join in."""
    if labels is None:
        return more
    to = more.select(F.col("c").alias("root"), F.col("root").alias("_to"))
    moved = labels.join(to, "root", "left").select("c", F.coalesce("_to", "root").alias("root"))
    return moved.union(more.join(labels.select("c"), "c", "left_anti").select("c", "root"))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Smallest node (c, root) of each other node that edges (a, b), and the labels of earlier ones, connect with it.

    Each round gives every node the least of itself and its neighbours, which partial sums find whatever a node's degree,
    and goes on with the edges between the roots; a star is one node after two rounds. Earlier labels are contracted
    first, so edges between known groups are all that is worked on.
    """
    edges = materialize(narrowed(relabelled(edges, labels) if labels is not None else edges.filter("a <> b").select("a", "b").distinct()))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("root"))
        least = materialize(narrowed(least.filter("c <> root")))
        labels = materialize(narrowed(followed(labels, least)))
        edges = materialize(narrowed(relabelled(edges, least)))
    return labels if labels is not None else materialize(edges.select(F.col("a").alias("c"), F.col("b").alias("root")))


def rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with their root (themselves if alone) and the group's number."""
    joined = classes.join(roots, "c", "left")
    return joined.withColumn("root", F.coalesce("root", "c")).withColumn("g", F.xxhash64("root"))


def first_pairs(classes: DataFrame) -> DataFrame:
    """Each class with one class of about its size that has the same min-hash: the one with the fewest tokens of its own,
    which in a large group of near copies is the least edited one and so near to most."""
    keyed = classes.select("c", "n", "rare", F.posexplode("turns").alias("i", "turn")).withColumn(
        "band", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + F.col("i") / 3)  # every turn cuts the sizes elsewhere
    )
    keys = ["i", "turn", "band"]
    heads = keyed.groupBy(*keys).agg(F.min(F.struct("rare", "c", "n")).alias("head"), F.count("*").alias("k")).filter("k > 1")
    pairs = keyed.join(heads, keys).filter((F.col("c") != F.col("head.c")) & lengths_fit(F.col("n"), F.col("head.n")))
    return pairs.select(F.col("c").alias("a"), F.col("head.c").alias("b")).distinct()


def matrix_runs(buckets: int):
    """Task: entries (token, group, whether in an index prefix), one per token and group, in runs per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("similar", word_hash.cache_clear)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, groups, index = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((groups, tokens))
            tokens, groups, index = tokens[order], groups[order], index[order]
            new = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1]))))
            tokens, groups, index = tokens[new], groups[new], np.maximum.reduceat(index, new)
            own = bucket_of(mix(tokens), buckets)
            out = []
            for b in np.unique(own).tolist():
                s = own == b
                names, at = np.unique(groups[s], return_inverse=True)
                out.append((b, squeeze(np.diff(tokens[s], prepend=np.uint64(0))), squeeze(names), squeeze(narrow(at)), squeeze(index[s])))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32() if not i else pa.binary()) for i, x in enumerate(zip(*out, strict=True))], ["bucket", "a", "b", "c", "d"]
            )

        for batch in batches:
            for p, n, g in zip(batch["prefix"], batch["n"].to_pylist(), batch["g"].to_pylist(), strict=True):
                tokens = np.frombuffer(p.as_buffer(), np.uint64)
                index = np.zeros(len(tokens), np.uint8)
                index[: n - (-(-6 * n // 7)) + 1] = 1
                held.append((tokens, np.full(len(tokens), g, np.int64), index))
                size += len(tokens)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        held.clear()
        release()

    return run


def shared_tokens(rows: pa.Table) -> pa.Table:
    """Group: pairs of groups of a bucket, the tokens they share, and whether one is in an index prefix.

    Frequent tokens aren't counted (each document brings along how many it has) and pair only with index prefixes.
    """
    tokens, groups, index = [], [], []
    for a, b, c, d in zip(rows["a"], rows["b"], rows["c"], rows["d"], strict=True):
        tokens.append(np.cumsum(unsqueeze(a.as_py()), dtype=np.uint64))
        groups.append(unsqueeze(b.as_py())[unsqueeze(c.as_py()).astype(np.int64)])
        index.append(unsqueeze(d.as_py()))
    tokens, groups, index = np.concatenate(tokens), np.concatenate(groups), np.concatenate(index)
    order = np.lexsort((groups, tokens))
    tokens, groups, index = tokens[order], groups[order], index[order]
    new = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1]))))
    tokens, groups, index = tokens[new], groups[new], np.maximum.reduceat(index, new)
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    size = np.diff(np.append(start, len(tokens)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        g, h, shared, marked = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((h, g))
        g, h, shared, marked = g[order], h[order], shared[order], marked[order]
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))))
        return g[new], h[new], np.add.reduceat(shared, new), np.maximum.reduceat(marked, new)

    def emit(x: np.ndarray, y: np.ndarray, counted: int) -> None:
        nonlocal waiting
        swap = groups[x] > groups[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        out.append((groups[x], groups[y], np.full(len(x), counted, np.int32), index[x] | index[y]))
        waiting += len(x)
        if waiting > HELD:  # pairs that were seen already are added up before there are many
            out[:] = [gathered()]
            waiting = 0

    rare = tokens[start] < HOT
    for k in np.unique(size[rare & (size > 1)]).tolist():
        at = start[rare & (size == k)]
        few = max(1, (1 << 20) // (k * k))
        i, j = np.triu_indices(k, 1)
        for step in range(0, len(at), few):
            part = at[step : step + few, None]
            emit((part + i).ravel(), (part + j).ravel(), 1)
    for at, k in zip(start[~rare & (size > 1)].tolist(), size[~rare & (size > 1)].tolist(), strict=True):
        every = np.arange(at, at + k)
        for i in every[index[at : at + k] > 0].tolist():
            emit(np.full(k - 1, i), every[every != i], 0)
    if not out:
        return pa.table({n: pa.array([], pa.int64()) for n in ("g", "h", "shared", "marked")})
    g, h, shared, marked = gathered()
    return pa.table({"g": g, "h": h, "shared": shared.astype(np.int64), "marked": marked.astype(np.int64)})


def opened(grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of groups (g, h) that the bound leaves, with the sizes of both."""
    buckets = power_of_two(partitions(classes))
    wide = classes.select("c", "prefix", "n").join(grouped.select("c", "g"), "c").select("prefix", "n", "g")
    runs = wide.mapInArrow(matrix_runs(buckets), "bucket int, a binary, b binary, c binary, d binary")
    shared = runs.groupBy("bucket").applyInArrow(shared_tokens, "g long, h long, shared long, marked long")
    pairs = shared.groupBy("g", "h").agg(F.sum("shared").alias("shared"), F.max("marked").alias("marked")).filter("marked > 0")
    sizes = grouped.groupBy("g").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("hot").alias("hot"), F.count("*").alias("docs")
    )
    other = sizes.select(*[F.col(c).alias(f"{c}_h") for c in sizes.columns]).withColumnRenamed("g_h", "h")
    both = pairs.join(sizes, "g").join(other, "h")
    reach = F.col("shared") + F.least("hot", "hot_h")
    # For any two documents of the groups: what may lie beyond the shorter prefix, and what they need.
    most = F.ceil(F.lit(0.75) * F.greatest("high", "high_h")) - 1
    need = F.ceil((F.col("low") + F.col("low_h")) * 3 / F.lit(7.0) - 1e-9)
    fits = (4 * F.col("high") >= 3 * F.col("low_h")) & (4 * F.col("high_h") >= 3 * F.col("low"))
    return both.filter(fits & (reach + most >= need)).select("g", "h", "shared", "docs", "docs_h")


def across(pairs: DataFrame, grouped: DataFrame, first: bool) -> DataFrame:
    """Pairs of classes of opened groups: of the SLICE documents of each group with the fewest tokens of their own, which
    link to most others, or of all."""
    own = grouped.select("g", "c", "n", "rare", "hot")
    if first:
        order = Window.partitionBy("g").orderBy("rare", "c")  # a limit on the rank keeps few rows per task
        own = own.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= SLICE).drop("_rank")
    left = pairs.join(own, "g").select("h", "shared", F.col("c").alias("a"), F.col("n").alias("m"), F.col("rare").alias("q"), F.col("hot").alias("p"))
    right = own.select(F.col("g").alias("h"), F.col("c").alias("b"), "n", "rare", "hot")
    # With frequent tokens in both prefixes, all other tokens are in them, and no more than `shared` of these are common.
    seen = (F.col("p") > 0) & (F.col("hot") > 0)
    most = F.col("shared") + F.least(F.col("m") - F.col("q"), F.col("n") - F.col("rare"))
    enough = ~seen | (7 * most >= 3 * (F.col("m") + F.col("n")))
    return left.join(right, "h").filter(lengths_fit(F.col("m"), F.col("n")) & enough).select("a", "b")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links lead to, its own included) of every row."""
    with small_batches(docs.sparkSession, 1000):
        return _join(docs, key, text)


def _join(docs: DataFrame, key: str, text: str) -> DataFrame:
    order = Order(frequent(docs, text))
    rows = materialize(sketches(docs, key, text, order))
    whole = rows.filter(F.col(key).isNotNull() & (F.col("n") > 0))
    # One class per set: 128 bits of fingerprint. Prefixes are about as large as the texts are compressed, so they move
    # once: in buckets by class they lie still when pairs of classes ask for them.
    classes = materialize_by(
        whole.groupBy(F.struct("f1", "f2").alias("c")).agg(
            F.min(F.struct(F.col(key).alias("k"), F.col("_t").alias("t"))).alias("rep"),
            *[F.first(x).alias(x) for x in ("n", "turns", "prefix", "hot", "rare")],
        ), "c"
    )
    roots = components(linked(first_pairs(classes), classes, docs, key, text))
    grouped = materialize(narrowed(rooted(classes.select("c", "n", "hot", "rare"), roots)))
    pairs = materialize(narrowed(opened(grouped, classes)))
    # A slice of each opened group first: what it links is one group afterwards, and such pairs are settled, as are
    # those of groups that a slice covers in full.
    roots = components(linked(across(pairs, grouped, True), classes, docs, key, text), roots)
    now = rooted(grouped.select("c", F.col("g").alias("was")), roots).groupBy("was").agg(F.min("g").alias("now"))
    rest = pairs.filter((F.col("docs") > SLICE) | (F.col("docs_h") > SLICE)).join(
        now.select(F.col("was").alias("g"), "now"), "g"
    ).join(now.select(F.col("was").alias("h"), F.col("now").alias("then")), "h")
    rest = materialize(narrowed(rest.filter("now <> then").select("g", "h", "shared", "docs", "docs_h")))
    if not rest.isEmpty():
        roots = components(linked(across(rest, grouped, False), classes, docs, key, text), roots)
    ends = rooted(classes.select("c", "n", "rep"), roots)
    smallest = ends.groupBy("root").agg(F.min("rep.k").alias("component_id"))
    ids = ends.select("c", "n", "root").join(smallest, "root").select(F.col("c.f1").alias("f1"), F.col("c.f2").alias("f2"), "n", "component_id")
    found = rows.select(key, "n", "f1", "f2").join(ids, ["n", "f1", "f2"], "left")
    return found.select(
        key, F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col(key).isNull(), F.lit(None)).otherwise(F.coalesce("component_id", key)).alias("component_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of their component, one row per key, and all rows without a key."""
    found = materialize(join(docs, key, text).filter(F.col(key).isNotNull()))
    kept = materialize(found.filter(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("_rows")))
    size, most = kept.agg(F.count("*"), F.max("_rows")).first()
    named = docs.join(sent_if_small(kept.select(key), size), key, "left_semi").select(*docs.columns)
    if (most or 1) > 1:  # ids that repeat: only their rows move
        twice = kept.filter("_rows > 1").select(key)
        named = named.join(twice, key, "left_anti").select(*docs.columns).union(
            named.join(twice, key, "left_semi").select(*docs.columns).dropDuplicates([key])
        )
    return named.union(docs.filter(F.col(key).isNull()))
