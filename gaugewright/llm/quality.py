"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree per feature and round on the gradient left by all the others, so each feature
ends up with a lookup table over its bins; the strongest pairs of features then get two-dimensional tables the same
way. A score is the logistic of an intercept and one table value per feature and pair, added for whole batches.

Fitting takes at most `most` labelled rows, those with the smallest hash of doc_id (a documented bound); every other
step covers all rows. Null and empty texts have defined features (zeros) and get a score like any other text. Without
labelled rows, or with one class only, the model is its intercept. Rows whose label is null are not learned from.
Other columns pass through; columns named like the result are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import enter, release, text_packs

FEATURES = (
    "log_words", "word_chars", "distinct_words", "repeated_next", "distinct_pairs", "upper", "lower", "digits",
    "exclaims", "commas", "stops", "bars", "symbols", "beyond_ascii", "line_words", "distinct_lines", "short_words",
    "top_word", "capitals", "ends_marked",
)
_MARKS = b"*#&%$@^~=+_<>\\/{}[]"
_CLASS = np.full(256, 9)
for _k, _set in enumerate((
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?", b",;:", b".", b"|", _MARKS,
    bytes(range(128, 256)),
)):
    _CLASS[list(_set)] = _k


def describe(data: bytes) -> list[float]:
    """Features of one text; every one is a share or a mean, so that long and short texts compare."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=10)
    chars = max(1, len(data) - n + 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = kinds / chars
    firsts = bytes([w[0] for w in words])
    lasts = bytes([w[-1] for w in words])
    capitals = sum(firsts.count(bytes([c])) for c in range(65, 91))
    marked = sum(lasts.count(bytes([c])) for c in _MARKS)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(lengths.mean()), len(counts) / n, sum(map(operator.eq, words, words[1:])) / n,
        pairs / max(1, n - 1), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        share[8], n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), float((lengths <= 3).mean()),
        max(counts.values()) / n, capitals / n, marked / n,
    ]


@dataclass
class Additive:
    """Lookup tables: one per feature, one per kept pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        small = {}
        for a, b, table in self.pairs:
            for j in (a, b):
                if j not in small:
                    small[j] = np.searchsorted(self.coarse[j], x[:, j], side="right")
            total += table[small[a], small[b]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Value per bin of a shallow tree over ordered bins, grown by the best split of any leaf."""
    bounds = [(0, len(g))]
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def gain(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        at = np.arange(lo + 1, hi)
        gl, hl = gs[at] - gs[lo], hs[at] - hs[lo]
        gr, hr = gs[hi] - gs[at], hs[hi] - hs[at]
        total = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + ridge)
        k = int(np.argmax(total))
        return float(total[k]), int(at[k])

    while len(bounds) < leaves:
        found = [(*gain(*b), b) for b in bounds]
        best, at, (lo, hi) = max(found)
        if best <= 1e-9:
            break
        bounds.remove((lo, hi))
        bounds += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in bounds:
        out[lo:hi] = (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut of a two-dimensional table into four parts: its gain, and the value per cell."""
    gs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    hs = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, out = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, out
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    part = lambda s: (
        s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b],
    )
    pg, ph = part(gs), part(hs)
    gains = sum(x**2 / (y + ridge) for x, y in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    best = float(gains[i, j])
    v = [x[i, j] / (y[i, j] + ridge) for x, y in zip(pg, ph, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def boost(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, leaves: int = 4,
    pairs: int = 8, pair_bins: int = 8, ridge: float = 1.0,
) -> Additive:
    """Fits the tables on the bounded sample."""
    n, width = len(y), x.shape[1] if x.ndim == 2 else len(FEATURES)
    p = (y.sum() + 0.5) / (n + 1.0)
    intercept = float(np.log(p / (1 - p)))
    edges = [_cuts(x[:, j], bins) if n else np.zeros(0) for j in range(width)]
    coarse = [_cuts(x[:, j], pair_bins) if n else np.zeros(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(intercept, edges, tables, [], coarse)
    if n == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    total = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, ridge)
            tables[j] += step
            total += step[at[j]]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(small[a] * shape[1] + small[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(_quarters(cells(a, b, g), cells(a, b, h), ridge)[0], a, b) for a in range(width) for b in range(a)]
    kept = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains)[-pairs:]]
    for _ in range(rounds // 3):
        for a, b, table in kept:
            g, h = slopes()
            step = rate * _quarters(cells(a, b, g), cells(a, b, h), ridge)[1]
            table += step
            total += step[small[a], small[b]]
    model.pairs = kept
    return model


def features(docs: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """The kept columns and one column of features per row."""
    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField("features", T.ArrayType(T.DoubleType()), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            rows = [describe(d) for _, pack in text_packs([batch], [], text) for d in pack]
            arrays = [batch.column(c) for c in kept] + [pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "features"])
        release()

    return docs.select(*kept, text).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", most: int = 20_000) -> Additive:
    """Learns from at most `most` labelled rows, taken by the hash of their key."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(most)
    )
    # The chosen keys are at most `most` rows of two numbers, so they are sent to the documents.
    rows = features(
        docs.select(key, "text").join(F.broadcast(chosen), key), [key, "_label"]
    ).orderBy(F.xxhash64(key), key).limit(2 * most).collect()
    x = np.array([r["features"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y = np.array([float(r["_label"] > 0) for r in rows])
    return boost(x, y)


def score(docs: DataFrame, model: Additive, kept: list[str] | None = None, name: str = "score", text: str = "text") -> DataFrame:
    """The kept columns (all by default) and the score of each text."""
    names = [c for c in (kept or docs.columns) if c != name]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            rows = [describe(d) for _, pack in text_packs([batch], [], text) for d in pack]
            value = model.score(np.array(rows, dtype=float).reshape(len(rows), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(value)], [*names, name])
        release()

    needed = docs.select(*dict.fromkeys([*names, text]))
    return needed.mapInArrow(run, schema)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo the number of parts; null keys have none."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % parts
