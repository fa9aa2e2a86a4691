"""Random forests grown level by level from histograms.

Features are cut into at most ``bins`` bins at their exact quantiles. All trees grow together: one pass over the rows
sums weights per (tree, node, feature, bin, class) for the nodes of a level, and the best cut of each node is chosen
from these sums where they lie. Bootstrap weights are Poisson numbers from a hash of row id and tree, and the features
that a node may use come from a hash of tree, node and feature, so the forest is the same for any partitioning. On the
driver lie the trees: a row per node. Rows with a missing label or feature are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.quantiles import exact_quantiles
from gaugewright.operators.sums import coded, matrix
from gaugewright.session import materialize

HELD = 1 << 21  # sums that a task holds before equal ones are joined
DIGITS = 9  # gains and shares that agree to so many digits are equal


class Forest(NamedTuple):
    classes: list
    cuts: list[np.ndarray]  # per feature: a value is in the bin after all cuts below it
    feature: np.ndarray  # (trees, nodes): -1 for a leaf; node 1 is the root, 2 n and 2 n + 1 are below n
    bin: np.ndarray  # (trees, nodes): values of this bin or before go left
    share: np.ndarray  # (trees, nodes, classes): share of each class in the node

    def n_parameters(self) -> int:
        """Two numbers (feature and cut) for each node."""
        return 2 * int((self.share.sum(axis=2) > 0).sum())


def poisson_weights(row_id: Column, trees: int, seed: int) -> Column:
    """How often each tree draws a row: Poisson numbers with mean 1 from 52 bits of an MD5."""
    def place(tree: Column) -> Column:
        text = F.concat(row_id.cast("string"), F.lit("-"), tree.cast("string"), F.lit(f"-{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    limits = F.array(*[F.lit(x) for x in poisson_limits()])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), place)
    return F.transform(drawn, lambda p: F.size(F.filter(limits, lambda limit: p >= limit)))


def poisson_limits() -> list[int]:
    """Where each next number begins among 52 bits."""
    share, limits = 0.0, []
    for k in range(12):
        share += math.exp(-1) / math.factorial(k)
        limits.append(int(share * 2**52))
    return limits


def chosen_features(tree: int, node: int, width: int, many: int, seed: int) -> list[int]:
    """The features that a node may cut, by a hash."""
    def order(f: int) -> tuple[str, int]:
        return hashlib.md5(f"{tree}-{node}-{f}-{seed}".encode()).hexdigest(), f

    return sorted(sorted(range(width), key=order)[:many])


def places(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Node of each row in one tree."""
    node = np.ones(len(codes), np.int64)
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = codes[np.arange(len(codes)), np.where(inner, f, 0)] > cut[node]
        node = np.where(inner, 2 * node + right, node)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.int16)


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Weighted impurity (times the weight, classes last), up to a constant that all cuts of a node share."""
    n = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "entropy":
            part = np.where(counts > 0, counts * np.log2(counts / n[..., None]), 0.0).sum(axis=-1)
        else:
            part = (counts * counts).sum(axis=-1) / n
    return -np.where(n > 0, part, 0.0)


def best_cuts(sums: DataFrame, bins: int, n_classes: int, criterion: str) -> list:
    """The best cut of every node from (tree, node, feature, bin, y, s): gain first, then least feature and bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        tree, node, feature, cut, y, s = (whole[c].to_numpy() for c in ("tree", "node", "feature", "bin", "y", "s"))
        keys, at = np.unique(np.column_stack([tree, node, feature]), axis=0, return_inverse=True)
        counts = np.zeros((len(keys), bins, n_classes))
        np.add.at(counts, (at.ravel(), cut, y), s)
        left = counts.cumsum(axis=1)
        total = left[:, -1]
        right = total[:, None] - left
        gain = impurity(total, criterion)[:, None] - impurity(left, criterion) - impurity(right, criterion)
        possible = (left.sum(axis=2) > 0) & (right.sum(axis=2) > 0)
        gain = np.round(np.where(possible, gain / total.sum(axis=1)[:, None], -1.0), DIGITS)
        b = gain.argmax(axis=1)  # the least bin of equal ones
        rows = np.arange(len(keys))
        order = np.lexsort((keys[:, 2], -gain[rows, b], keys[:, 1], keys[:, 0]))
        first = order[np.r_[True, (np.diff(keys[order, :2], axis=0) != 0).any(axis=1)]]
        cuts = gain[first, b[first]] > 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[first, 0], pa.int32()), pa.array(keys[first, 1], pa.int64()),
                pa.array(np.where(cuts, keys[first, 2], -1), pa.int32()), pa.array(b[first], pa.int32()),
                pa.array(list(left[first, b[first]]), pa.list_(pa.float64())), pa.array(list(total[first]), pa.list_(pa.float64())),
            ],
            ["tree", "node", "feature", "bin", "left", "total"],
        )

    found = sums.repartition("tree", "node").mapInArrow(run, "tree int, node long, feature int, bin int, left array<double>, total array<double>")
    return found.collect()  # the nodes of one level


def random_forest(
    df: DataFrame, x: str, label: str, row_id: str, trees: int = 100, depth: int = 10, features: int | None = None,
    bins: int = 32, criterion: str = "gini", seed: int = 42,
) -> Forest:
    """``features`` is how many a node may use (by default the root of all)."""
    rows, classes = coded(df, x, label, keep=[F.col(row_id).alias("row_id")])
    values = rows.select(F.posexplode("x").alias("feature", "v"))
    found = sorted(exact_quantiles(values, ["feature"], "v", [i / bins for i in range(1, bins)], "q").collect())
    cuts = [np.unique(np.array(r["q"])) for r in found]
    if not cuts:
        raise ValueError("a classifier needs complete rows")
    width, n_classes = len(cuts), len(classes)
    many = min(width, features or max(1, math.isqrt(width)))
    drawn = poisson_weights(F.col("row_id"), trees, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = binned(matrix(batch.column("x")), cuts)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), width).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([listed, batch.column("y"), batch.column("w")], ["codes", "y", "w"])

    table = materialize(rows.select("x", "y", drawn.alias("w")).mapInArrow(code, "codes array<smallint>, y int, w array<int>"))
    size = 2 ** (depth + 1)
    feature = np.full((trees, size), -1, np.int32)
    cut = np.zeros((trees, size), np.int32)
    share = np.zeros((trees, size, n_classes))
    growing = {(t, 1) for t in range(trees)} if depth else set()
    level = 0
    while growing:
        usable = {k: np.array(chosen_features(*k, width, many, seed)) for k in growing}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            spans = (trees, size, width, bins, n_classes)

            def joined() -> tuple[np.ndarray, np.ndarray]:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                return keys, np.bincount(at.ravel(), np.concatenate([s for _, s in held]))

            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, y, w = matrix(batch.column("codes")), batch.column("y").to_numpy(), matrix(batch.column("w"))
                for t in range(trees):
                    drawn_here = w[:, t] > 0
                    part = codes[drawn_here]
                    node = places(part, feature[t], cut[t])
                    for k in np.unique(node):
                        if (t, int(k)) not in usable:
                            continue
                        inside = node == k
                        fs = usable[t, int(k)]
                        c, label_of, weight = part[inside][:, fs], y[drawn_here][inside], w[drawn_here, t][inside]
                        keys = np.ravel_multi_index(
                            (np.full(c.shape, t), np.full(c.shape, k), np.broadcast_to(fs, c.shape), c, np.broadcast_to(label_of[:, None], c.shape)), spans
                        )
                        held.append((keys.ravel(), np.repeat(weight, len(fs)).astype(float)))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [joined()]
            if held:
                keys, s = joined()
                parts = np.unravel_index(keys, spans)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, k) for p, k in zip(parts, kinds)] + [pa.array(s)], ["tree", "node", "feature", "bin", "y", "s"]
                )

        sums = table.mapInArrow(count, "tree int, node long, feature int, bin int, y int, s double")
        sums = sums.groupBy("tree", "node", "feature", "bin", "y").agg(F.sum("s").alias("s"))
        growing, level = set(), level + 1
        for r in best_cuts(sums, bins, n_classes, criterion):
            total, left = np.array(r["total"]), np.array(r["left"])
            share[r["tree"], r["node"]] = total / total.sum()
            if r["feature"] < 0:
                continue
            feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = r["feature"], r["bin"]
            for child, counts in ((2 * r["node"], left), (2 * r["node"] + 1, total - left)):
                share[r["tree"], child] = counts / counts.sum()
                if level < depth and (counts > 0).sum() > 1:
                    growing.add((r["tree"], child))
    return Forest(classes, cuts, feature, cut, share)


def forest_scores(model: Forest, x: np.ndarray) -> np.ndarray:
    """Mean share of each class over the trees, in so many digits that ties are ties."""
    codes = binned(x, model.cuts)
    total = np.zeros((len(x), len(model.classes)))
    for feature, cut, share in zip(model.feature, model.bin, model.share):
        total += share[places(codes, feature, cut)]
    return np.round(total / len(model.feature), DIGITS)
