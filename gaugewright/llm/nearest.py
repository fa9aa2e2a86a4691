"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one and dealt to cells around centres (k-means on a bounded sample). What is left of a
vector after its centre is rotated at random and kept as one sign bit per dimension, with two correction scalars: its
length, and how well the signs point its way. From the bits a query estimates every inner product in the cells it
visits, with an error bound; only vectors whose upper bound reaches the k-th best lower bound are compared exactly,
in double precision on the original vectors.

The centres and the rotation are fitted on `sample` vectors at most (those with the smallest hash of their id); every
vector is indexed. Nearness is the cosine. Vectors that are null, zero, hold null or non-finite components, have
another length than most of the sample, or have a null id take no part. Ties go to the smaller id; copies of a vector
are all candidates; repeated ids are separate candidates, and a query never finds rows of its own id. Fewer candidates
than k are all returned. Empty tables give empty results.

Cells are cut into chunks of `chunk` vectors and queries into blocks of `block`, so a task holds one of each, however
many rows one cell has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20240613


@dataclass
class Codes:
    """Centres of the cells and the rotation."""

    centres: np.ndarray
    rotation: np.ndarray


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector (doubles) of the rows that take part."""
    own = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull()).filter(
        finite & F.exists("_v", lambda x: x != 0)
    )


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(points: DataFrame, sample: int = 20_000, cells: int | None = None, turns: int = 8) -> Codes | None:
    """Centres by k-means and a random rotation, from a bounded sample."""
    rows = points.orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    if not rows:
        return None
    sizes = pd.Series([len(r["_v"]) for r in rows])
    width = int(sizes.mode().iloc[0])
    x = unit(np.array([r["_v"] for r in rows if len(r["_v"]) == width]))
    rng = np.random.default_rng(SEED)
    k = max(1, min(cells or int(np.sqrt(len(x)) / 2), len(x)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    return Codes(centres, rotation)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def encode(points: DataFrame, codes: Codes) -> DataFrame:
    """Adds cell, packed bits, the length of the rest and the correction scalar."""
    width = codes.rotation.shape[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 4096):
                part = frame.iloc[start : start + 4096]
                x = unit(np.stack(part["_v"].to_numpy()))
                cell = np.argmin(squared(x, codes.centres), axis=1)
                rest = (x - codes.centres[cell]) @ codes.rotation
                length = np.sqrt((rest * rest).sum(axis=1))
                rest /= np.maximum(length, 1e-300)[:, None]
                signs = rest >= 0
                aim = np.where(signs, rest, -rest).sum(axis=1) / np.sqrt(width)
                yield pd.DataFrame({
                    "_id": part["_id"].to_numpy(), "_v": part["_v"].to_numpy(), "cell": cell.astype(np.int32),
                    "bits": [b.tobytes() for b in np.packbits(signs, axis=1)], "length": length, "aim": aim,
                })

    return points.filter(F.size("_v") == width).mapInPandas(
        run, "_id long, _v array<double>, cell int, bits binary, length double, aim double"
    )


def probes(queries: DataFrame, codes: Codes, sizes: np.ndarray, visits: int, enough: int) -> DataFrame:
    """A row per query and visited cell: the nearest cells, and more until they hold enough vectors."""
    width = codes.rotation.shape[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 1024):
                part = frame.iloc[start : start + 1024]
                order = np.argsort(squared(unit(np.stack(part["_v"].to_numpy())), codes.centres), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                n = np.maximum(visits, (held < enough).sum(axis=1) + 1).clip(max=len(sizes))
                rows = np.repeat(np.arange(len(part)), n)
                step = np.concatenate([np.arange(m) for m in n])
                yield pd.DataFrame({
                    "query_id": part["_id"].to_numpy()[rows], "_q": part["_v"].to_numpy()[rows],
                    "cell": order[rows, step].astype(np.int32),
                })

    return queries.filter(F.size("_v") == width).mapInPandas(run, "query_id long, _q array<double>, cell int")


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, the same sum for the same numbers wherever they stand."""
    return (unit(q) * unit(v)).sum(axis=1)


def best(index: pd.DataFrame, queries: pd.DataFrame, codes: Codes, k: int, bound: float) -> pd.DataFrame:
    """The k best of one chunk for each query of a block."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(index) or not len(queries):
        return empty
    index = index.sort_values("_id", kind="stable")
    width = codes.rotation.shape[0]
    centre = codes.centres[int(index["cell"].iloc[0])]
    ids, original = index["_id"].to_numpy(), np.stack(index["_v"].to_numpy())
    packed = np.frombuffer(b"".join(index["bits"]), np.uint8).reshape(len(index), -1)
    signs = np.unpackbits(packed, axis=1, count=width).astype(np.float32) * 2 - 1
    length, aim = index["length"].to_numpy(), np.maximum(index["aim"].to_numpy(), 1e-9)
    own, asked = queries["query_id"].to_numpy(), np.stack(queries["_q"].to_numpy())
    x = unit(asked)
    rest = (x - centre) @ codes.rotation
    away = np.sqrt((rest * rest).sum(axis=1))
    # Cosine = <q, centre> + <q - centre, centre> parts known exactly + <rest of q, rest of v>, the last one estimated.
    unit_v_centre = (unit(original) @ centre)
    slack = length / aim * np.sqrt(np.maximum(1 - aim * aim, 0)) * bound / np.sqrt(max(width - 1, 1))
    out = []
    for i in range(len(x)):
        estimate = (signs @ rest[i].astype(np.float32)) / np.sqrt(width) / aim * length
        middle = estimate + x[i] @ centre + unit_v_centre - centre @ centre
        error = slack * away[i] + 1e-6
        error[length < 1e-12] = 1e-6
        other = ids != own[i]
        if not other.any():
            continue
        low = np.where(other, middle - error, -np.inf)
        floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
        chosen = np.flatnonzero(other & (middle + error >= floor))
        exact = cosines(np.broadcast_to(asked[i], (len(chosen), width)), original[chosen])
        top = np.lexsort((ids[chosen], -exact))[:k]
        out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[chosen][top], "score": exact[top]}))
    return pd.concat(out, ignore_index=True) if out else empty


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    sample: int = 20_000, cells: int | None = None, share: float = 0.9, chunk: int = 8192, block: int = 2048,
    bound: float = 3.0,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    share: part of the cells that a query visits; bound: error bound in standard deviations of the estimate.
    """
    spark = vectors.sparkSession
    points, asked = usable(vectors, key, vector), usable(queries, key, vector)
    codes = fit(points, sample, cells)
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = encode(points, codes)
    # One row per cell; the number of cells is bounded by the sample.
    counted = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([counted.get(c, 0) for c in range(len(codes.centres))])
    visits = max(1, int(np.ceil(share * len(sizes))))
    asks = probes(asked, codes, sizes, visits, 4 * (k + 1))
    chunks = F.element_at(F.array(*[F.lit(int(max(1, -(-s // chunk)))) for s in sizes]), F.col("cell") + 1)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // block))
    # A chunk meets every block of queries, and a query every chunk of the cells it visits.
    left = index.withColumn("chunk", F.pmod(F.xxhash64("_id"), chunks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = asks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))
    )
    keys = ["cell", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda index, queries: best(index, queries, codes, k, bound), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
