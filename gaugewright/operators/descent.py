"""Linear classifiers by stochastic gradient descent, averaged over chains.

Rows are dealt to chains by the MD5 of their id, and a chain takes its rows in the order of that hash, from the same
weights as all others; after a pass the chains' weights are averaged, each counting as its rows. The number of chains
follows from the number of rows alone, so the result is the same for any partitioning. A chain is a sorted stream: its
task holds one batch of rows and the weights. Rows with a missing label or feature are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.classify import LinearModel
from gaugewright.operators.prep import split_hash
from gaugewright.operators.sums import coded, matrix
from gaugewright.session import materialize

CHAIN_ROWS = 100_000


def slope(loss: str, margin: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the score, for the target +1; ``margin`` is target times score."""
    if loss == "hinge":
        return np.where(margin < 1, -1.0, 0.0)
    if loss == "log_loss":
        return -0.5 * (1 - np.tanh(0.5 * margin))
    if loss == "squared_hinge":
        return -2 * np.maximum(1 - margin, 0.0)
    if loss == "modified_huber":
        return np.where(margin >= 1, 0.0, np.where(margin > -1, -2 * (1 - margin), -4.0))
    if loss == "perceptron":
        return np.where(margin <= 0, -1.0, 0.0)
    if loss == "squared_error":
        return margin - 1
    raise ValueError(f"unknown loss {loss}")


LOSSES = ("hinge", "log_loss", "modified_huber", "squared_hinge", "perceptron", "squared_error")


def linear_sgd(
    df: DataFrame, x: str, label: str, row_id: str, loss: str = "hinge", alpha: float = 1e-4, rate: float = 0.5, passes: int = 5,
    penalty: str = "l2", chain_rows: int = CHAIN_ROWS, seed: int = 42,
) -> LinearModel:
    """One weight vector per class against the rest; intercepts have no penalty.

    Step t of a chain (from 0, counted on over the passes) has the rate ``rate / (1 + alpha * rate * t)``. The penalties l1 and
    elasticnet draw weights towards 0 by the rate times alpha and stop there.
    """
    rows, classes = coded(df, x, label, keep=[F.col(row_id).cast("string").alias("row_id")])
    n = rows.count()
    if not n:
        raise ValueError("a classifier needs complete rows")
    slope(loss, np.zeros(1))
    chains = -(-n // chain_rows)
    placed = rows.withColumn("place", split_hash(F.col("row_id"), seed).cast("long"))
    dealt = materialize(
        placed.withColumn("chain", (F.col("place") % chains).cast("int")).repartition("chain").sortWithinPartitions("chain", "place", "row_id")
    )
    width = 1 + len(dealt.first()["x"])
    weights = np.zeros((len(classes), width))
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}[penalty]
    steps: dict[int, int] = {}

    for _ in range(passes):
        start = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain, w, t = None, start, 0
            out: list[tuple[int, int, np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                xs, ys, cs = matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("chain").to_numpy()
                for x_row, y, c in zip(xs, ys, cs):
                    if c != chain:
                        if chain is not None:
                            out.append((chain, t, w))
                        chain, w, t = int(c), start.copy(), 0
                    eta = rate / (1 + alpha * rate * (t + steps.get(chain, 0)))
                    target = np.where(np.arange(len(w)) == y, 1.0, -1.0)
                    pull = slope(loss, target * (w[:, 0] + w[:, 1:] @ x_row)) * target
                    w[:, 1:] *= 1 - eta * alpha * (1 - l1)
                    w[:, 1:] -= eta * pull[:, None] * x_row
                    w[:, 0] -= eta * pull
                    if l1:
                        w[:, 1:] = np.sign(w[:, 1:]) * np.maximum(np.abs(w[:, 1:]) - eta * alpha * l1, 0.0)
                    t += 1
            if chain is not None:
                out.append((chain, t, w))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in out], pa.int32()), pa.array([t for _, t, _ in out], pa.int64()), pa.array([w.ravel() for _, _, w in out], pa.list_(pa.float64()))],
                ["chain", "n", "w"],
            )

        # The order of a chain is made anew in each pass: a scan may deal the written rows to other tasks.
        sent = dealt.repartition("chain").sortWithinPartitions("chain", "place", "row_id").mapInArrow(run, "chain int, n long, w array<double>")
        parts = sent.select("chain", "n", F.posexplode("w").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
        weights = np.array([r["v"] for r in parts.orderBy("i").collect()]).reshape(weights.shape)
        if not steps:
            steps = {r["chain"]: r["count"] for r in dealt.groupBy("chain").count().collect()}  # a row per CHAIN_ROWS rows
            once = dict(steps)
        else:
            steps = {c: s + once[c] for c, s in steps.items()}
    return LinearModel(classes, weights)
