"""Cross-validation folds that keep groups together."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.joins import join_groups
from gaugewright.operators.ranking import ordered_rank


def balance(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy balancing of groups given as (size, how many), largest size first.

    Each group goes to the lightest fold, ties to the lowest number.  While many groups of one size are
    dealt, the folds that are less than one size above the lightest take turns, so a whole run is described
    by few phases ``(size, first, last + 1, turn order)`` over the position of a group among its equals.
    """
    loads = [0] * k
    phases = []
    for size, many in sorted(sizes, reverse=True):
        done = 0
        while done < many:
            low = min(loads)
            turn = sorted((f for f in range(k) if loads[f] < low + size), key=lambda f: (loads[f], f))
            waiting = [loads[f] for f in range(k) if loads[f] >= low + size]
            rounds = (min(waiting) - low) // size if waiting else many
            dealt = min(rounds * len(turn), many - done)
            phases.append((size, done, done + dealt, turn))
            full, rest = divmod(dealt, len(turn))
            for i, f in enumerate(turn):
                loads[f] += size * (full + (1 if i < rest else 0))
            done += dealt
    return phases


def group_kfold(df: DataFrame, group: str, k: int = 5, keys=()) -> DataFrame:
    """Fold of every group: ``(keys, group, n, fold)``; equal sizes are dealt in descending name order.

    Only the histogram of group sizes leaves the executors.  Its rows are distinct sizes that add up to the
    row count N at most, so there are fewer than sqrt(2 N) of them per key.
    """
    keys = list(keys)
    groups = df.groupBy(*keys, group).agg(F.count("*").alias("n"))
    ranked = ordered_rank(groups, [*keys, "n"], [F.col(group).desc()])
    histogram = defaultdict(list)
    for row in ranked.groupBy(*keys, "n").agg(F.count("*").alias("many")).collect():
        histogram[tuple(row[c] for c in keys)].append((row["n"], row["many"]))
    phases = [(*key, *phase) for key, sizes in histogram.items() for phase in balance(sizes, k)]
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["n long, start long, stop long, turn array<int>"])
    turns = df.sparkSession.createDataFrame(phases, schema)
    inside = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    return join_groups(ranked, turns, [*keys, "n"], "inner").filter(inside).select(
        *keys, group, "n", F.get("turn", (F.col("rank") - F.col("start")) % F.size("turn")).alias("fold")
    )
