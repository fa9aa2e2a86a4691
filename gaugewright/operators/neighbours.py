"""Exact nearest neighbours without comparing every row with every row.

Donor rows are put into cells.  Bounds on the distance between a query and a cell, taken from a small table
of cell statistics, tell which cells can hold one of its k nearest rows; only those are visited.  Neighbouring
cells form groups, to which a query is sent once with the cells that it visits.  Groups are cut into chunks of
bounded size, so a hot cell spreads over many tasks, and a chunk reports no more than k rows per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.scalars import DIGITS
from gaugewright.operators.closest import Closest, distances
from gaugewright.operators.prep import split_hash
from gaugewright.operators.quantiles import exact_positions
from gaugewright.operators.sums import matrix
from gaugewright.session import materialize

CHUNK_ROWS = 2048
GROUP_ROWS = 1 << 15  # donors of a chunk that holds several cells
BLOCK_QUERIES = 1 << 14  # queries of a task
PACKET_ROWS = 1 << 12
CELLS = 64
TILE = 1 << 14  # sums of a tile, and donors of a block: small enough for the cache
BLOCK = 1 << 12


def minkowski(p: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            total += np.abs(a[:, j, None] - b[None, :, j]) ** p
        return total ** (1.0 / p)

    return distance


def power_sums(a: np.ndarray, columns: np.ndarray, p: int) -> np.ndarray:
    """Sums of |a - b| ** p of all rows of a with all of b (given by columns), up to the last digits of their type."""
    if p == 2:
        return (a * a).sum(axis=1)[:, None] + (columns * columns).sum(axis=0) - 2.0 * (a @ columns)
    sums = np.empty((len(a), columns.shape[1]), a.dtype)
    for start in range(0, columns.shape[1], BLOCK):
        block = np.ascontiguousarray(columns[:, start : start + BLOCK])
        total = np.zeros((len(a), block.shape[1]), a.dtype)
        gap, power = np.empty_like(total), np.empty_like(total)
        for j, column in enumerate(block):
            np.abs(np.subtract(a[:, j, None], column, out=gap), out=gap)
            if p == 1:
                total += gap
            else:
                np.multiply(gap, gap, out=power)
                for _ in range(p - 2):
                    power *= gap
                total += power
        sums[:, start : start + BLOCK] = total
    return sums


def closest_rows(query: np.ndarray, donor: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k closest donors of each query as (query, donor, distance), equal distances in the donors' order.

    Sums of powers pick the rows that can be among them, whatever the last digits; only these are measured.  For other
    powers than 2 the sums are taken in single precision, around the donors' mean.
    """
    many, width = donor.shape
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if not many:
        return found[0]

    def norms(x: np.ndarray) -> np.ndarray:
        return (np.abs(x) ** p).sum(axis=1) ** (1.0 / p)

    center = donor.mean(axis=0)
    columns, single = np.ascontiguousarray(donor.T), np.ascontiguousarray((donor - center).T.astype("float32"))
    fine, coarse = np.finfo("float64").eps, np.finfo("float32").eps
    far, raw = norms(donor - center).max(), norms(donor).max()
    tile = max(1, 16 * TILE // many) if p == 2 else 16
    for start in range(0, len(query), tile):
        some = query[start : start + tile]
        with np.errstate(over="ignore", invalid="ignore"):  # sums beyond the numbers leave all rows in
            sums = power_sums(some, columns, 2) if p == 2 else power_sums((some - center).astype("float32"), single, p)
            kth = np.maximum(np.partition(sums, min(k, many) - 1, axis=1)[:, min(k, many) - 1], 0.0).astype("float64")
            if p == 2:  # a difference of squares, whose error grows with them
                slack = 8.0 * (width + 4) * fine * ((some * some).sum(axis=1) + raw * raw)
                limit = (np.sqrt(kth + slack) + 2.0 * 10.0**-DIGITS) ** 2 * (1.0 + 1e-12) + slack
            else:  # errors of the numbers, then of sums of terms of one sign
                slack = 4.0 * coarse * (norms(some - center) + far) + 8.0 * fine * (norms(some) + raw)
                limit = ((kth ** (1.0 / p) + slack) * (1.0 + 4.0 * (width + 2 * p + 8) * coarse) + 2.0 * 10.0**-DIGITS) ** p
                limit = (limit * (1.0 + 16.0 * p * coarse)).astype("float32")
            at, near = np.nonzero(~(sums > limit[:, None]))
        total = np.zeros(len(at))
        for j in range(width):
            total += np.abs(some[at, j] - columns[j, near]) ** p
        found.append((at + start, near, np.round(total ** (1.0 / p), DIGITS)))
    return first_k(*(np.concatenate(c) for c in zip(*found)), k)


def first_k(at: np.ndarray, near: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by distance and donor, without those at no finite distance."""
    usable = np.isfinite(dist)
    at, near, dist = at[usable], near[usable], dist[usable]
    order = np.lexsort((near, dist, at))
    at, near, dist = at[order], near[order], dist[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return at[kept], near[kept], dist[kept]


def closest_in_cells(
    query: np.ndarray, visits: np.ndarray, sizes: np.ndarray, donor: np.ndarray, cell: np.ndarray, k: int, p: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`closest_rows`, each query among the donors of the cells that it visits (``sizes`` of them)."""
    cells, place = np.unique(cell, return_inverse=True)
    visiting = np.zeros((len(query), len(cells)), bool)
    column = np.minimum(np.searchsorted(cells, visits), max(0, len(cells) - 1))
    known = cells[column] == visits if len(cells) else np.zeros(len(visits), bool)
    visiting[np.repeat(np.arange(len(query)), sizes)[known], column[known]] = True
    if visiting.all():
        return closest_rows(query, donor, k, p)
    found = []
    for c in range(len(cells)):
        who, rows = np.flatnonzero(visiting[:, c]), np.flatnonzero(place == c)
        at, near, dist = closest_rows(query[who], donor[rows], k, p)
        found.append((who[at], rows[near], dist))
    return first_k(*(np.concatenate(f) for f in zip(*found)), k)


def nan_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the common columns, scaled up to all columns; NaN without a common one."""
    total, common = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        both = ~np.isnan(gap)
        total += np.where(both, gap, 0.0) ** 2
        common += both
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(total * a.shape[1] / common)


def _chunked(df: DataFrame, hash_on: list[str], chunk: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Add a chunk number so that no (group, chunk) has many more than ``rows`` rows; also the chunk counts,
    one row per group."""
    sizes = df.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{chunk}s"))
    numbered = df.join(F.broadcast(sizes), "grp").withColumn(
        chunk, F.pmod(F.xxhash64(*hash_on), F.col(f"{chunk}s")).cast("int")
    )
    return numbered.drop(f"{chunk}s"), sizes


def candidates(
    queries: DataFrame, donors: DataFrame, width: int, k: int, distance: Callable | int, rows: int = CHUNK_ROWS, per: int = 1
) -> DataFrame:
    """Up to k donors of every query and chunk, the k nearest donors among them: ``(qid, target, dist, id, value)``.

    ``queries`` has (qid, target, vec, cells), ``donors`` (id, vec, cell); ``per`` consecutive cells form a group.
    The first ``width`` entries of a vector are compared, by a Minkowski distance of the given power or by a
    function of two matrices; ``target`` is the entry whose donor value is wanted, donors without it are skipped.
    """
    donor_rows, donor_chunks = _chunked(donors.withColumn("grp", F.expr(f"cell div {per}")), ["id"], "chunk", rows)
    packed_donors = donor_rows.repartition("grp", "chunk").groupBy("grp", "chunk").agg(F.collect_list(F.struct("id", "vec", "cell")).alias("d")).select(
        "grp", "chunk", F.col("d.id").alias("ids"), F.flatten("d.vec").alias("dvec"), F.col("d.cell").alias("dcells")
    )
    visits = queries.select("qid", "target", "vec", "cells", F.explode(F.expr(f"array_distinct(transform(cells, c -> c div {per}))")).alias("grp"))
    visits = visits.withColumn("cells", F.expr(f"filter(cells, c -> c div {per} = grp)"))
    query_rows, _ = _chunked(visits, ["qid", "target"], "qchunk", CHUNK_ROWS if per > 1 else rows)
    packed_queries = query_rows.groupBy("grp", "qchunk").agg(F.collect_list(F.struct("qid", "target", "vec", "cells")).alias("q")).select(
        "grp", F.col("q.qid").alias("qids"), F.col("q.target").alias("targets"), F.flatten("q.vec").alias("qvec"),
        F.flatten("q.cells").alias("visits"), F.expr("transform(q.cells, c -> size(c))").alias("sizes"),
    )
    # the donor chunk is part of the join key: chunks of one group meet their queries in different tasks
    visiting = packed_queries.join(F.broadcast(donor_chunks), "grp").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    pairs = visiting.join(packed_donors, ["grp", "chunk"]).select("qids", "targets", "qvec", "visits", "sizes", "ids", "dvec", "dcells")

    def measured(query, donor, targets, row, cell):
        """Places of query and donor, and their distance."""
        if callable(distance):
            dist = np.round(distance(query[:, :width], donor[:, :width]), DIGITS)
            dist = np.where(np.isnan(donor[:, targets].T) | np.isnan(dist), np.inf, dist)
            order = np.argsort(dist, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(query)), order.shape[1])
            return first_k(at, order.ravel(), dist[at, order.ravel()], k)
        visits, sizes = np.asarray(row.visits), np.asarray(row.sizes)
        owner, found = np.repeat(np.arange(len(query)), sizes), []
        able, asked = np.isfinite(donor[:, :width]).all(axis=1), np.isfinite(query[:, :width]).all(axis=1)
        for target in np.unique(targets):
            who = np.flatnonzero(asked & (targets == target))
            have = np.flatnonzero(able & ~np.isnan(donor[:, target]))
            at, near, dist = closest_in_cells(
                query[who, :width], visits[np.isin(owner, who)], sizes[who], donor[have, :width], cell[have], k, distance
            )
            found.append((who[at], have[near], dist))
        return tuple(np.concatenate(f) for f in zip(*found))

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.asarray(row.ids)
                by_id = np.argsort(ids, kind="stable")
                ids, donor = ids[by_id], np.asarray(row.dvec).reshape(len(ids), -1)[by_id]
                query, targets = np.asarray(row.qvec).reshape(len(row.qids), -1), np.asarray(row.targets)
                at, near, dist = measured(query, donor, targets, row, np.asarray(row.dcells)[by_id])
                yield pd.DataFrame({
                    "qid": np.asarray(row.qids)[at], "target": targets[at], "dist": dist, "id": ids[near], "value": donor[near, targets[at]],
                })

    schema = f"qid {dict(queries.dtypes)['qid']}, target int, dist double, id {dict(donors.dtypes)['id']}, value double"
    return pairs.mapInPandas(closest, schema)


def nearest(
    queries: DataFrame, donors: DataFrame, width: int, k: int, distance: Callable | int, rows: int = CHUNK_ROWS, per: int = 1
) -> DataFrame:
    """The k nearest donors of every query, see `candidates`.  Equal distances are ordered by donor id."""
    # at most k rows per visited chunk and query are left
    nearest_first = Window.partitionBy("qid", "target").orderBy("dist", "id")
    found = candidates(queries, donors, width, k, distance, rows, per)
    return found.withColumn("_n", F.row_number().over(nearest_first)).filter(F.col("_n") <= k).drop("_n")


# ---------------------------------------------------------------- complete vectors: pivots


def pivot_cells(donors: DataFrame, width: int, p: int, cells: int = CELLS) -> tuple[np.ndarray, DataFrame]:
    """Pivot vectors (a fixed number of donors, chosen by hash) and the donors with nearest pivot and distance.

    Donors with a gap among the compared entries are left out; ``whole`` says that the other entries have none either.
    """
    chosen = donors.filter("vec IS NOT NULL").orderBy(split_hash(F.col("id"), 0), "id").limit(cells).select("vec").collect()
    pivots = np.array([r["vec"][:width] for r in chosen], float).reshape(-1, width)
    pivots = pivots[np.isfinite(pivots).all(axis=1)] if np.isfinite(pivots).all(axis=1).any() else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = matrix(batch.column("vec"))
            able = np.flatnonzero(np.isfinite(vec[:, :width]).all(axis=1))
            dist, rows = distances(vec[able, :width], pivots, p), batch.take(pa.array(able))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(dist.argmin(axis=1), pa.int32()), pa.array(dist.min(axis=1)), pa.array(~np.isnan(vec[able, width:]).any(axis=1))],
                [*rows.schema.names, "cell", "radius", "whole"],
            )

    schema = f"id {dict(donors.dtypes)['id']}, vec array<double>, cell int, radius double, whole boolean"
    return pivots, donors.filter("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(assign, schema)


def _blocks(queries: DataFrame, width: int, p: int, pivots: np.ndarray, number: np.ndarray, near: np.ndarray, far: np.ndarray) -> DataFrame:
    """Queries packed by nearest pivot: (block, qids, targets, qvec, cells), with the cells that a block visits."""
    kind, tasks = dict(queries.dtypes)["qid"], queries.sparkSession.sparkContext.defaultParallelism
    many = queries.count()
    parts = max(1, -(-many // BLOCK_QUERIES), min(tasks, -(-many // CHUNK_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec = matrix(batch.column("vec"))[:, :width]
                rows = batch.take(pa.array(np.flatnonzero(np.isfinite(vec).all(axis=1))))
                home = distances(vec[np.isfinite(vec).all(axis=1)], pivots, p).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home, pa.int32())], [*rows.schema.names, "home"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, block = [], 0, 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            vec = np.ascontiguousarray(matrix(rows.column("vec"))[:, :width], "<f8")
            visited = np.zeros(len(number), bool)
            for start in range(0, len(vec), CHUNK_ROWS):
                dist = distances(vec[start : start + CHUNK_ROWS], pivots[number], p)
                within = (dist + near).min(axis=1, keepdims=True)
                visited |= (dist - far <= within * (1 + 1e-9) + 1e-6).any(axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows.column("part")[0].as_py() << 32 | block], pa.int64()), _listed(rows.column("qid")), _listed(rows.column("target")),
                 pa.array([vec.tobytes()], pa.binary()), _listed(pa.array(number[visited], pa.int32()))],
                ["block", "qids", "targets", "qvec", "cells"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= BLOCK_QUERIES:
                yield packed()
                held, many, block = [], 0, block + 1
        if held:
            yield packed()

    asked = queries.filter("vec IS NOT NULL").select("qid", F.col("target").cast("int").alias("target"), F.col("vec").cast("array<double>").alias("vec"))
    placed = asked.mapInArrow(place, f"qid {kind}, target int, vec array<double>, home int").repartitionByRange(parts, "home", F.xxhash64("qid"))
    return materialize(placed.withColumn("part", F.spark_partition_id().cast("long")).drop("home").mapInArrow(
        pack, f"block long, qids array<{kind}>, targets array<int>, qvec binary, cells array<int>"
    ))


def _listed(column: pa.Array) -> pa.Array:
    """One row that holds the column."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def knn_join(
    queries: DataFrame, donors: DataFrame, width: int, k: int, p: int = 2, cells: int = CELLS, rows: int = GROUP_ROWS
) -> DataFrame:
    """Exact k nearest donors under a Minkowski distance, pruned by the triangle inequality.

    ``queries`` has (qid, target, vec), ``donors`` (id, vec), the result (qid, target, dist, id, value, nth), nth from 1.  A task holds a block of queries and what is nearest to
    them so far, and reads packets of donors, those of cells that a query of the block visits.  Where there are fewer
    blocks than tasks, the packets of a block are dealt to several, if it meets more than ``rows`` donors.  Rows with a
    gap take no part, nor do donors without the wanted entry; equal distances are ordered by donor id.
    """
    spark, kind, asking = queries.sparkSession, dict(donors.dtypes)["id"], dict(queries.dtypes)["qid"]
    schema = f"qid {asking}, target int, dist double, id {kind}, value double"
    pivots, placed = pivot_cells(donors, width, p, cells)
    placed = materialize(placed.sortWithinPartitions("cell"))  # read for the statistics and for the comparison
    # one row per pivot: outermost donor, and the k-th closest one if there are that many
    kth = exact_positions(placed.filter("whole"), ["cell"], "radius", [lambda n: f"least({k}, {n}) - 1"], "r")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("whole").alias("wholes"), F.max("radius").alias("far"))
    stats = counts.join(kth, "cell", "left").collect()
    if not stats:
        return spark.createDataFrame([], f"{schema}, nth int")
    number = np.array([s["cell"] for s in stats])
    near = np.array([s["r"][0] if s["wholes"] >= k else np.inf for s in stats])
    far = np.array([s["far"] for s in stats])
    packed = _blocks(queries, width, p, pivots, number, near, far)
    visits = sorted((r["block"], r["cells"]) for r in packed.select("block", "cells").collect())  # a row per block, a block's cells at most
    if not visits:
        return spark.createDataFrame([], f"{schema}, nth int")
    visitors = {c: np.array([i for i, (_, visited) in enumerate(visits) if c in visited], int) for c in number.tolist()}
    tasks = spark.sparkContext.defaultParallelism
    sides = max(1, min(tasks // len(visits), -(-sum(s["n"] for s in stats) // rows)))

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, turn = min(rows, PACKET_ROWS), 0
        for batch in batches:
            cell, start = batch.column("cell").to_numpy(), 0
            ends = np.flatnonzero(np.diff(cell)) + 1
            while start < len(cell):
                stop = min(start + most, len(cell))
                whole = ends[(ends > start + most // 4) & (ends <= stop)]
                stop = int(whole[-1]) if len(whole) and stop < len(cell) else stop
                some, turn = batch.slice(start, stop - start), turn + 1
                inside = np.unique(cell[start:stop])
                blocks = np.unique(np.concatenate([visitors[c] for c in inside.tolist()]))
                side = (turn + some.column("part")[0].as_py()) % sides
                if len(blocks):
                    yield pa.RecordBatch.from_arrays(
                        [_listed(pa.array(blocks * sides + side, pa.int32())), _listed(some.column("id")), _listed(pa.array(inside, pa.int32())),
                         pa.array([np.ascontiguousarray(matrix(some.column("vec")), "<f8").tobytes()], pa.binary())],
                        ["tasks", "ids", "dcells", "dvec"],
                    )
                start = stop

    sent = placed.select("id", "vec", "cell", F.spark_partition_id().alias("part")).mapInArrow(
        packets, f"tasks array<int>, ids array<{kind}>, dcells array<int>, dvec binary"
    ).withColumn("task", F.explode("tasks")).withColumn("later", F.lit(1)).drop("tasks")
    first = (F.array_position(F.array(*[F.lit(b) for b, _ in visits]), F.col("block")).cast("int") - 1) * sides
    asked = packed.select(F.explode(F.sequence(first, first + (sides - 1))).alias("task"), "qids", "targets", "qvec", F.lit(0).alias("later"))
    met = asked.unionByName(sent, allowMissingColumns=True).repartitionById(len(visits) * sides, "task").sortWithinPartitions("task", "later")
    spread, center = pivots.std(axis=0), pivots.mean(axis=0)

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            for target, _, qids, best in held:
                best.settle()
                for start in range(0, len(best.at), PACKET_ROWS):
                    some = slice(start, start + PACKET_ROWS)
                    at = best.at[some]
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(at)), pa.array(np.full(len(at), target), pa.int32()), pa.array(best.dist[some]), best.ids[some], pa.array(best.value[some])],
                        ["qid", "target", "dist", "id", "value"],
                    )

        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column("later")[i].as_py():
                    yield from found()
                    held, query = [], np.frombuffer(batch.column("qvec")[i].as_buffer(), "<f8").reshape(-1, width)
                    targets, qids = batch.column("targets")[i].values.to_numpy(), batch.column("qids")[i].values
                    dist = distances(query, pivots[number], p)
                    within = (dist + near).min(axis=1) * (1 + 1e-9) + 1e-6
                    for target in np.unique(targets).tolist():
                        who = np.flatnonzero(targets == target)
                        held.append((target, dist[who] - far, qids.take(pa.array(who)), Closest(query[who], k, p, within[who], center, spread)))
                    continue
                ids = batch.column("ids")[i].values
                donor = np.frombuffer(batch.column("dvec")[i].as_buffer(), "<f8").reshape(len(ids), -1)
                inside = np.isin(number, batch.column("dcells")[i].values.to_numpy())
                for target, least, _, best in held:
                    have = np.flatnonzero(~np.isnan(donor[:, target]))
                    best.feed(np.ascontiguousarray(donor[have, :width]), donor[have, target], ids.take(pa.array(have)), least[:, inside].min(axis=1))
        yield from found()

    found = met.select("later", "qids", "targets", "qvec", "ids", "dcells", "dvec").mapInArrow(closest, schema)
    nearest_first = Window.partitionBy("qid", "target").orderBy("dist", "id")  # at most k rows a side are left
    return found.repartition("qid").withColumn("nth", F.row_number().over(nearest_first)).filter(F.col("nth") <= k)


def knn_classify(
    train: DataFrame, test: DataFrame, features: str, label: str, row_id: str, k: int = 5, p: int = 2,
    width: int | None = None,
) -> DataFrame:
    """Majority class (an integer) of the k nearest training rows; equal votes take the smallest class."""
    width = width or len(train.select(features).first()[0])
    donors = train.select(F.col(row_id).alias("id"), F.concat(F.col(features), F.array(F.col(label).cast("double"))).alias("vec"))
    queries = test.select(F.col(row_id).alias("qid"), F.lit(width).alias("target"), F.col(features).alias("vec"))
    found = knn_join(queries, donors, width, k, p)
    votes = found.groupBy("qid", "value").agg(F.count("*").alias("votes"))
    return votes.groupBy("qid").agg(F.min_by("value", F.struct(-F.col("votes"), F.col("value"))).cast("int").alias("pred")).withColumnRenamed("qid", row_id)


# ---------------------------------------------------------------- vectors with gaps: boxes


def knn_impute(
    df: DataFrame, row_id: str, columns: list[str], k: int = 10, cells: int = CELLS, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Fill gaps with the mean of the k nearest rows that have the column (distance over common columns).

    With fewer donors all are used, without any the mean of the column.  Cells are ranges of the widest
    column that has no gaps; a box of minima and maxima per cell bounds the distances.
    """
    columns = list(columns)
    d = len(columns)
    overview = df.agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"{c}__n") for c in columns],
        *[F.var_pop(c).alias(f"{c}__v") for c in columns], *[F.avg(c).alias(f"{c}__m") for c in columns],
    ).first()
    whole = [c for c in columns if overview[f"{c}__n"] == overview["n"]]
    means = {c: overview[f"{c}__m"] for c in columns}
    gaps = [c for c in columns if c not in whole]
    if not gaps:
        return df
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    if whole:
        axis = max(whole, key=lambda c: overview[f"{c}__v"])
        # the cut points only shape the cells, so a sketch is enough
        cuts = df.agg(F.percentile_approx(F.col(axis).cast("double"), [i / cells for i in range(1, cells)], 1000)).first()[0]
        cell = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(axis).cast("double")))
    else:
        cell = F.lit(0)
    placed = df.withColumn("cell", cell)
    boxes = placed.groupBy("cell").agg(
        *[F.min(c).cast("double").alias(f"{c}__lo") for c in columns],
        *[F.max(c).cast("double").alias(f"{c}__hi") for c in columns], *[F.count(c).alias(f"{c}__n") for c in columns],
    ).collect()  # one row per cell
    number = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{c}__{e}"] for c in columns] for b in boxes], dtype=float) for e in ("lo", "hi"))
    enough = np.array([[b[f"{c}__n"] >= k for c in columns] for b in boxes])
    always = np.array([c in whole for c in columns])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            query = np.stack(batch["vec"])[:, None, :]
            have = ~np.isnan(query)
            outside = np.maximum(np.maximum(low - query, query - high), 0.0)
            widest = np.maximum(np.abs(query - low), np.abs(query - high))
            least = np.sqrt(d / have.sum(axis=2) * np.where(always, outside, 0.0).__pow__(2).sum(axis=2))
            most = np.where(have & ~np.isnan(widest), widest, 0.0)
            most = np.sqrt(d / max(always.sum(), 1) * (most**2).sum(axis=2)) if always.any() else np.full(least.shape, np.inf)
            usable = enough[:, batch["target"].to_numpy()].T
            within = np.where(usable, most, np.inf).min(axis=1, keepdims=True)
            batch["cells"] = [number[r].astype("int32") for r in least <= within + 1e-6]
            yield batch

    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(columns.index(c))) for c in gaps]), lambda i: i.isNotNull()
    )
    queries = placed.select(F.col(row_id).alias("qid"), F.explode(missing).alias("target"), vec.alias("vec"))
    schema = ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", cells array<int>"
    donors = placed.select(F.col(row_id).alias("id"), vec.alias("vec"), "cell")
    found = nearest(queries.mapInPandas(visit, schema), donors, d, k, nan_euclidean, rows)
    filled = found.groupBy(F.col("qid").alias(row_id)).agg(*[
        F.avg(F.when(F.col("target") == columns.index(c), F.col("value"))).alias(f"{c}__fill") for c in gaps
    ])
    return df.join(filled, row_id, "left").withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__fill"), F.lit(means[c])) for c in gaps
    }).select(*df.columns)
