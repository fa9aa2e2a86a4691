"""Random search that can be stopped and resumed: a table of finished (method, setting, fold) jobs.

Settings are drawn from a method's grid, folds are dealt by a hash inside each label, and every job is fitted by the
passes of this library over the rows outside its fold. Settings that can share passes (all neighbour counts of one
distance, all smoothings, all ridge penalties) are one unit of work. Finished units are appended to the store, a Parquet
table of a row per job; a later call with the same store skips them, so a run cut in two gives what one run gives. A
setting that can't be fitted (too few rows for its neighbours, more features wanted than there are, weights that leave
the numbers) is recorded as NaN with its reason and ranks last. A lost cluster isn't a failed fit: its error ends the
call, and what was finished stays. Rows without a label, a feature or an id take no part; equal ids share a fold's order.

The store and what reaches the driver have a row per job: methods x settings x folds, whatever the rows.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.operators import classify as Y
from gaugewright.operators.descent import LOSSES, linear_sgd
from gaugewright.operators.forest import forest_scores, random_forest
from gaugewright.operators.gram import unpack
from gaugewright.operators.logistic import logistic, logistic_scores
from gaugewright.operators.neighbours import knn_join
from gaugewright.operators.perceptron import perceptron, perceptron_scores
from gaugewright.operators.prep import split_hash
from gaugewright.operators.ranking import ordered_rank
from gaugewright.operators.search import draw_settings
from gaugewright.operators.sums import coded, complete, matrix, vector_sum
from gaugewright.session import materialize

STORE = "dataset string, method string, pos int, params string, fold int, score double, reason string"
#: What a fit that is impossible for its setting raises; other errors end the search.
IMPOSSIBLE = (ValueError, ArithmeticError, np.linalg.LinAlgError)

Scores = Callable[[np.ndarray], np.ndarray]


class Part(NamedTuple):
    """Rows (id, x, label) to learn from and rows to score."""

    train: DataFrame
    test: DataFrame
    n_test: int
    width: int


class Method(NamedTuple):
    grid: dict[str, list]
    fit: Callable[[Part, list[dict]], list[float | Exception]]  # a score per setting, or why there is none
    together: Callable[[dict], Any]  # settings with equal answers share their passes


# ---------------------------------------------------------------- one unit of each method


def accuracy(part: Part, models: list[tuple[list, Scores]]) -> list[float]:
    """Share of rows whose label has the highest score, for several models of the same classes in one pass."""
    classes = models[0][0]
    rows, _ = coded(part.test, "x", "label", classes)

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch.column("x")), batch.column("y").to_numpy()
        return np.array([float((scores(x).argmax(axis=1) == y).sum()) for _, scores in models])

    return [float(h) / part.n_test for h in vector_sum(rows, len(models), partial)]


def finite(weights: np.ndarray) -> np.ndarray:
    if not np.isfinite(weights).all():
        raise ArithmeticError("weights left the numbers")
    return weights


def columns(part: Part) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(part.width)]
    return part.train.select("label", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]), names


def fit_gaussian(part: Part, settings: list[dict]) -> list[float | Exception]:
    """Statistics of the classes once; every smoothing is a model of its own."""
    rows, names = columns(part)
    found = Y.class_sums(rows, names, "label").orderBy("label").collect()  # a row per class
    mean, var = (np.array([[r[f"{c}__{k}"] for c in names] for r in found]) for k in "mv")
    classes, count = [r["label"] for r in found], np.array([r["n"] for r in found], float)
    models = [Y.gaussian_from_sums(classes, count, mean, var, s["var_smoothing"]) for s in settings]
    return list(accuracy(part, [(m.classes, lambda x, m=m: Y.gaussian_scores(m, x)) for m in models]))


def fit_ridge(part: Part, settings: list[dict]) -> list[float | Exception]:
    """Products of the features once; every penalty is solved from them."""
    rows, names = columns(part)
    grams, sums = Y.ridge_sums(rows, names, "label")
    gram = unpack(grams.first()["gram"], 1 + len(names))
    found = sums.orderBy("label").collect()  # a row per class
    counts, inside = np.array([r["n"] for r in found], float), np.array([[r[f"{c}__s"] for c in names] for r in found])
    targets = Y.with_targets(gram, counts, inside)
    weights = [finite(Y.ridge_weights_of(gram, targets, s["alpha"]).T) for s in settings]
    return list(accuracy(part, [([r["label"] for r in found], lambda x, w=w: Y.linear_scores(w, x)) for w in weights]))


def fit_logistic(part: Part, settings: list[dict]) -> list[float | Exception]:
    (s,) = settings
    model = logistic(part.train, "x", "label", c=s["C"] if s["penalty"] == "l2" else 1e8, tolerance=1e-6)
    finite(model.weights)
    return list(accuracy(part, [(model.classes, lambda x: logistic_scores(model, x))]))


def fit_descent(part: Part, settings: list[dict]) -> list[float | Exception]:
    (s,) = settings
    model = linear_sgd(part.train, "x", "label", "id", s["loss"], alpha=s["alpha"], penalty=s["penalty"])
    finite(model.weights)
    return list(accuracy(part, [(model.classes, lambda x: Y.linear_scores(model.weights, x))]))


def fit_forest(part: Part, settings: list[dict]) -> list[float | Exception]:
    (s,) = settings
    wanted = s["max_features"]
    many = {"sqrt": math.isqrt(part.width), "log2": part.width.bit_length() - 1}.get(wanted, wanted)
    if many > part.width:
        raise ValueError(f"{many} features wanted of {part.width}")
    model = random_forest(part.train, "x", "label", "id", s["n_estimators"], s["max_depth"], max(1, many), criterion=s["criterion"])
    return list(accuracy(part, [(model.classes, lambda x: forest_scores(model, x))]))


def fit_perceptron(part: Part, settings: list[dict]) -> list[float | Exception]:
    (s,) = settings
    model = perceptron(
        part.train, "x", "label", tuple(s["hidden_layer_sizes"]), s["alpha"], solver=s["solver"], rate=s["learning_rate_init"],
        momentum=0.9 if s["solver"] == "gd" else 0.0, rounds=s.get("max_iter", 500),
    )
    finite(model.weights)
    return list(accuracy(part, [(model.classes, lambda x: perceptron_scores(model, x))]))


def scaled(df: DataFrame, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """The column x as (x - mean) / spread, followed by y if there is one, in a column vec."""
    kept = [f for f in df.schema.fields if f.name not in ("x", "y")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [(matrix(batch.column("x")) - mean) / spread]
                if "y" in batch.schema.names:
                    parts.append(batch.column("y").to_numpy(zero_copy_only=False)[:, None])
                vec = np.concatenate(parts, axis=1)
                ends = pa.array(np.arange(0, vec.size + 1, vec.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(ends, pa.array(vec.ravel()))], [*[f.name for f in kept], "vec"])

    return df.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "vec array<double>"]))


def fit_neighbours(part: Part, settings: list[dict]) -> list[float | Exception]:
    """Nearest rows by standardized features, found once for the largest count; smaller counts vote among the first.

    Equal distances are ordered by id, equal votes take the smallest class.
    """
    n = part.train.count()
    usable = sorted({s["n_neighbors"] for s in settings if s["n_neighbors"] <= n})
    scores: dict[int, float] = {}
    if usable:
        stats = part.train.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        found = sorted(stats.collect())  # a row per feature
        mean, spread = np.array([r["m"] for r in found], float), np.array([r["s"] or 1.0 for r in found], float)
        classes = [r[0] for r in part.train.select("label").distinct().orderBy("label").collect()]
        donors, _ = coded(part.train, "x", "label", classes, keep=["id"])
        donors = scaled(donors.select("id", F.col("y").cast("double").alias("y"), "x"), mean, spread)
        queries = scaled(part.test.select(F.col("id").alias("qid"), F.lit(part.width).alias("target"), "x"), mean, spread)
        near = knn_join(materialize(queries), materialize(donors), part.width, usable[-1], settings[0]["p"])
        votes = (
            near.select("qid", "nth", "value", F.explode(F.array(*[F.lit(k) for k in usable])).alias("k"))
            .filter("nth <= k").groupBy("qid", "k", "value").agg(F.count("*").alias("votes"))
        )
        chosen = votes.groupBy("qid", "k").agg(F.min_by("value", F.struct(-F.col("votes"), F.col("value"))).cast("int").alias("at"))
        kind = dict(part.train.dtypes)["label"]
        named = chosen.withColumn("pred", F.get(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col("at")))
        hits = named.join(part.test.select(F.col("id").alias("qid"), "label"), "qid").groupBy("k").agg(F.count_if(F.col("pred") == F.col("label")).alias("hits"))
        scores = {r["k"]: r["hits"] / part.n_test for r in hits.collect()}
    return [scores[k] if (k := s["n_neighbors"]) in scores else ValueError(f"{k} neighbours wanted of {n} rows") for s in settings]


# The grids of the searched methods. Values drawn at random from exp(-3) to exp(3) elsewhere lie evenly here.
_EVEN = [round(math.exp(6 * (i + 0.5) / 50 - 3), 6) for i in range(50)]


def _alone(setting: dict) -> str:
    return json.dumps(setting, sort_keys=True)


METHODS = {
    "kNN": Method(
        {"n_neighbors": [1, 3, 5, 10, 15, 20, 30, 50], "algorithm": ["auto", "ball_tree", "kd_tree"], "leaf_size": [10, 20, 30], "p": [1, 2, 3]},
        fit_neighbours, lambda s: s["p"],  # the algorithm and its leaves don't change exact neighbours
    ),
    "RF": Method(
        {"n_estimators": [10, 20, 40, 75, 100, 150], "criterion": ["gini", "entropy"], "max_depth": [10, 5, 3], "max_features": ["sqrt", "log2", 5, 10, 20]},
        fit_forest, _alone,
    ),
    "GNB": Method({"var_smoothing": [1e-5, 1e-6, 1e-7, 1e-8, 1e-9, 1e-10, 1e-11, 1e-12]}, fit_gaussian, lambda s: 0),
    "RR": Method({"alpha": _EVEN}, fit_ridge, lambda s: 0),
    "LR": Method({"penalty": ["l2", None], "C": _EVEN}, fit_logistic, lambda s: _alone(s) if s["penalty"] else ""),
    "SGD": Method({"loss": list(LOSSES), "penalty": ["l2", "l1", "elasticnet"], "alpha": _EVEN}, fit_descent, _alone),
    "MLP": Method(
        {
            "hidden_layer_sizes": [(200,), (100,), (50,), (50, 30), (100, 30), (80, 50), (60, 40, 20)], "solver": ["gd", "lbfgs"],
            "alpha": [0.00001, 0.0001, 0.001, 0.01, 0.1], "learning_rate_init": [0.00001, 0.0001, 0.001, 0.05, 0.01, 0.1, 0.2],
        },
        fit_perceptron, _alone,
    ),
}


# ---------------------------------------------------------------- the search


def stratified_folds(df: DataFrame, row_id: str, x: str, label: str, folds: int, seed: int) -> DataFrame:
    """Complete rows (id, x, label, fold): the rows of a label are dealt in turn, in order of a hash of their id."""
    whole = df.filter(F.col(row_id).isNotNull() & F.col(label).isNotNull() & complete(F.col(x))).select(
        F.col(row_id).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(label).alias("label"), split_hash(F.col(row_id), seed).alias("_h")
    )
    dealt = ordered_rank(whole, ["label"], ["_h", "id"], "_nth")
    return dealt.select("id", "x", "label", (F.col("_nth") % folds).cast("int").alias("fold"))


def finished(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the store; none where it doesn't exist yet."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def search(
    df: DataFrame, x: str, label: str, row_id: str, store: str, dataset: str, methods: dict[str, Method] = METHODS,
    n_iter: int = 50, folds: int = 5, budget: float = math.inf, seed: int = 42, parallel: int = 4,
) -> DataFrame:
    """Scores of all settings whose folds are finished: (dataset, method, pos, params, mean_test_score, std_test_score).

    No unit begins after ``budget`` seconds; up to ``parallel`` units run side by side.
    """
    spark, began = df.sparkSession, time.monotonic()
    drawn = {name: draw_settings(m.grid, n_iter, seed) for name, m in methods.items()}
    own = finished(spark, store).filter((F.col("dataset") == dataset) & F.col("method").isin(list(methods)))
    done = {(r["method"], r["params"], r["fold"]) for r in own.select("method", "params", "fold").collect()}  # a row per job
    units: dict[tuple, list[tuple[int, dict]]] = {}
    for name, settings in drawn.items():
        for pos, s in enumerate(settings):
            for fold in range(folds):
                if (name, json.dumps(s), fold) not in done:
                    units.setdefault((name, str(methods[name].together(s)), fold), []).append((pos, s))
    if units and time.monotonic() - began <= budget:
        rows = materialize(stratified_folds(df, row_id, x, label, folds, seed))
        sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # a row per fold
        first = rows.select(F.size("x")).first()
        width = first[0] if first else 0

        def work(key: tuple, jobs: list[tuple[int, dict]]) -> list[tuple]:
            name, _, fold = key
            if time.monotonic() - began > budget:
                return []
            settings = [s for _, s in jobs]
            try:
                if not sizes.get(fold) or len(sizes) < 2:
                    raise ValueError("a fold without rows")
                part = Part(rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold), sizes[fold], width)
                scores = methods[name].fit(part, settings)
            except IMPOSSIBLE as error:
                scores = [error] * len(settings)
            return [
                (dataset, name, pos, json.dumps(s), fold, *((math.nan, str(v)) if isinstance(v, Exception) else (float(v), None)))
                for (pos, s), v in zip(jobs, scores, strict=True)
            ]

        with ThreadPoolExecutor(parallel) as pool:
            begun = [pool.submit(work, key, jobs) for key, jobs in units.items()]
            try:
                for unit in as_completed(begun):
                    if found := unit.result():
                        spark.createDataFrame(found, STORE).coalesce(1).write.mode("append").parquet(store)
            finally:
                pool.shutdown(wait=True, cancel_futures=True)
    return results(finished(spark, store), dataset, drawn, folds)


def results(scores: DataFrame, dataset: str, drawn: dict[str, list[dict]], folds: int) -> DataFrame:
    """Mean and population deviation over the folds of each drawn setting; NaN if a fold failed."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame(
        [(m, i, json.dumps(s)) for m, settings in drawn.items() for i, s in enumerate(settings)], "method string, pos int, params string"
    )
    # A unit that was done twice, by two calls at once, counts once.
    once = scores.filter(F.col("dataset") == dataset).groupBy("dataset", "method", "params", "fold").agg(F.max("score").alias("score"))
    # At most `folds` scores a setting, summed in their order, so that a cut run gives the digits of a whole one.
    listed = once.groupBy("dataset", "method", "params").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    n, zero = F.size("scores"), F.lit(0.0)
    mean = F.aggregate("scores", zero, lambda t, v: t + v) / n
    spread = F.sqrt(F.aggregate("scores", zero, lambda t, v: t + (v - F.col("mean_test_score")) * (v - F.col("mean_test_score"))) / n)
    per = listed.withColumn("n", n).withColumn("mean_test_score", mean).withColumn("std_test_score", spread)
    return per.join(wanted, ["method", "params"]).filter(F.col("n") == folds).select(
        "dataset", "method", "pos", "params", "mean_test_score", "std_test_score"
    )
