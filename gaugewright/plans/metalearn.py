"""Meta-learning: predicting the indices of algorithms on unseen data sets.

All linear regressors are solved from sums of products per (algorithm, fold), and regression trees are grown from sums
per (algorithm, fold, distinct features), so the rows are read once for the sums and once per round of predictions,
whatever the number of regressors, properties and folds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.names import base_dataset
from gaugewright.functions.scalars import ZERO_INDEX
from gaugewright.operators.folds import group_kfold
from gaugewright.operators.gram import REGRESSORS, fit, packed_grams, unpack
from gaugewright.operators.index import idx
from gaugewright.operators.joins import join_groups
from gaugewright.operators.trees import TREE, cell_sums, grow_all, tree_values
from gaugewright.session import materialize

N_FOLDS = 5
CHUNK_ROWS = 20000
SCALES = ("index", "value", "recalc_value")
ROW_ID = ("configuration", "environment")


def select_regressor(errors: DataFrame, keys) -> DataFrame:
    """Regressor with the smallest mean absolute error per key; equal errors take the first name."""
    return errors.groupBy(*keys).agg(
        F.min_by("regr", F.struct("mae", "regr")).alias("regr"), F.min("mae").alias("mae")
    )


def design_table(rated: DataFrame, references: DataFrame, metafeatures: DataFrame, properties, environments) -> DataFrame:
    """One row per measurement: encoded features, index and value targets, reference values.

    The vector is (1, meta-features, an indicator per named environment but the first).  A data set without
    meta-features has zeros.  ``usable`` marks the rows with all properties; only they are learned from.
    """
    features = [c for c in metafeatures.columns if c != "dataset"]
    levels = list(environments)[1:]
    needed = [p.key for p in properties] + [idx(p.key) for p in properties]
    usable = reduce(Column.__and__, [F.col(c).isNotNull() for c in needed])
    joined = join_groups(rated.withColumn("_usable", usable), metafeatures, ["dataset"])
    joined = join_groups(joined, references, ["dataset", "task", "environment"])
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    x += [(F.col("environment") == e).cast("double") for e in levels]
    return joined.select(
        *ROW_ID, "dataset", "task", "model", F.array(*x).alias("x"),
        F.array(*[F.col(idx(p.key)) for p in properties], *[F.col(p.key).cast("double") for p in properties]).alias("y"),
        F.array(*[F.col(f"{p.key}__ref").cast("double") for p in properties]).alias("ref"),
        F.lit(len(levels)).alias("plain"), F.col("_usable").alias("usable"),
    )


SET_MARK = "\x1f"  # parts feature set and algorithm in one key


def design_sets(rated: DataFrame, references: DataFrame, sets: dict[str, DataFrame], properties, environments) -> DataFrame:
    """Design rows of several feature sets at once: the set becomes a part of the algorithm's name.

    Vectors of narrower sets are filled with zeros in front of the environments; constant columns take no part in a fit.
    All sets are so learned by the same jobs.
    """
    widest = max(len(s.columns) for s in sets.values()) - 1
    levels = len(list(environments)) - 1
    parts = []
    for name, features in sets.items():
        own = len(features.columns) - 1
        filled = F.concat(
            F.slice("x", 1, 1 + own), F.array_repeat(F.lit(0.0), widest - own), F.slice("x", 2 + own, levels) if levels else F.array().cast("array<double>")
        )
        one = design_table(rated, references, features, properties, environments)
        parts.append(one.withColumn("x", filled).withColumn("model", F.concat(F.lit(name + SET_MARK), "model")))
    return reduce(DataFrame.unionByName, parts)


def split_sets(found: DataFrame) -> DataFrame:
    """The feature set and the algorithm of results learned from `design_sets`."""
    parts = F.split("model", SET_MARK)
    return found.select(parts[0].alias("feature_set"), *[(parts[1].alias("model") if c == "model" else F.col(c)) for c in found.columns])


def add_folds(design: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Outer fold per algorithm and base data set, and inner fold of the rows outside outer fold 0."""
    based = design.withColumn("base", base_dataset(F.col("dataset")))
    outer = group_kfold(based, "base", k, ["model"]).select("model", "base", "fold")
    placed = materialize(join_groups(based, outer, ["model", "base"], "inner"))
    inner = group_kfold(placed.filter("fold <> 0"), "base", k, ["model"]).select(
        "model", "base", F.col("fold").alias("inner")
    )
    return materialize(join_groups(placed, inner, ["model", "base"]).withColumn("inner", F.coalesce("inner", F.lit(-1))))


def _real(pred, ref, maximize):
    """Predicted indices (rows, properties) as property values."""
    pred = np.where(pred == 0, ZERO_INDEX, pred)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(maximize, pred * ref, ref / pred)


def _picks(part: pd.DataFrame) -> pd.DataFrame:
    """The chosen regressors that travel with the sums of an algorithm."""
    listed = [dict(r) if isinstance(r, dict) else r.asDict() for r in part["picks"].iloc[0]] if len(part) else []
    return pd.DataFrame(listed, columns=["scale", "property", "regr"])


def _both(x: np.ndarray, weights, trees, by_tree) -> np.ndarray:
    """Predictions of all targets, each by its weights or by its tree."""
    by_tree = np.asarray(by_tree, bool)
    pred = x @ np.asarray(weights).reshape(x.shape[1], -1)
    if by_tree.any():
        grown = np.asarray(trees).reshape(len(by_tree), -1, 3)
        pred[:, by_tree] = tree_values(grown[by_tree], x[:, 1:])
    return pred


def _chunks(rows: DataFrame, models: DataFrame, chunk_rows: int = CHUNK_ROWS):
    """Cut the rows of an algorithm into chunks of bounded size and give each chunk its own copy of the
    algorithm's (small) models."""
    sizes = rows.groupBy("model").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    chunked = join_groups(rows, sizes, ["model"], "inner").withColumn("chunk", F.pmod(F.xxhash64(*ROW_ID), F.col("chunks")).cast("int"))
    copied = join_groups(models, sizes, ["model"], "inner").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return chunked.drop("chunks").groupBy("model", "chunk"), copied.drop("chunks").groupBy("model", "chunk")


def meta_learn(design: DataFrame, properties, k: int = N_FOLDS) -> tuple[DataFrame, DataFrame]:
    """Predictions ``(configuration, environment, model, scale, property, train_pred, test_pred, train_err,
    test_err)`` and the chosen regressors.

    Scale ``index`` learns indices, ``value`` learns values, ``recalc_value`` turns predicted indices into
    values.  Errors are prediction - truth, for ``recalc_value`` truth - prediction.  Rows that are not usable have
    NULL predictions and errors.
    """
    left_out = design.filter("NOT usable")
    design = design.filter("usable").drop("usable")
    keys = [p.key for p in properties]
    t = len(keys)
    maximize = np.array([p.maximize for p in properties])
    first = design.select(F.size("x").alias("p"), "plain").first()
    p, plain = first["p"] - 1, first["plain"]
    width = 1 + p + 2 * t
    names = [*REGRESSORS, TREE]
    placed = add_folds(design, k)
    grams = materialize(packed_grams(placed.select("model", "fold", "inner", F.concat("x", "y").alias("v")), ["model", "fold", "inner"], "v"))

    def without(part: pd.DataFrame, fold: str) -> tuple[list, np.ndarray]:
        """Sums of the training part of every fold."""
        held = {f: sum(unpack(g, width) for g in rows["gram"]) for f, rows in part.groupby(fold)}
        total = sum(held.values())
        train = {f: total - g for f, g in held.items() if total[0, 0] - g[0, 0] >= 1}
        return list(train), np.array(list(train.values()))

    def trees(cells: pd.DataFrame, fold: str, folds: list) -> list[np.ndarray]:
        """Trees of all targets, for the training part of every fold."""
        x, s, q = (np.stack(cells[c].to_numpy()) for c in ("x", "s", "q"))
        n, own = cells["n"].to_numpy(float), cells[fold].to_numpy()
        return [grow_all(x[own != f, 1:], n[own != f], s[own != f], q[own != f]) for f in folds]

    # solving is heavy for its few rows, so algorithms are spread over a fixed number of tasks
    tasks = int(design.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = materialize(cell_sums(placed, ["model", "fold", "inner"], "x", "y", 2 * t))
    by_model = grams.repartition(tasks, "model").groupBy("model")
    cells_by_model = cells.repartition(tasks, "model").groupBy("model")

    # 1. all regressors on the inner folds of the first training part
    def solve_inner(part: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        columns = ["model", "inner", "weights", "trees"]
        part, cells = part[part["fold"] != 0], cells[cells["fold"] != 0]
        if not len(part):
            return pd.DataFrame(columns=columns)
        folds, train = without(part, "inner")
        if not folds:
            return pd.DataFrame(columns=columns)
        weights = fit(train, p, list(REGRESSORS.values()), plain)
        grown = [g.ravel() for g in trees(cells, "inner", folds)]
        return pd.DataFrame({"model": part["model"].iloc[0], "inner": folds, "weights": [w.ravel() for w in weights], "trees": grown})

    inner_models = by_model.cogroup(cells_by_model).applyInPandas(solve_inner, "model string, inner int, weights array<double>, trees array<double>")

    def inner_errors(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in models.iterrows():
            test = rows[rows["inner"] == one["inner"]]
            if not len(test):
                continue
            x, y, ref = (np.stack(test[c].to_numpy()) for c in ("x", "y", "ref"))
            weights = np.asarray(one["weights"]).reshape(len(REGRESSORS), p + 1, 2 * t)
            grown = np.asarray(one["trees"]).reshape(2 * t, -1, 3)
            for name, pred in zip(names, [*(x @ w for w in weights), tree_values(grown, x[:, 1:])]):
                real = _real(np.clip(pred[:, :t], 0, 1), ref, maximize)
                for scale, error in (("index", y[:, t:] - real), ("value", pred[:, t:] - y[:, t:])):
                    out += [
                        {"model": one["model"], "scale": scale, "property": key, "regr": name, "sae": s, "n": len(test)}
                        for key, s in zip(keys, np.abs(error).sum(axis=0))
                    ]
        return pd.DataFrame(out, columns=["model", "scale", "property", "regr", "sae", "n"])

    left, right = _chunks(placed.filter("fold <> 0").select("model", "inner", "x", "y", "ref", *ROW_ID), inner_models)
    sums = left.cogroup(right).applyInPandas(inner_errors, "model string, scale string, property string, regr string, sae double, n long")
    errors = sums.groupBy("model", "scale", "property", "regr").agg((F.sum("sae") / F.sum("n")).alias("mae"))
    chosen = materialize(select_regressor(errors, ["model", "scale", "property"]))

    # 2. the chosen regressor on the outer folds
    def solve_outer(part: pd.DataFrame, picks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        columns = ["model", "fold", "weights", "trees", "by_tree"]
        if not len(part):
            return pd.DataFrame(columns=columns)
        folds, train = without(part, "fold")
        if not folds:
            return pd.DataFrame(columns=columns)
        pick = {(r.scale, r.property): r.regr for r in picks.itertuples()}
        wanted = [pick.get((scale, key), names[0]) for scale in ("index", "value") for key in keys]
        used = sorted(set(wanted) - {TREE}) or names[:1]
        solved = fit(train, p, [REGRESSORS[u] for u in used], plain)
        weights = np.stack([solved[:, used.index(name if name != TREE else used[0]), :, column] for column, name in enumerate(wanted)], axis=-1)
        by_tree = [name == TREE for name in wanted]
        grown = [g.ravel() for g in trees(cells, "fold", folds)] if any(by_tree) else [np.zeros(0)] * len(folds)
        return pd.DataFrame({
            "model": part["model"].iloc[0], "fold": folds, "weights": [w.ravel() for w in weights], "trees": grown, "by_tree": [by_tree] * len(folds),
        })

    picks = chosen.groupBy("model").agg(F.collect_list(F.struct("scale", "property", "regr")).alias("picks"))
    outer_models = join_groups(grams, picks, ["model"], "inner").repartition(tasks, "model").groupBy("model").cogroup(cells_by_model).applyInPandas(
        lambda part, cells: solve_outer(part.drop(columns="picks"), _picks(part), cells),
        "model string, fold int, weights array<double>, trees array<double>, by_tree array<boolean>",
    )

    def predict(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(models):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x, y, ref = (np.stack(rows[c].to_numpy()) for c in ("x", "y", "ref"))
        folds = models["fold"].to_numpy()
        preds = np.stack([_both(x, *one) for one in zip(models["weights"], models["trees"], models["by_tree"])])
        own = folds[:, None] == rows["fold"].to_numpy()[None, :]
        test = np.where(own[:, :, None], preds, 0).sum(axis=0) / np.maximum(own.sum(axis=0), 1)[:, None]
        test[own.sum(axis=0) == 0] = np.nan
        train = np.where(own[:, :, None], 0, preds).sum(axis=0) / np.maximum((~own).sum(axis=0), 1)[:, None]
        train[(~own).sum(axis=0) == 0] = np.nan
        by_scale = {
            "index": (np.clip(train[:, :t], 0, 1), np.clip(test[:, :t], 0, 1), y[:, :t], 1.0),
            "value": (train[:, t:], test[:, t:], y[:, t:], 1.0),
        }
        a, b = by_scale["index"][:2]
        by_scale["recalc_value"] = (_real(a, ref, maximize), _real(b, ref, maximize), y[:, t:], -1.0)
        out = []
        for scale, (tr, te, truth, sign) in by_scale.items():
            for j, key in enumerate(keys):
                out.append(pd.DataFrame({
                    "configuration": rows["configuration"], "environment": rows["environment"], "dataset": rows["dataset"],
                    "task": rows["task"], "model": rows["model"], "scale": scale, "property": key, "train_pred": tr[:, j], "test_pred": te[:, j],
                    "train_err": sign * (tr[:, j] - truth[:, j]), "test_err": sign * (te[:, j] - truth[:, j]),
                }))
        return pd.concat(out)

    schema = (
        "configuration string, environment string, dataset string, task string, model string, scale string, property string, "
        "train_pred double, test_pred double, train_err double, test_err double"
    )
    left, right = _chunks(placed.select(*ROW_ID, "dataset", "task", "model", "fold", "x", "y", "ref"), outer_models)
    predicted = left.cogroup(right).applyInPandas(predict, schema)
    cells = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(k).alias("property")) for s in SCALES for k in keys])
    none = [F.lit(None).cast("double").alias(c) for c in ("train_pred", "test_pred", "train_err", "test_err")]
    unknown = left_out.select(*ROW_ID, "dataset", "task", "model", F.inline(cells)).select(*predicted.columns[:7], *none)
    return predicted.unionByName(unknown), chosen
