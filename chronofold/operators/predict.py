"""In-context predictors: what a label row's visible labels say about it."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from .history import sums_before

#: What is predicted where nothing is visible.
DEFAULTS = {"clf": 0.5, "reg": 0.0}


def visible_labels(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, own label features): a target's visible labels are the entity's earlier ones.

    labels(entity, time, label); targets(target, entity, cutoff). One join on the entity.
    """
    past = labels.select(F.col("entity").alias("__e"), F.col("time").alias("__t"), "label")
    return targets.join(past, (F.col("entity") == F.col("__e")) & (F.col("__t") < F.col("cutoff"))).select("target", "label")


def label_features(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, same_entity, entity_mean, log_entity_count, global_mean): aggregates of labels before the target.

    Global means come from running sums over the distinct times, so no target meets all labels.
    """
    own = visible_labels(targets, labels).groupBy("target").agg(F.avg("label").alias("entity_mean"), F.count("label").alias("n"))
    overall = means_before(labels, targets.select("cutoff").distinct()).withColumnRenamed("cutoff", "__cutoff")
    out = targets.join(own, "target", "left").join(overall, F.col("cutoff") == F.col("__cutoff"), "left")
    return out.select("target", F.col("n").isNotNull().alias("same_entity"), "entity_mean",
        F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("log_entity_count"), "global_mean")


def means_before(labels: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, global_mean): the mean of all labels(time, label) strictly before each cutoff."""
    counted = labels.select("time", F.col("label").cast("double").alias("s"), F.when(F.col("label").isNotNull(), 1).otherwise(0).alias("c"))
    return sums_before(counted, cutoffs, [], "time", ["s", "c"]).select("cutoff", F.try_divide("s", "c").alias("global_mean"))


def mean_prediction(features: DataFrame, task_type: str, by: str = "entity") -> DataFrame:
    """(target, prediction): the entity's mean, where it has none the global one, where that is missing the default."""
    columns = (["entity_mean"] if by == "entity" else []) + ["global_mean"]
    return features.select("target", F.coalesce(*columns, F.lit(DEFAULTS[task_type])).alias("prediction"))


def linear_prediction(points: DataFrame, by: str, x: str, y: str, at: DataFrame, at_x: str, task_type: str = "reg") -> DataFrame:
    """(by, prediction) at at(by, at_x): each group's least-squares line; fewer than two points or a single x: the mean,
    no point: the default."""
    lines = points.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.avg(y).alias("mean"))
    joined = at.join(lines, by, "left")
    return joined.select(by, F.coalesce(F.col("base") + F.col("slope") * F.col(at_x), "mean",
        F.lit(DEFAULTS[task_type])).alias("prediction"))


def ridge_solution(x: np.ndarray, y: np.ndarray, at: np.ndarray, strength: float, logistic: bool) -> float:
    """Ridge or L2-logistic prediction at one row, columns scaled to the set's mean and deviation."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z, q = (x - mean) / scale, (at - mean) / scale
    if not logistic:
        beta = np.linalg.solve(z.T @ z + strength * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return float(y.mean() + q @ beta)
    full, target = np.column_stack([np.ones(len(z)), z]), np.append(1.0, q)
    penalty = strength * np.eye(full.shape[1])
    penalty[0, 0] = 1e-6
    w = np.zeros(full.shape[1])
    for _ in range(50):  # Newton's method; the problem is convex
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(1 / (1 + np.exp(-np.clip(target @ w, -30, 30))))


def fitted(sets: DataFrame, features: list[str], task_type: str, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], float],
    by: list[str]) -> DataFrame:
    """(by..., prediction) from rows (by..., is_target, label, features...): a small model for each set, in numpy.

    A set with fewer than two labels or without its target gets the default, one whose labels are all equal that label.
    """
    fields = ", ".join(f"`{b}` {sets.schema[b].dataType.simpleString()}" for b in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        known, row = pdf[~pdf.is_target], pdf[pdf.is_target]
        y = known.label.to_numpy(float)
        if len(row) == 0 or len(y) < 2:
            guess = DEFAULTS[task_type]
        elif (y == y[0]).all():
            guess = float(y[0])
        else:
            guess = fit(known[features].to_numpy(float), y, row[features].to_numpy(float)[0])
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "prediction": [guess]})

    return sets.select(*by, "is_target", "label", *features).groupBy(*by).applyInPandas(solve, f"{fields}, prediction double")


def ridge_prediction(sets: DataFrame, features: list[str], task_type: str, strength: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by..., prediction): one small ridge or L2-logistic regression for each set, its missing values 0."""
    fit = lambda x, y, at: ridge_solution(np.nan_to_num(x), y, np.nan_to_num(at), strength, task_type == "clf")
    return fitted(sets, features, task_type, fit, by or ["target"])


def linear_solution(x: np.ndarray, y: np.ndarray, at: np.ndarray, logistic: bool) -> float:
    """Least squares with an intercept, or a logistic model whose weights are held back by half their squares, at one row."""
    if not logistic:
        full = np.column_stack([np.ones(len(x)), x])
        return float(np.append(1.0, at) @ np.linalg.lstsq(full, y, rcond=None)[0])
    full, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.diag(np.append(0.0, np.ones(x.shape[1])))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + penalty @ w
        step = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(w)), slope)
        w -= step * min(1.0, 10.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(1 / (1 + np.exp(-np.clip(np.append(1.0, at) @ w, -30, 30))))


def imputed(features: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without NaN or infinities: a column's mean of finite values stands for them, 0 where it has none."""
    finite = np.isfinite(features)
    sums = np.where(finite, features, 0).sum(0)
    means = np.divide(sums, finite.sum(0), out=np.zeros_like(sums), where=finite.any(0))
    return np.where(finite, features, means), np.where(np.isfinite(row), row, means)


def regression_prediction(sets: DataFrame, features: list[str], task_type: str, by: list[str] | None = None) -> DataFrame:
    """(by..., prediction): a linear or logistic model for each set, missing values imputed."""
    fit = lambda x, y, at: linear_solution(*_ordered(imputed(x, at), y), task_type == "clf")
    return fitted(sets, features, task_type, fit, by or ["target"])


def _ordered(both: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return both[0], y, both[1]


#: Settings of the boosted trees that were tuned on validation labels, alike for both kinds of features and tasks.
TUNED = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


def tuned_settings(task_type: str, override: str | None = None) -> dict:
    """TUNED, or what a JSON file {"clf": {...}, "reg": {...}} says for the task type instead."""
    if override is None:
        return dict(TUNED)
    with open(override, encoding="utf-8") as file:
        return {**TUNED, **json.load(file).get(task_type, {})}


def held_back(train: DataFrame, share: float, seed: int) -> DataFrame:
    """train with `__stop`, true for that share of each label by hash: the rows that tell when to stop."""
    return train.withColumn("__stop", hash_uniform(seed, "target", "label") < share)


def boosted_prediction(train: DataFrame, test: DataFrame, features: list[str], task_type: str, seed: int = 0, stop_share: float = 0.0,
    **options) -> DataFrame:
    """(target, prediction) of gradient-boosted trees fitted on all of train; classes are weighted by their odds.

    With stop_share > 0 that share of the rows decides when adding trees ends.
    """
    if stop_share > 0:
        train, options = held_back(train, stop_share, seed), {**options, "validationIndicatorCol": "__stop"}
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    if task_type == "reg":
        model = GBTRegressor(featuresCol="__x", labelCol="label", seed=seed, **options).fit(pack.transform(train))
        return model.transform(pack.transform(test)).select("target", "prediction")
    odds = train.agg((F.sum(1 - F.col("label")) / F.greatest(F.sum("label"), F.lit(1.0))).alias("w")).first()["w"]
    weighted = train.withColumn("__w", F.when(F.col("label") == 1, float(odds or 1.0)).otherwise(1.0))
    model = GBTClassifier(featuresCol="__x", labelCol="label", weightCol="__w", seed=seed, **options).fit(pack.transform(weighted))
    from pyspark.ml.functions import vector_to_array

    return model.transform(pack.transform(test)).select("target", vector_to_array("probability")[1].alias("prediction"))


def identity_prediction(rows: DataFrame, feature: str) -> DataFrame:
    """(target, prediction): a feature as it is."""
    return rows.select("target", F.col(feature).cast("double").alias("prediction"))
