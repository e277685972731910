"""From label rows to scores: contexts, the labels they show, features, a predictor, metrics by context size.

Extension points: a featurizer gives (node_id, features...) of label rows, or nothing; a predictor turns visible train sets
into one prediction for each target and context size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators import evaluate as V
from ..operators import predict as P
from ..operators.history import spread
from .tasks import RunLog

BY = ["target", "ctx_size"]


class Featurizer(Protocol):
    """Features of label rows by node, or None where a predictor needs none."""

    def __call__(self, nodes: DataFrame) -> DataFrame | None: ...


class Predictor(Protocol):
    """(target, ctx_size, prediction) from rows (target, ctx_size, is_target, label, features...)."""

    def __call__(self, sets: DataFrame, features: list[str], task_type: str) -> DataFrame: ...


def mean_predictor(sets: DataFrame, features: list[str], task_type: str) -> DataFrame:
    means = sets.groupBy(*BY).agg(F.avg(F.when(~F.col("is_target"), F.col("label"))).alias("mean"))
    return means.select(*BY, F.coalesce("mean", F.lit(P.DEFAULTS[task_type])).alias("prediction"))


def linear_predictor(sets: DataFrame, features: list[str], task_type: str) -> DataFrame:
    return P.regression_prediction(sets, features, task_type, by=BY)


def ridge_predictor(sets: DataFrame, features: list[str], task_type: str) -> DataFrame:
    return P.ridge_prediction(sets, features, task_type, by=BY)


def identity_predictor(sets: DataFrame, features: list[str], task_type: str) -> DataFrame:
    """The first feature as it is."""
    return sets.where("is_target").select(*BY, F.col(features[0]).cast("double").alias("prediction"))


PREDICTORS: dict[str, Callable] = {"mean": mean_predictor, "linear": linear_predictor, "ridge": ridge_predictor,
    "identity": identity_predictor}


@dataclass(frozen=True)
class Setting:
    """How contexts are made and read; parents(node, parents array) restricts labels to the target's own entity."""

    table: str
    column: str
    task_type: str
    sizes: tuple[int, ...]
    depth: int = 2
    width: int | None = None
    local: int | None = None
    seed: int = 0
    leakage: tuple[str, ...] = field(default=())


def predictions(nodes: DataFrame, edges: DataFrame, cells: DataFrame, targets: DataFrame, setting: Setting, predictor: Predictor,
    featurizer: Featurizer | None = None, similar: DataFrame | None = None, fallback: DataFrame | None = None,
    parents: DataFrame | None = None) -> DataFrame:
    """(target, ctx_size, prediction) of every target at every size; the default where a context shows nothing."""
    context = A.contexts(nodes, edges, cells, targets, setting.column, length=max(setting.sizes), depth=setting.depth, width=setting.width,
        local=setting.local, similar=similar, fallback=fallback, seed=setting.seed, leakage=list(setting.leakage))
    sets = A.visible_sets(context, setting.table, setting.column, list(setting.sizes))
    if parents is not None:
        sets = A.matching(sets, parents, targets)
    every = targets.select("target", "node", F.explode(F.array(*map(F.lit, setting.sizes))).alias("ctx_size"))
    own = every.select(*BY, "node", F.lit(True).alias("is_target"), F.lit(None).cast("double").alias("label"))
    rows = own.unionByName(sets.select(*BY, "node", F.lit(False).alias("is_target"), F.col("label").cast("double").alias("label")))
    features = featurizer(rows.select(F.col("node").alias("node_id")).distinct()) if featurizer else None
    names = [] if features is None else [c for c in features.columns if c != "node_id"]
    if features is not None:
        rows = rows.join(spread(features.withColumnRenamed("node_id", "node")), "node", "left")
    return predictor(rows, names, setting.task_type)


def scores(predicted: DataFrame, truth: DataFrame, task_type: str) -> DataFrame:
    """(ctx_size, metric, value, n) against truth(target, label)."""
    met = predicted.join(spread(truth.select("target", "label")), "target").where("label IS NOT NULL")
    if task_type == "clf":
        return V.auroc(met, ["ctx_size"]).select("ctx_size", F.lit("roc_auc").alias("metric"), F.col("auroc").alias("value"), "n")
    return V.regression_scores(met, ["ctx_size"]).select("ctx_size", F.lit("mae").alias("metric"), F.col("mae").alias("value"), "n")


def run(nodes: DataFrame, edges: DataFrame, cells: DataFrame, targets: DataFrame, truth: DataFrame, setting: Setting, predictor: Predictor,
    log: RunLog | None = None, **more) -> list[dict]:
    """Predict and score; a line for each context size, also in the log."""
    log = log or RunLog()
    with log.stage("predict and score"):
        rows = scores(predictions(nodes, edges, cells, targets, setting, predictor, **more), truth,
            setting.task_type).orderBy("ctx_size").collect()
    for r in rows:
        log.metric(**r.asDict())
    return [r.asDict() for r in rows]


def ensemble(nodes: DataFrame, edges: DataFrame, cells: DataFrame, targets: DataFrame, setting: Setting, predictor: Predictor,
    seeds: list[int], fallbacks: Callable[[int], DataFrame], **more) -> DataFrame:
    """(target, ctx_size, prediction, members): the mean over contexts drawn with several seeds."""
    out = None
    for s in seeds:
        one = predictions(nodes, edges, cells, targets, Setting(**{**setting.__dict__, "seed": s}), predictor, fallback=fallbacks(s),
            **more)
        out = one if out is None else out.unionByName(one)
    return V.ensemble(out, BY)


def tuned(scored: DataFrame, task_type: str) -> DataFrame:
    """(task, config, value): each task's best configuration on its validation rows scored(task, config, value)."""
    return V.best_config(scored, ["task"], "config", "value", larger=task_type == "clf")


def knn_seeds(vectors: DataFrame, targets: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """(target, seed, rank): the k rows most like each target among those no later; vectors(node_id, ts, vector)."""
    from ..operators.similarity import nearest

    asked = vectors.join(targets.select(F.col("node").alias("node_id")), "node_id", "left_semi")
    found = nearest(asked, vectors, k, "node_id", vector, time="ts")
    return targets.select("target", F.col("node").alias("query")).join(found, "query").select("target", F.col("node_id").alias("seed"),
        "rank")


def latest_first(seeds: DataFrame, times: DataFrame) -> DataFrame:
    """Seeds(target, seed, rank) ranked anew by time, none last, then by rank; times(seed, ts)."""
    order = Window.partitionBy("target").orderBy(F.desc_nulls_last("ts"), "rank", "seed")
    return seeds.join(times, "seed").withColumn("rank", F.row_number().over(order)).select("target", "seed", "rank")
