"""Alignment, scores, tuning and ensembles of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds, sigmoid
from ..sources.manifest import Files, safe_name

#: Bins in which scores are ordered apart.
BINS = 4096


def submission(predictions: DataFrame, labels: DataFrame, task_type: str, keys: list[str], node: str = "node", mean: float = 0.0,
    std: float = 1.0) -> DataFrame:
    """(keys..., label, prediction): predictions back in the label's scale and on its rows, joined by node.

    A node predicted twice is an error, raised when the rows are read.
    """
    counted = predictions.withColumn("__n", F.count("*").over(Window.partitionBy(node)))
    raw = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("row predicted twice: "),
        F.col(node).cast("string"))).cast("double")).otherwise(F.col("prediction"))
    value = sigmoid(raw) if task_type == "clf" else raw * std + mean
    return labels.join(counted.select(node, value.alias("prediction")), node).select(*keys, node, "label", "prediction")


def write_csv(rows: DataFrame, folder: str, name: str) -> str:
    """Write rows as one CSV file with a header and return its path; rows keep their order."""
    files, scratch = Files(rows.sparkSession), f"{folder}/.{name}.parts"
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(scratch)
    part = next(n for n in files.names(scratch) if n.startswith("part-"))
    files.move(f"{scratch}/{part}", f"{folder}/{name}")
    files.delete(scratch)
    return f"{folder}/{name}"


def score_submission(predictions: DataFrame, truth: DataFrame, task_type: str, db: str, task: str, keys: list[str], folder: str, *,
    offset: int = 0, row: str = "row", mean: float = 0.0, std: float = 1.0, metric: str | None = None, keep: bool = True) -> dict:
    """Align predictions(node, prediction) with truth(row, keys..., label) by node = row + offset, write and score them.

    The file is <db>__<task>.csv, or <db>__<task>.partial.csv where rows of truth have no prediction; the metric's name
    then starts with subset_. Rows are written in the order of `place`, if predictions have it. A row predicted twice, and a
    node that names no row, are errors. A single class has no AUROC (None).
    """
    rows = predictions.withColumn("__row", F.col("node") - offset)
    twice = rows.groupBy("__row").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate prediction of row {twice[0]['__row']}")
    if not rows.join(truth, F.col("__row") == F.col(row), "left_anti").isEmpty():
        raise ValueError("a prediction names no row of the task")
    value = sigmoid("prediction") if task_type == "clf" else F.col("prediction") * std + mean
    met = rows.join(truth, F.col("__row") == F.col(row)).withColumn("prediction", value)
    n, whole = met.count(), truth.count()
    order = ["place"] if "place" in predictions.columns else keys
    name = f"{safe_name(db)}__{safe_name(task)}{'' if n == whole else '.partial'}.csv"
    path = write_csv(met.orderBy(*order).select(*keys, "prediction"), folder, name) if keep else None
    base = metric or ("roc_auc" if task_type == "clf" else "mae")
    score = auroc(met).first()["auroc"] if task_type == "clf" else regression_scores(met).first()[base]
    return {"metric": base if n == whole else f"subset_{base}", "value": score, "n": n, "path": path}


def write_predictions(predictions: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Predictions on one's own data as Parquet: keys and prediction, one row for each key."""
    out = predictions.select(*keys, "prediction")
    if not out.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("duplicate prediction")
    out.write.parquet(path)
    return out.sparkSession.read.parquet(path)


def denormalisation(train: DataFrame, label: str) -> DataFrame:
    """One row (mean, std) of training labels; deviation 0 or unknown is 1."""
    std = F.stddev_samp(label)
    return train.agg(F.avg(label).alias("mean"), F.when(std.isNull() | (std == 0), 1.0).otherwise(std).alias("std"))


def auroc(scored: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "prediction") -> DataFrame:
    """(by..., auroc, n): rank sums with average ranks of ties; null where one class is missing.

    Scores are counted first, so only distinct scores are ordered: bins of scores are added up, and a task orders one bin.
    """
    by = by or []
    ties = scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n"))
    ends = ties.groupBy(*by).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    share = F.try_divide(F.col(score) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    met = ties.join(ends, by) if by else ties.crossJoin(F.broadcast(ends))  # one row
    binned = met.withColumn("__bin", F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int")).drop("__lo", "__hi")
    totals = binned.groupBy(*by, "__bin").agg(F.sum("n").alias("__all"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__bin", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy(*by, "__bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = binned.withColumn("__in", F.coalesce(F.sum("n").over(order), F.lit(0))).join(totals, [*by, "__bin"]).withColumn("below",
        F.col("__in") + F.col("__before"))
    out = below.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("pos").alias("p"),
        F.sum("n").alias("n"))
    negatives = F.col("n") - F.col("p")
    value = F.when((F.col("p") > 0) & (negatives > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * negatives))
    return out.select(*by, value.alias("auroc"), "n")


def regression_scores(scored: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "prediction") -> DataFrame:
    """(by..., mae, nmae, r2, n); nmae divides by the labels' mean absolute deviation from 0, r2 is null for equal labels."""
    by = by or []
    y, p = F.col(label).cast("double"), F.col(score)
    out = scored.groupBy(*by).agg(F.avg(F.abs(y - p)).alias("mae"), F.avg(F.abs(y)).alias("size"), F.sum((y - p) * (y - p)).alias("rest"),
        F.var_pop(y).alias("var"), F.count("*").alias("n"))
    return out.select(*by, "mae", F.try_divide("mae", "size").alias("nmae"),
        (1 - F.try_divide(F.col("rest"), F.col("var") * F.col("n"))).alias("r2"), "n")


def partial_scores(scored: DataFrame, wanted: DataFrame, node: str, metric: str) -> DataFrame:
    """The AUROC of a run, named subset_<metric> where some wanted rows have no prediction."""
    have = scored.select(node).distinct()
    missing = wanted.select(node).distinct().join(have, node, "left_anti").agg(F.count("*").alias("missing"))
    return auroc(scored).join(F.broadcast(missing)).select(F.when(F.col("missing") > 0,
        F.lit(f"subset_{metric}")).otherwise(F.lit(metric)).alias("metric"), F.col("auroc").alias("value"), "n")


def best_config(scores: DataFrame, by: list[str], config: str, value: str, larger: bool) -> DataFrame:
    """(by..., config, value): the best configuration, the smallest among equals."""
    order = F.struct((F.col(value) if larger else -F.col(value)).alias("v"), (-F.col(config)).alias("c"))
    return scores.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(config, order).alias(config),
        F.max_by(value, order).alias(value))


def ensemble(predictions: DataFrame, row: list[str]) -> DataFrame:
    """(row..., prediction, members): the mean over context seeds."""
    return predictions.groupBy(*row).agg(F.avg("prediction").alias("prediction"), F.count("*").alias("members"))


def mean_scores(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(value).alias(value), F.count("*").alias("tasks"))


def task_audit(labels: DataFrame, nodes: DataFrame, parents: DataFrame, entity: str, time: str, row: str, offset: int) -> DataFrame:
    """(check, found), all 0 where a label split and its encoded rows agree: labels(row, entity, time), nodes(node_id, ts) and
    parents(child, parent_row) of the split, row 0 being node `offset`.

    Counted are label rows without an entity or time, rows on one side only, times that differ by a second or more, and
    rows whose parent is not the entity's row position.
    """
    mine = labels.select((F.col(row) + offset).alias("node_id"), F.col(entity).cast("long").alias("entity"), seconds(time).alias("__ts"),
        F.col(time).alias("__time"))
    met = mine.join(nodes.select("node_id", "ts"), "node_id")
    linked = mine.join(parents.withColumnRenamed("child", "node_id"), "node_id", "left")
    checks = [
        ("null entity or time", mine.where("entity IS NULL OR __time IS NULL")),
        ("label without node", mine.join(nodes, "node_id", "left_anti")),
        ("node without label", nodes.join(mine, "node_id", "left_anti")),
        ("other time", met.where("NOT (ts <=> __ts)")),
        ("other parent", linked.where("entity IS NOT NULL AND NOT (parent_row <=> entity)")),
    ]
    out = None
    for name, df in checks:
        one = df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found")
        out = one if out is None else out.unionByName(one)
    return out


def alignment_audit(tables: dict[str, DataFrame], manifest, positions: bool = False) -> DataFrame:
    """(check, table, found): rows without a key, keys held twice and foreign keys without a parent; all should be 0.

    With positions=True keys must count rows from 0, as foreign keys by position ask for.
    """
    out = None

    def add(check: str, name: str, df: DataFrame) -> None:
        nonlocal out
        one = df.agg(F.count("*").alias("found")).select(F.lit(check).alias("check"), F.lit(name).alias("table"), "found")
        out = one if out is None else out.unionByName(one)

    for name, df in tables.items():
        t = manifest.table(name)
        if t.pkey and positions:
            n = df.agg(F.count("*").alias("__rows"))
            add("key off position", name, df.crossJoin(F.broadcast(n)).where((F.col(t.pkey) < 0)
                | (F.col(t.pkey) >= F.col("__rows"))))  # one row
        if t.pkey:
            add("null key", name, df.where(F.col(t.pkey).isNull()))
            add("double key", name, df.groupBy(t.pkey).count().where("count > 1"))
        if t.time_col:
            add("null time", name, df.where(F.col(t.time_col).isNull()))
        for fk, parent in t.fkeys.items():
            if parent in tables:
                keys = tables[parent].select(F.col(manifest.table(parent).pkey).alias("__p"))
                add(f"orphan {fk}", name, df.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__p"), "left_anti"))
    return out
