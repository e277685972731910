"""Synthesised features, in-context predictions, scores and audits over the star schema; set operations and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dfs as D
from ..operators import evaluate as V
from ..operators import history as H
from ..operators import predict as P
from ..operators import store as ST
from .contexts import _sources
from .features import _CUTS, _LABELS, churn_labels
from .tables import ORDER_CUTOFFS, STAR, rounded, table


def _paths(spark: SparkSession, sf: str) -> list[D.Path]:
    lines = D.Path("line", table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate"), "l_orderkey", time="l_shipdate",
        numbers=("l_quantity",))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return [D.Path("order", orders, "o_custkey", "o_orderkey", "o_orderdate", ("o_totalprice",), ("o_orderpriority",), (lines,))]


def _digits(df: DataFrame) -> DataFrame:
    """Six digits, four for deviations, whose last bits depend on the order of addition."""
    return df.select(*[F.round(c, 4 if "_std" in c else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def dfs_depth1(spark: SparkSession, sf: str) -> DataFrame:
    spine = H.spine_of(table(spark, sf, "customer"), "c_custkey", list(ORDER_CUTOFFS))
    return _digits(D.synthesise(spine, "c_custkey", _paths(spark, sf), 1))


def dfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    spine = H.spine_of(table(spark, sf, "customer"), "c_custkey", list(ORDER_CUTOFFS))
    return _digits(D.synthesise(spine, "c_custkey", _paths(spark, sf), 2))


def _agg(name: str, c: str) -> str:
    return ", ".join(f"round({f}({c})::DOUBLE, {4 if '_std' in f'{name}_{n}_{c}' else 6}) AS {name}_{n}_{c}" for n,
        f in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_samp")))


def _dfs_sql(deep: bool) -> str:
    raw = ", ".join(f"{f}(l_quantity)::DOUBLE AS line_{n}_l_quantity" for n,
        f in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_samp")))
    join = "LEFT JOIN l ON l.k = o_orderkey AND l.c = cutoff" if deep else ""
    more = ", " + ", ".join(_agg("order", c) for c in ("line_count", "line_max_l_quantity", "line_min_l_quantity", "line_mean_l_quantity",
        "line_std_l_quantity")) if deep else ""
    return f"""
WITH t AS (SELECT c_custkey, cutoff FROM customer, (VALUES {_CUTS}) c(cutoff)), m AS (SELECT c_custkey, cutoff, o_orderkey, o_totalprice, o_orderpriority FROM t JOIN orders ON o_custkey = c_custkey AND o_orderdate < cutoff),
l AS (SELECT o_orderkey AS k, cutoff AS c, count(*) AS line_count, {raw} FROM (SELECT DISTINCT o_orderkey, cutoff FROM m) JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < cutoff GROUP BY 1, 2),
pr AS (SELECT c_custkey, cutoff, o_orderpriority, row_number() OVER (PARTITION BY c_custkey, cutoff ORDER BY count(*) DESC, o_orderpriority) AS k FROM m GROUP BY 1, 2, 3),
a AS (SELECT c_custkey, cutoff, count(*) AS order_count, {_agg('order', 'o_totalprice')}{more} FROM m {join} GROUP BY 1, 2)
SELECT t.c_custkey, t.cutoff, a.* EXCLUDE (c_custkey, cutoff), pr.o_orderpriority AS order_mode_o_orderpriority FROM t LEFT JOIN a USING (c_custkey, cutoff) LEFT JOIN pr ON pr.c_custkey = t.c_custkey AND pr.cutoff = t.cutoff AND pr.k = 1
"""


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = churn_labels(spark, sf).select((F.col("c_custkey") * 10000 + F.year("cutoff")).alias("target"),
        F.col("c_custkey").alias("entity"), "cutoff", F.col("churn").cast("double").alias("label"), "spend")
    return rows.select("target", "entity", "cutoff"), rows.select("target", "entity", F.col("cutoff").alias("time"), "label", "spend")


_L = (
    f"SELECT c_custkey * 10000 + year(cutoff) AS target, c_custkey AS entity, cutoff, churn::INTEGER::DOUBLE AS "
    f"label, spend FROM ({_LABELS})"
)
_FEATS = f"""
SELECT t.target, n IS NOT NULL AS same_entity, entity_mean, ln(1 + coalesce(n, 0)::DOUBLE) AS log_entity_count, global_mean FROM ({_L}) t
LEFT JOIN (SELECT a.target, avg(b.label) AS entity_mean, count(*) AS n FROM ({_L}) a JOIN ({_L}) b ON a.entity = b.entity AND b.cutoff < a.cutoff GROUP BY 1) o USING (target)
LEFT JOIN (SELECT a.cutoff, avg(b.label) AS global_mean FROM (SELECT DISTINCT cutoff FROM ({_L})) a JOIN ({_L}) b ON b.cutoff < a.cutoff GROUP BY 1) g ON g.cutoff = t.cutoff
"""


def label_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.label_features(*_labels(spark, sf)))


def pred_entity_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.mean_prediction(P.label_features(*_labels(spark, sf)), "clf", "entity"))


def pred_global_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.mean_prediction(P.label_features(*_labels(spark, sf)), "clf", "global"))


def pred_linear_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's spend at the last cutoff, along a line through its earlier ones."""
    _, labels = _labels(spark, sf)
    rows = labels.withColumn("x", F.year("time").cast("double") - 1997)
    last = F.col("time") == F.lit(ORDER_CUTOFFS[-1]).cast("timestamp_ntz")
    return rounded(P.linear_prediction(rows.where(~last), "entity", "x", "spend", rows.where(last).select("entity", "x"), "x"), 5)


LINEAR_SQL = f"""
WITH l AS (SELECT *, year(cutoff)::DOUBLE - 1997 AS x FROM ({_L})), f AS (SELECT entity, regr_slope(spend, x) AS slope, regr_intercept(spend, x) AS base, avg(spend) AS mean FROM l WHERE cutoff < TIMESTAMP '{ORDER_CUTOFFS[-1]}' GROUP BY 1)
SELECT l.entity, round(coalesce(CASE WHEN isfinite(slope) THEN base + slope * x END, mean, 0.0), 5) AS prediction FROM l LEFT JOIN f USING (entity) WHERE cutoff = TIMESTAMP '{ORDER_CUTOFFS[-1]}'
"""


def pred_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Spend at the last cutoff from each customer's earlier label rows; no SQL can state it."""
    targets, labels = _labels(spark, sf)
    last = F.lit(ORDER_CUTOFFS[-1]).cast("timestamp_ntz")
    rows = labels.select("entity", "time", "spend", F.year("time").cast("double").alias("year"), "label")
    own = rows.where(F.col("time") == last).select(F.col("entity").alias("target"), F.lit(True).alias("is_target"),
        F.lit(None).cast("double").alias("label"), "year", F.col("label").alias("churn"))
    past = rows.where(F.col("time") < last).select(F.col("entity").alias("target"), F.lit(False).alias("is_target"),
        F.col("spend").alias("label"), "year", F.col("label").alias("churn"))
    return P.ridge_prediction(own.unionByName(past), ["year", "churn"], "reg")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    _, labels = _labels(spark, sf)
    return pred_entity_mean(spark, sf).join(labels.select("target", "time", "label", "spend"), "target")


_SCORED = (
    f"SELECT f.target, round(coalesce(entity_mean, global_mean, 0.5), 6) AS prediction, l.cutoff AS time, l.label, "
    f"l.spend FROM ({_FEATS}) f JOIN ({_L}) l USING (target)"
)


def metric_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.auroc(_scored(spark, sf), ["time"]))


AUROC_SQL = f"""
WITH s AS (SELECT *, rank() OVER (PARTITION BY time ORDER BY prediction) + (count(*) OVER (PARTITION BY time, prediction) - 1) / 2.0::DOUBLE AS r FROM ({_SCORED}))
SELECT time, round(CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END, 6) AS auroc, count(*) AS n FROM s GROUP BY 1
"""


def metric_mae_r2(spark: SparkSession, sf: str) -> DataFrame:
    guess = pred_linear_1d(spark, sf).withColumnRenamed("entity", "e")
    _, labels = _labels(spark, sf)
    last = labels.where(F.col("time") == F.lit(ORDER_CUTOFFS[-1]).cast("timestamp_ntz"))
    joined = last.select("entity", F.col("spend").alias("label")).join(guess, F.col("entity") == F.col("e"))
    return rounded(V.regression_scores(joined.withColumn("task", F.lit("spend")), ["task"]), 4)


MAE_SQL = f"""
WITH j AS (SELECT l.spend AS y, p.prediction AS p FROM ({_L}) l JOIN ({LINEAR_SQL}) p USING (entity) WHERE l.cutoff = TIMESTAMP '{ORDER_CUTOFFS[-1]}')
SELECT 'spend' AS task, round(avg(abs(y - p)), 4) AS mae, round(avg(abs(y - p)) / avg(abs(y)), 4) AS nmae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, count(*) AS n FROM j
"""


def tune_grid_best(spark: SparkSession, sf: str) -> DataFrame:
    """Of several shrinkages toward one half, the one with the smallest error at each cutoff."""
    rows = _scored(spark, sf).withColumn("config", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))))
    shrunk = rows.withColumn("p", F.col("prediction") * (1 - F.col("config") / 4.0) + 0.5 * F.col("config") / 4.0)
    scores = shrunk.groupBy("time", "config").agg(F.round(F.avg(F.abs(F.col("label") - F.col("p"))), 6).alias("value"))
    return V.best_config(scores, ["time"], "config", "value", False)


TUNE_SQL = f"""
WITH s AS (SELECT time, config, round(avg(abs(label - (prediction * (1 - config / 4.0::DOUBLE) + 0.5 * config / 4.0::DOUBLE))), 6) AS value FROM ({_SCORED}), (VALUES (0), (1), (2), (3)) v(config) GROUP BY 1, 2)
SELECT time, config, value FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY value, config) AS k FROM s) WHERE k = 1
"""


def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    every = pred_entity_mean(spark, sf).unionByName(pred_global_mean(spark, sf))
    return rounded(V.ensemble(every, ["target"]), 5)


ENSEMBLE_SQL = (
    f"SELECT target, round((round(coalesce(entity_mean, global_mean, 0.5), 6) + round(coalesce(global_mean, 0.5), "
    f"6)) / 2, 5) AS prediction, 2::BIGINT AS members FROM ({_FEATS})"
)


def submission_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Spend at the last cutoff: lines fitted to normalised labels, brought back to the label's scale on the label rows."""
    _, labels = _labels(spark, sf)
    last = F.col("time") == F.lit(ORDER_CUTOFFS[-1]).cast("timestamp_ntz")
    stats = V.denormalisation(labels.where(~last), "spend").first()
    rows = labels.withColumns({"x": F.year("time").cast("double") - 1997, "y": (F.col("spend") - stats["mean"]) / stats["std"]})
    ahead = rows.where(last).select("entity", "x", F.col("target").alias("node"))
    lines = P.linear_prediction(rows.where(~last), "entity", "x", "y", ahead, "x").join(ahead, "entity").select("node", "prediction")
    truth = rows.where(last).select(F.col("target").alias("node"), "entity", "time", F.col("spend").alias("label"))
    return rounded(V.submission(lines, truth, "reg", ["entity", "time"], mean=stats["mean"], std=stats["std"]), 6)


SUBMISSION_SQL = f"""
WITH l AS (SELECT *, year(cutoff)::DOUBLE - 1997 AS x FROM ({_L})), past AS (SELECT * FROM l WHERE cutoff < TIMESTAMP '{ORDER_CUTOFFS[-1]}'),
f AS (SELECT entity, regr_slope(spend, x) AS slope, regr_intercept(spend, x) AS base, avg(spend) AS mean FROM past GROUP BY 1)
SELECT l.entity, l.cutoff AS time, l.target AS node, l.spend AS label, round(coalesce(CASE WHEN isfinite(slope) THEN base + slope * x END, mean, (SELECT avg(spend) FROM past)), 6) AS prediction
FROM l LEFT JOIN f USING (entity) WHERE l.cutoff = TIMESTAMP '{ORDER_CUTOFFS[-1]}'
"""


def pred_least_squares(spark: SparkSession, sf: str) -> DataFrame:
    """Spend at the last cutoff from each customer's earlier label rows, by the linear predictor with one feature."""
    _, labels = _labels(spark, sf)
    last = F.lit(ORDER_CUTOFFS[-1]).cast("timestamp_ntz")
    rows = labels.select(F.col("entity").alias("target"), "time", "spend", (F.year("time").cast("double") - 1997).alias("x"))
    own = rows.where(F.col("time") == last).select("target", F.lit(True).alias("is_target"), F.lit(None).cast("double").alias("label"), "x")
    past = rows.where(F.col("time") < last).select("target", F.lit(False).alias("is_target"), F.col("spend").alias("label"), "x")
    return rounded(P.regression_prediction(own.unionByName(past), ["x"], "reg"), 3)


SQUARES_SQL = f"""
WITH l AS (SELECT *, year(cutoff)::DOUBLE - 1997 AS x FROM ({_L})), n AS (SELECT DISTINCT entity FROM l),
f AS (SELECT entity, regr_slope(spend, x) AS slope, regr_intercept(spend, x) AS base, count(*) AS c, min(spend) AS lo, max(spend) AS hi FROM l WHERE cutoff < TIMESTAMP '{ORDER_CUTOFFS[-1]}' GROUP BY 1)
SELECT entity AS target, round(CASE WHEN coalesce(c, 0) < 2 OR l.x IS NULL THEN 0 WHEN lo = hi THEN lo ELSE base + slope * l.x END, 3) AS prediction
FROM n LEFT JOIN f USING (entity) LEFT JOIN (SELECT entity, x FROM l WHERE cutoff = TIMESTAMP '{ORDER_CUTOFFS[-1]}') l USING (entity)
"""


def metric_auroc_all(spark: SparkSession, sf: str) -> DataFrame:
    """One score over all label rows, its scores ordered bin by bin."""
    return rounded(V.auroc(_scored(spark, sf)))


AUROC_ALL_SQL = f"""
WITH s AS (SELECT *, rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0::DOUBLE AS r FROM ({_SCORED}))
SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auroc, count(*) AS n FROM s
"""


def task_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as label rows against their encoded rows; every count is 0."""
    parts = _sources(spark, sf, ("customer", "orders"))
    at = next(s.offset for s in parts if s.name == "orders")
    nodes = ST.nodes(parts).where("table = 'orders'")
    parents = ST.edges(parts, fk="key").select("child", F.col("parent").alias("parent_row"))  # customers are numbered from 0
    return V.task_audit(table(spark, sf, "orders"), nodes, parents, "o_custkey", "o_orderdate", "o_orderkey", at)


TASK_AUDIT_SQL = (
    "SELECT unnest(['null entity or time', 'label without node', 'node without label', 'other time', 'other "
    "parent']) AS \"check\", 0::BIGINT AS found"
)


def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    long = metric_auroc(spark, sf).select(F.lit("auroc").alias("metric"),
        F.col("auroc").alias("value")).unionByName(metric_mae_r2(spark, sf).select(F.lit("mae").alias("metric"),
        F.col("mae").alias("value")))
    return rounded(V.mean_scores(long, ["metric"]), 4)


def alignment_audit(spark: SparkSession, sf: str) -> DataFrame:
    return V.alignment_audit({n: table(spark, sf, n) for n in STAR.tables}, STAR)


def _audit_sql() -> str:
    out = []
    for t in STAR.tables.values():
        if t.pkey:
            out += [(
                f"SELECT 'null key' AS \"check\", '{t.name}' AS \"table\", count(*) AS found FROM {t.name} WHERE {t.pkey} IS "
                f"NULL"
            ), f"SELECT 'double key', '{t.name}', count(*) FROM (SELECT {t.pkey} FROM {t.name} GROUP BY 1 HAVING count(*) > 1)"]
        if t.time_col:
            out.append(f"SELECT 'null time', '{t.name}', count(*) FROM {t.name} WHERE {t.time_col} IS NULL")
        out += [(
            f"SELECT 'orphan {fk}', '{t.name}', count(*) FROM {t.name} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT "
            f"{STAR.table(p).pkey} FROM {p})"
        ) for fk, p in t.fkeys.items()]
    return " UNION ALL ".join(out)


def orders_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the feature programs: rollup with its grouping level."""
    return rounded(table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"),
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 1)


def customers_without_events(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the feature programs: set difference and intersection, labelled."""
    people, users, buyers = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "events").select("user_id"), table(spark, sf,
        "orders").select("o_custkey")
    return people.subtract(users).withColumn("kind", F.lit("no events")).unionByName(people.intersect(users).intersect(buyers)
        .withColumn("kind", F.lit("events and orders")))


QUERIES = {
    "dfs_depth1": (dfs_depth1, _dfs_sql(False)),
    "dfs_depth2": (dfs_depth2, _dfs_sql(True)),
    "label_features": (label_features, (
        f"SELECT target, same_entity, round(entity_mean, 6) AS entity_mean, round(log_entity_count, 6) AS "
        f"log_entity_count, round(global_mean, 6) AS global_mean FROM ({_FEATS})"
    )),
    "pred_entity_mean": (pred_entity_mean,
        f"SELECT target, round(coalesce(entity_mean, global_mean, 0.5), 6) AS prediction FROM ({_FEATS})"),
    "pred_global_mean": (pred_global_mean, f"SELECT target, round(coalesce(global_mean, 0.5), 6) AS prediction FROM ({_FEATS})"),
    "pred_linear_1d": (pred_linear_1d, LINEAR_SQL),
    "pred_ridge": (pred_ridge, None),
    "pred_least_squares": (pred_least_squares, SQUARES_SQL),
    "metric_auroc_all": (metric_auroc_all, AUROC_ALL_SQL),
    "task_audit": (task_audit, TASK_AUDIT_SQL),
    "metric_auroc": (metric_auroc, AUROC_SQL),
    "metric_mae_r2": (metric_mae_r2, MAE_SQL),
    "metric_means": (metric_means, (
        f"SELECT 'auroc' AS metric, round(avg(auroc), 4) AS value, count(*) AS tasks FROM ({AUROC_SQL}) UNION ALL "
        f"SELECT 'mae', round(avg(mae), 4), count(*) FROM ({MAE_SQL})"
    )),
    "tune_grid_best": (tune_grid_best, TUNE_SQL),
    "ensemble_mean": (ensemble_mean, ENSEMBLE_SQL),
    "submission_rows": (submission_rows, SUBMISSION_SQL),
    "alignment_audit": (alignment_audit, _audit_sql()),
    "orders_rollup": (orders_rollup, (
        "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) "
        "AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"
    )),
    "customers_without_events": (customers_without_events, (
        "SELECT c_custkey, 'no events' AS kind FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events) "
        "UNION ALL SELECT c_custkey, 'events and orders' FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id "
        "FROM events INTERSECT SELECT o_custkey FROM orders)"
    )),
}
