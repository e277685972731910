"""Contexts, expansions, walks, seeds, relations and nearest vectors over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import context as C
from ..operators import graph as G
from ..operators import similarity
from .features import _LABELS, churn_labels
from .tables import EVENT_FIRST, EVENT_LAST, rounded, table

#: Table codes of node numbers.
CODES = {"customer": 1, "nation": 2, "region": 3, "orders": 4, "events": 5}
_N = lambda t, key: f"({CODES[t]} * {G.SPAN}::BIGINT + {key})"


def node(name: str, key: str):
    return F.lit(CODES[name] * G.SPAN) + F.col(key).cast("long")


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and customers, customers and nations, nations and regions."""
    none = F.lit(None).cast("long")
    orders = table(spark, sf, "orders").select(node("orders", "o_orderkey").alias("child"), node("customer", "o_custkey").alias("parent"),
        S.seconds("o_orderdate").alias("child_ts"))
    people = table(spark, sf, "customer").select(node("customer", "c_custkey").alias("child"),
        node("nation", "c_nationkey").alias("parent"), none.alias("child_ts"))
    nations = table(spark, sf, "nation").select(node("nation", "n_nationkey").alias("child"), node("region", "n_regionkey").alias("parent"),
        none.alias("child_ts"))
    return orders.unionByName(people).unionByName(nations)


EDGES_SQL = f"""
SELECT {_N('orders', 'o_orderkey')} AS child, {_N('customer', 'o_custkey')} AS parent, (epoch_us(o_orderdate) // 1000000)::BIGINT AS child_ts FROM orders
UNION ALL SELECT {_N('customer', 'c_custkey')}, {_N('nation', 'c_nationkey')}, NULL FROM customer UNION ALL SELECT {_N('nation', 'n_nationkey')}, {_N('region', 'n_regionkey')}, NULL FROM nation
"""


def order_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(node("orders", "o_orderkey").alias("seed"),
        S.seconds("o_orderdate").alias("ts")).withColumn("node", F.col("seed"))


_SEEDS = (
    f"SELECT {_N('orders', 'o_orderkey')} AS seed, {_N('orders', 'o_orderkey')} AS node, (epoch_us(o_orderdate) // "
    f"1000000)::BIGINT AS ts FROM orders"
)


def bfs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return G.bfs(order_seeds(spark, sf), graph_edges(spark, sf), 2)


def bfs_width_capped(spark: SparkSession, sf: str) -> DataFrame:
    return G.bfs(order_seeds(spark, sf), graph_edges(spark, sf), 2, width=3, seed=5)


def _bfs_sql(width: int | None) -> str:
    cap = f"QUALIFY row_number() OVER (PARTITION BY seed, via ORDER BY md5('5|' || via || '|' || child), child) <= {width}" if width else ""
    step = lambda f: (
        f"SELECT seed, ts, parent AS node FROM {f} JOIN e ON node = child UNION SELECT seed, ts, child FROM (SELECT "
        f"seed, ts, via, child FROM (SELECT DISTINCT seed, ts, node AS via, child FROM {f} JOIN e ON node = parent "
        f"WHERE child_ts IS NULL OR child_ts <= ts) {cap})"
    )
    return f"""
WITH e AS ({EDGES_SQL}), l0 AS ({_SEEDS}), s1 AS ({step('l0')}), l1 AS (SELECT * FROM s1 WHERE (seed, node) NOT IN (SELECT seed, node FROM l0)),
s2 AS ({step('l1')}), r AS (SELECT seed, node, 0 AS depth FROM l0 UNION ALL SELECT seed, node, 1 FROM l1 UNION ALL SELECT seed, node, 2 FROM s2)
SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2
"""


def bfs_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """The expansion cut where its cells, added up by depth, reach a budget; every node has as many cells as values."""
    reached = bfs_depth2(spark, sf)
    cells = F.when(F.floor(F.col("node") / G.SPAN) == CODES["orders"], 4).when(F.floor(F.col("node") / G.SPAN) == CODES["customer"],
        3).otherwise(1)
    total = F.sum("cells").over(Window.partitionBy("seed").orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, 0))
    return reached.withColumn("cells", cells).withColumn("running", total.cast("long")).where("running < 24").select("seed", "node",
        "depth", "running")


BUDGET_SQL = f"""
SELECT seed, node, depth, running FROM (SELECT *, (sum(CASE node // {G.SPAN} WHEN 4 THEN 4 WHEN 1 THEN 3 ELSE 1 END) OVER (PARTITION BY seed ORDER BY depth, node ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM ({_bfs_sql(None)})) WHERE running < 24
"""


def walk_visits_len3(spark: SparkSession, sf: str) -> DataFrame:
    sources = order_seeds(spark, sf).select(F.col("seed").alias("source"), "ts")
    return rounded(G.visits(sources, graph_edges(spark, sf), 3), 9)


WALK_SQL = f"""
WITH e AS ({EDGES_SQL}), m0 AS (SELECT seed AS source, ts, seed AS node, 1.0::DOUBLE AS p FROM ({_SEEDS})),
step AS (SELECT source, ts, node, p, parent AS t FROM m0 JOIN e ON node = child UNION ALL SELECT source, ts, node, p, child FROM m0 JOIN e ON node = parent WHERE child_ts IS NULL OR ts IS NULL OR child_ts <= ts),
m1 AS (SELECT source, ts, t AS node, sum(p / d) AS p FROM (SELECT *, count(*) OVER (PARTITION BY source, node) AS d FROM step) GROUP BY 1, 2, 3),
step2 AS (SELECT source, ts, node, p, parent AS t FROM m1 JOIN e ON node = child UNION ALL SELECT source, ts, node, p, child FROM m1 JOIN e ON node = parent WHERE child_ts IS NULL OR ts IS NULL OR child_ts <= ts),
m2 AS (SELECT source, ts, t AS node, sum(p / d) AS p FROM (SELECT *, count(*) OVER (PARTITION BY source, node) AS d FROM step2) GROUP BY 1, 2, 3)
SELECT source, node, round(sum(p), 9) AS visits FROM (SELECT source, node, p FROM m1 UNION ALL SELECT source, node, p FROM m2) WHERE node // {G.SPAN} = source // {G.SPAN} AND node <> source GROUP BY 1, 2
"""


def _ranked(spark: SparkSession, sf: str, latest: bool) -> DataFrame:
    times = order_seeds(spark, sf).select("node", "ts")
    return G.ranked_seeds(walk_visits_len3(spark, sf), times, latest, 9)


def seed_rank_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, True)


def seed_rank_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, False)


def _rank_sql(latest: bool) -> str:
    return (
        f"SELECT source, v.node, (row_number() OVER (PARTITION BY source ORDER BY "
        f"{'ts DESC NULLS LAST,' if latest else ''} visits DESC, md5('9|' || source || '|' || v.node), "
        f"v.node))::INTEGER AS rank FROM ({WALK_SQL}) v JOIN ({_SEEDS}) s ON s.node = v.node"
    )


def seed_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked seeds, finished and unfinished orders in turn; orders with a pending label are left out."""
    labels = table(spark, sf, "orders").where("o_orderstatus IN ('F', 'O')").select(node("orders", "o_orderkey").alias("node"),
        (F.col("o_orderstatus") == "F").alias("positive"))
    seeds = seed_rank_latest(spark, sf).join(labels, "node")
    return C.balanced(seeds, "source", "rank", "positive", 3).select("source", "node", "positive", "place")


BALANCED_SQL = f"""
WITH s AS (SELECT r.source, r.node, r.rank, o_orderstatus = 'F' AS positive FROM ({_rank_sql(True)}) r JOIN orders ON {_N('orders', 'o_orderkey')} = r.node AND o_orderstatus IN ('F', 'O')),
k AS (SELECT *, row_number() OVER (PARTITION BY source, positive ORDER BY rank) AS k FROM s),
c AS (SELECT *, (('0x' || substr(md5('3|' || source || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5) AS coin FROM k)
SELECT source, node, positive, (row_number() OVER (PARTITION BY source ORDER BY k, CASE WHEN coin = positive THEN 0 ELSE 1 END))::INTEGER AS place FROM c
"""


def fallback_seeds(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("time"))
    return C.fallback(orders.select(F.col("node").alias("target")), orders, 3, 7)


def fallback_sql(rows: str, count: int, seed: int) -> str:
    """CTEs that give fb(target, node, k) over rows (node, time): hashed places among the rows no later, then the first ones."""
    hashed = f"('0x' || substr(md5('{seed}|' || node || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""
fb_p AS (SELECT node, row_number() OVER (ORDER BY time, node % 64, node) - 1 AS place, count(*) OVER (ORDER BY time RANGE UNBOUNDED PRECEDING) AS upto FROM ({rows})),
fb_d AS (SELECT node AS target, i, floor({hashed} * upto)::BIGINT AS place FROM fb_p, range(1, {3 * count + 1}) t(i)
  UNION ALL SELECT node, {3 * count} + 1 + j, j FROM fb_p, range(0, {count + 1}) t(j) WHERE j < upto),
fb_o AS (SELECT target, place, min(i) AS i FROM fb_d GROUP BY 1, 2),
fb AS (SELECT target, node, k FROM (SELECT target, node, row_number() OVER (PARTITION BY target ORDER BY i) AS k FROM fb_o JOIN fb_p USING (place) WHERE target <> node) WHERE k <= {count})"""


FALLBACK_SQL = f"WITH {fallback_sql('SELECT o_orderkey AS node, o_orderdate AS time FROM orders', 3, 7)} SELECT target, node FROM fb"


def mask_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"),
        F.explode(F.array(*map(F.lit, ("c_name", "c_acctbal", "c_mktsegment")))).alias("col"))
    return C.masked(cells, 0.5, 11, ["col"], "row")


MASK_SQL = """
WITH c AS (SELECT c_custkey AS row, unnest(['c_name', 'c_acctbal', 'c_mktsegment']) AS col FROM customer)
SELECT row, col, ('0x' || substr(md5('11|' || row || '|' || col), 1, 8))::BIGINT / 4294967296.0::DOUBLE < ('0x' || substr(md5('12|' || row), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 0.5 AS masked FROM c
"""


def sample_per_segment(spark: SparkSession, sf: str) -> DataFrame:
    return C.sampled(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 20, 4,
        "c_custkey").select("c_mktsegment", "c_custkey", "draw")


SAMPLE_SQL = (
    "SELECT * FROM (SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
    "md5('4|' || c_custkey), c_custkey))::INTEGER AS draw FROM customer) WHERE draw <= 20"
)


def _event_targets(spark: SparkSession, sf: str) -> DataFrame:
    times = F.expr(f"sequence(TIMESTAMP_NTZ'{EVENT_FIRST}', TIMESTAMP_NTZ'{EVENT_LAST}', INTERVAL 7 DAY)")
    users = table(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct()
    return users.withColumn("cutoff", F.explode(times)).withColumn("target", F.col("entity") * 100 + F.dayofmonth("cutoff"))


_TARGETS = (
    f"SELECT user_id AS entity, cutoff, user_id * 100 + day(cutoff) AS target FROM (SELECT DISTINCT user_id FROM "
    f"events), (SELECT unnest(generate_series(TIMESTAMP '{EVENT_FIRST}', TIMESTAMP '{EVENT_LAST}', INTERVAL 7 DAY)) "
    f"AS cutoff)"
)


def recent_history_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The four latest orders at each user's cutoffs, then their parents."""
    targets = _event_targets(spark, sf)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    met = targets.join(orders, (F.col("entity") == F.col("o_custkey")) & (F.col("o_orderdate") <= F.col("cutoff")))
    top = met.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("o_orderdate"),
        "o_orderkey"))).where("rank <= 4")
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return top.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf, "nation"),
        F.col("c_nationkey") == F.col("n_nationkey"), "left").select("target", "rank", "o_orderkey", "n_name")


TOPK_SQL = f"""
SELECT target, rank::INTEGER AS rank, o_orderkey, n_name FROM (SELECT target, o_orderkey, o_custkey, row_number() OVER (PARTITION BY target ORDER BY o_orderdate DESC, o_orderkey) AS rank
FROM ({_TARGETS}) JOIN orders ON o_custkey = entity AND o_orderdate <= cutoff) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE rank <= 4
"""


def neighborhood_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    targets = _event_targets(spark, sf)
    people = table(spark, sf, "customer")
    nations = table(spark, sf, "nation")
    entities = people.select(F.col("c_custkey").alias("entity"), node("customer", "c_custkey").alias("node"))
    home = people.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey",
        F.array(F.struct(node("nation", "c_nationkey").alias("node"), F.lit(3).alias("depth")),
        F.struct(node("region", "n_regionkey").alias("node"), F.lit(4).alias("depth"))).alias("parents"))
    orders = table(spark, sf, "orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("entity"),
        node("orders", "o_orderkey").alias("node"), F.col("o_orderdate").alias("time"), "parents")
    none = F.array().cast("array<struct<node:bigint,depth:int>>")
    events = table(spark, sf, "events").select(F.col("user_id").alias("entity"), node("events", "event_id").alias("node"),
        F.col("ts").alias("time"), none.alias("parents"), "event_type")
    buys = events.where("event_type = 'purchase'").select("entity", "node", "time")
    return C.neighborhood(targets, entities, buys, [events.drop("event_type"), orders], 3)


ROBIN_SQL = f"""
WITH t AS ({_TARGETS}), e AS (SELECT user_id AS entity, {_N('events', 'event_id')} AS node, ts AS time, event_type FROM events),
lab AS (SELECT target, 1 AS part, row_number() OVER (PARTITION BY target ORDER BY time DESC, node) AS rank, 0 AS source, 0 AS place, node, 2 AS depth FROM t JOIN e USING (entity) WHERE time < cutoff AND event_type = 'purchase'),
ev AS (SELECT target, 2 AS part, row_number() OVER (PARTITION BY target ORDER BY time DESC, node) AS rank, 0 AS source, 0 AS place, node, 2 AS depth FROM t JOIN e USING (entity) WHERE time <= cutoff),
od AS (SELECT target, entity, row_number() OVER (PARTITION BY target ORDER BY o_orderdate DESC, o_orderkey) AS rank, {_N('orders', 'o_orderkey')} AS node FROM t JOIN orders ON o_custkey = entity AND o_orderdate <= cutoff),
od2 AS (SELECT od.*, c_nationkey, n_regionkey FROM od JOIN customer ON c_custkey = entity JOIN nation ON n_nationkey = c_nationkey WHERE rank <= 3),
al AS (SELECT target, 0 AS part, 0 AS rank, 0 AS source, 0 AS place, {_N('customer', 'entity')} AS node, 1 AS depth FROM t UNION ALL SELECT * FROM lab WHERE rank <= 3 UNION ALL SELECT * FROM ev WHERE rank <= 3
  UNION ALL SELECT target, 2, rank, 1, 0, node, 2 FROM od2 UNION ALL SELECT target, 2, rank, 1, 1, {_N('nation', 'c_nationkey')}, 3 FROM od2 UNION ALL SELECT target, 2, rank, 1, 2, {_N('region', 'n_regionkey')}, 4 FROM od2),
f AS (SELECT *, row_number() OVER (PARTITION BY target, node ORDER BY part, rank, source, place) AS k FROM al)
SELECT target, (row_number() OVER (PARTITION BY target ORDER BY part, rank, source, place) - 1)::INTEGER AS pos, node, depth FROM f WHERE k = 1
"""


def context_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.when(F.col("depth") == 2, 4).otherwise(2)
    ordered = neighborhood_round_robin(spark, sf).withColumn("cells", cells)
    return C.budget_prefix(ordered, ["target"], [F.col("pos")], "cells", 20).select("target", "pos", "node",
        F.col("running").cast("long").alias("running"))


PREFIX_SQL = (
    f"SELECT target, pos, node, running FROM (SELECT *, (sum(CASE WHEN depth = 2 THEN 4 ELSE 2 END) OVER (PARTITION "
    f"BY target ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM ({ROBIN_SQL})) WHERE running < 20"
)


def context_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders seen in contexts of several sizes: prefixes of one order."""
    nested = C.nested_sizes(neighborhood_round_robin(spark, sf), "pos", [2, 4, 8, 16])
    return nested.groupBy("target", "ctx_size").agg(F.count("*").alias("nodes"),
        F.count(F.when(F.floor(F.col("node") / G.SPAN) == CODES["orders"], 1)).alias("orders"))


COUNTS_SQL = (
    f"SELECT target, s AS ctx_size, count(*) AS nodes, count(*) FILTER (WHERE node // {G.SPAN} = 4) AS orders FROM "
    f"({ROBIN_SQL}), (VALUES (2), (4), (8), (16)) v(s) WHERE pos < s GROUP BY 1, 2"
)


def historical_seed_order(spark: SparkSession, sf: str) -> DataFrame:
    labels = churn_labels(spark, sf).select(F.col("c_custkey").alias("entity"), "cutoff",
        (F.col("c_custkey") * 10000 + F.year("cutoff")).alias("node"))
    return C.seed_order(labels.select(F.col("node").alias("target"), "entity", "cutoff"),
        labels.select("entity", "node", F.col("cutoff").alias("time")))


SEED_ORDER_SQL = f"""
WITH l AS (SELECT c_custkey AS entity, cutoff, c_custkey * 10000 + year(cutoff) AS node FROM ({_LABELS}))
SELECT t.node AS target, (row_number() OVER (PARTITION BY t.node ORDER BY l.cutoff DESC, l.node))::INTEGER AS rank, l.node FROM l t JOIN l ON l.entity = t.entity AND l.cutoff < t.cutoff
"""


def _context_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of customers' contexts: the customer (3 columns), its orders (4) and its nation (1)."""
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    columns = lambda *names: F.posexplode(F.array(*map(F.lit, names)))
    own = people.select(F.col("c_custkey").alias("target"), F.lit(0).alias("block"), node("customer", "c_custkey").alias("node"),
        F.array(node("nation", "c_nationkey")).alias("parents"), columns("c_name", "c_acctbal", "c_mktsegment").alias("i", "column"))
    home = people.select(F.col("c_custkey").alias("target"), F.lit(1).alias("block"), node("nation", "c_nationkey").alias("node"),
        F.array().cast("array<bigint>").alias("parents"), columns("n_name").alias("i", "column"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("target"), F.lit(2).alias("block"),
        node("orders", "o_orderkey").alias("node"), F.array(node("customer", "o_custkey")).alias("parents"),
        columns("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").alias("i", "column"))
    every = own.unionByName(home).unionByName(orders)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("target").orderBy("block", "node", "i")) - 1).drop("block", "i")


def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.relation_counts(_context_cells(spark, sf))


RELATIONS_SQL = f"""
WITH c AS (SELECT c_custkey AS target, 0 AS block, {_N('customer', 'c_custkey')} AS node, {_N('nation', 'c_nationkey')} AS parent, unnest(['c_name', 'c_acctbal', 'c_mktsegment']) AS col, unnest([0, 1, 2]) AS i FROM customer
  UNION ALL SELECT c_custkey, 1, {_N('nation', 'c_nationkey')}, NULL, 'n_name', 0 FROM customer
  UNION ALL SELECT o_custkey, 2, {_N('orders', 'o_orderkey')}, {_N('customer', 'o_custkey')}, unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']), unnest([0, 1, 2, 3]) FROM orders),
p AS (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY block, node, i) - 1)::INTEGER AS pos FROM c)
SELECT q.target, q.pos, count(*) FILTER (WHERE k.node = q.node OR k.node = q.parent) AS feat, count(*) FILTER (WHERE k.parent = q.node) AS nbr, count(*) FILTER (WHERE k.col = q.col) AS col
FROM p q JOIN p k USING (target) GROUP BY 1, 2
"""


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every twentieth vector among all vectors."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(similarity.nearest(rows.where("vec_id % 20 = 0"), rows, 5, "vec_id", "embedding"), 5)


KNN_SQL = """
SELECT query, vec_id, round(c, 5) AS cosine, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5
"""

QUERIES = {
    "bfs_depth2": (bfs_depth2, _bfs_sql(None)),
    "bfs_width_capped": (bfs_width_capped, _bfs_sql(3)),
    "bfs_budgeted": (bfs_budgeted, BUDGET_SQL),
    "walk_visits_len3": (walk_visits_len3, WALK_SQL),
    "seed_rank_latest": (seed_rank_latest, _rank_sql(True)),
    "seed_rank_frequency": (seed_rank_frequency, _rank_sql(False)),
    "seed_balanced": (seed_balanced, BALANCED_SQL),
    "fallback_seeds": (fallback_seeds, FALLBACK_SQL),
    "mask_cells": (mask_cells, MASK_SQL),
    "sample_per_segment": (sample_per_segment, SAMPLE_SQL),
    "recent_history_topk": (recent_history_topk, TOPK_SQL),
    "neighborhood_round_robin": (neighborhood_round_robin, ROBIN_SQL),
    "context_budget_prefix": (context_budget_prefix, PREFIX_SQL),
    "context_label_counts": (context_label_counts, COUNTS_SQL),
    "historical_seed_order": (historical_seed_order, SEED_ORDER_SQL),
    "relation_counts": (relation_counts, RELATIONS_SQL),
    "knn_topk": (knn_topk, KNN_SQL),
}
