"""Encoding queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encode as E
from .tables import ORDER_CUTOFFS, STAR, rounded, stamped, table

_KEYED = ("customer", "events", "nation", "orders", "part", "region", "supplier")


def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("customer", "part", "orders", "lineitem"):
        one = E.column_stats(table(spark, sf, name), STAR.table(name)).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


_STAT = lambda t, c: (
    f"SELECT '{t}' AS \"table\", '{c}' AS col, 'number' AS sem, count({c}) AS n, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std FROM {t}"
)
COLUMN_STATS_SQL = " UNION ALL ".join(_STAT(t, c) for t, cs in {"customer": ["c_acctbal"], "part": ["p_size", "p_retailprice"],
    "orders": ["o_totalprice"], "lineitem": ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]}.items() for c in cs)


def datetime_global_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.datetime_stats({n: table(spark, sf, n) for n in ("orders", "lineitem", "events")}, STAR), 4)


DATETIME_SQL = """
WITH t AS (SELECT o_orderdate AS x FROM orders UNION ALL SELECT l_shipdate FROM lineitem UNION ALL SELECT ts FROM events), d AS (SELECT epoch_us(x)::DOUBLE / 86400000000.0::DOUBLE AS v FROM t)
SELECT count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM d
"""


def cells_long_customer(spark: SparkSession, sf: str) -> DataFrame:
    df, t = table(spark, sf, "customer"), STAR.table("customer")
    times = E.datetime_stats({"orders": table(spark, sf, "orders")}, STAR)
    return rounded(E.cells(df, t, F.col("c_custkey"), E.column_stats(df, t), times), 5)


def cells_long_orders(spark: SparkSession, sf: str) -> DataFrame:
    df, t = table(spark, sf, "orders"), STAR.table("orders")
    return rounded(E.cells(df, t, F.col("o_orderkey"), E.column_stats(df, t), E.datetime_stats({"orders": df}, STAR)), 4)


CELLS_SQL = """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer)
SELECT c_custkey AS row_idx, 'customer' AS "table", 'c_name' AS col, 'text' AS sem, NULL::DOUBLE AS num, c_name AS text FROM customer WHERE c_name IS NOT NULL
UNION ALL SELECT c_custkey, 'customer', 'c_mktsegment', 'text', NULL, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT c_custkey, 'customer', 'c_acctbal', 'number', round((c_acctbal - m) / d, 5), NULL FROM customer, s WHERE c_acctbal IS NOT NULL
"""
CELLS_ORDERS_SQL = """
WITH o AS (SELECT *, epoch_us(o_orderdate)::DOUBLE / 86400000000.0::DOUBLE AS v FROM orders),
s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, avg(v) AS tm, stddev_pop(v) AS td FROM o)
SELECT o_orderkey AS row_idx, 'orders' AS "table", 'o_orderstatus' AS col, 'text' AS sem, NULL::DOUBLE AS num, o_orderstatus AS text FROM o
UNION ALL SELECT o_orderkey, 'orders', 'o_orderpriority', 'text', NULL, o_orderpriority FROM o
UNION ALL SELECT o_orderkey, 'orders', 'o_totalprice', 'number', round((o_totalprice - m) / d, 4), NULL FROM o, s
UNION ALL SELECT o_orderkey, 'orders', 'o_orderdate', 'datetime', round((v - tm) / td, 4), NULL FROM o, s
"""


def train_stat_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the oldest orders, applied to all splits by column name."""
    orders = table(spark, sf, "orders").withColumn("split", F.when(F.col("o_orderdate") < stamped(ORDER_CUTOFFS[2]),
        "train").when(F.col("o_orderdate") < stamped(ORDER_CUTOFFS[3]), "val").otherwise("test"))
    return rounded(E.train_stats(E.column_stats(orders, STAR.table("orders"), ["split"])), 4)


TRAIN_SQL = f"""
WITH o AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{ORDER_CUTOFFS[2]}' THEN 'train' WHEN o_orderdate < TIMESTAMP '{ORDER_CUTOFFS[3]}' THEN 'val' ELSE 'test' END AS split FROM orders)
SELECT 'o_totalprice' AS col, split, 'number' AS sem, n, mean, std FROM (SELECT DISTINCT split FROM o), (SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM o WHERE split = 'train')
"""


def vocab_counts(spark: SparkSession, sf: str) -> DataFrame:
    frames = [table(spark, sf, t).select(c) for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_type"),
        ("orders", "o_orderpriority"), ("nation", "n_name"))]
    return E.vocabulary(frames)


VOCAB_SQL = """
SELECT text, count(*) AS n FROM (SELECT c_name AS text FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT n_name FROM nation) GROUP BY 1
"""


def vocab_ids(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_text_ids(vocab_counts(spark, sf))


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.edges({n: table(spark, sf, n) for n in _KEYED}, STAR)


FK_SQL = """
SELECT 'customer' AS child_table, c_custkey::BIGINT AS child, NULL::BIGINT AS child_ts, 'c_nationkey' AS fk_col, 'nation' AS parent_table, c_nationkey::BIGINT AS parent FROM customer
UNION ALL SELECT 'supplier', s_suppkey, NULL, 's_nationkey', 'nation', s_nationkey FROM supplier
UNION ALL SELECT 'nation', n_nationkey, NULL, 'n_regionkey', 'region', n_regionkey FROM nation
UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) // 1000000, 'o_custkey', 'customer', o_custkey FROM orders
UNION ALL SELECT 'events', event_id, epoch_us(ts) // 1000000, 'user_id', 'customer', user_id FROM events
"""


def adjacency_sorted(spark: SparkSession, sf: str) -> DataFrame:
    adj = E.adjacency(fk_edges(spark, sf))
    return adj.select("parent_table", "parent", "child_table", F.array_join(F.transform("children", lambda x: x.cast("string")),
        ",").alias("children"))


ADJ_SQL = f"""
SELECT parent_table, parent, child_table, string_agg(child::VARCHAR, ',' ORDER BY child_ts NULLS FIRST, child) AS children FROM ({FK_SQL}) GROUP BY 1, 2, 3
"""


def node_table_info(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in _KEYED:
        one = table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return E.offsets(out)


INFO_SQL = f"""
SELECT "table", n, coalesce(sum(n) OVER (ORDER BY "table" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS node_offset
FROM ({' UNION ALL '.join(f"SELECT '{n}' AS " + '"table"' + f", count(*) AS n FROM {n}" for n in _KEYED)})
"""


def node_times(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps of given nodes: a semi join on the ids asked for."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), S.seconds("o_orderdate").alias("ts"))
    wanted = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("node"))
    return orders.join(wanted, "node", "left_semi")


NODE_TIMES_SQL = (
    "SELECT o_orderkey AS node, (epoch_us(o_orderdate) // 1000000)::BIGINT AS ts FROM orders WHERE o_orderkey IN "
    "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
)


def column_semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(f"{c} of {n}", k) for n in (*_KEYED, "lineitem") for c, k in E.value_columns(table(spark, sf, n), STAR.table(n)).items()]
    return spark.createDataFrame(rows, "name string, sem string")


_KINDS = {"customer": {"c_name": "text", "c_acctbal": "number", "c_mktsegment": "text"},
    "events": {"ts": "datetime", "event_type": "text", "value": "number", "props": "text"}, "nation": {"n_name": "text"},
          "orders": {"o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "text"},
              "part": {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"},
          "region": {"r_name": "text"}, "supplier": {"s_name": "text", "s_acctbal": "number"},
          "lineitem": {"l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number",
              "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime"}}
KINDS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c} of {n}', '{k}')" for n, cs in _KINDS.items() for c,
    k in cs.items()) + ") v(name, sem)"


def column_name_cycle(spark: SparkSession, sf: str) -> DataFrame:
    names = column_semantic_types(spark, sf).select(F.col("name").alias("col"))
    return E.cyclic_names(names, 42)


CYCLE_SQL = f"""
SELECT col, coalesce(lead(col) OVER w, first(col) OVER (ORDER BY h, col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shown
FROM (SELECT name AS col, md5('42|' || name) AS h FROM ({KINDS_SQL})) WINDOW w AS (ORDER BY h, col)
"""


def padded_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-length arrays of each customer's latest order prices."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    ranked = table(spark, sf, "orders").select("o_custkey", "o_totalprice", (F.row_number().over(w) - 1).alias("pos"))
    out = E.padded(ranked, "o_custkey", "pos", "o_totalprice", 6)
    return out.select("o_custkey", F.array_join(F.transform("values",
        lambda v: F.coalesce(F.round(v).cast("long").cast("string"), F.lit("-"))), ",").alias("prices"),
        F.array_join(F.transform("is_padding", lambda p: F.when(p, "1").otherwise("0")), "").alias("padding"))


PADDED_SQL = """
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders),
g AS (SELECT o_custkey, i FROM (SELECT DISTINCT o_custkey FROM orders), range(6) t(i))
SELECT g.o_custkey, string_agg(coalesce(round(o_totalprice)::BIGINT::VARCHAR, '-'), ',' ORDER BY i) AS prices, string_agg(CASE WHEN pos IS NULL THEN '1' ELSE '0' END, '' ORDER BY i) AS padding
FROM g LEFT JOIN r ON r.o_custkey = g.o_custkey AND pos = i GROUP BY 1
"""

QUERIES = {
    "column_stats": (column_stats, COLUMN_STATS_SQL),
    "datetime_global_stats": (datetime_global_stats, DATETIME_SQL),
    "cells_long_customer": (cells_long_customer, CELLS_SQL),
    "cells_long_orders": (cells_long_orders, CELLS_ORDERS_SQL),
    "train_stat_propagation": (train_stat_propagation, TRAIN_SQL),
    "vocab_counts": (vocab_counts, VOCAB_SQL),
    "vocab_ids": (vocab_ids, f"SELECT text, n, (row_number() OVER (ORDER BY encode(text)) - 1)::BIGINT AS txt_id FROM ({VOCAB_SQL})"),
    "fk_edges": (fk_edges, FK_SQL),
    "adjacency_sorted": (adjacency_sorted, ADJ_SQL),
    "node_table_info": (node_table_info, INFO_SQL),
    "node_times": (node_times, NODE_TIMES_SQL),
    "column_semantic_types": (column_semantic_types, KINDS_SQL),
    "column_name_cycle": (column_name_cycle, CYCLE_SQL),
    "padded_histories": (padded_histories, PADDED_SQL),
}
