"""Encoded datasets, assembled contexts, visible labels and their checks over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assemble as A
from ..operators import context as C
from ..operators import encode as E
from ..operators import store as ST
from ..operators.graph import SPAN, numbered_children
from ..sources.shared import materialise
from . import evaluation as EV
from .features import _LABELS, churn_labels
from .graphs import _N, CODES, EDGES_SQL, ROBIN_SQL, fallback_sql, graph_edges, neighborhood_round_robin, node
from .tables import STAR, rounded, table

_STORED = ("customer", "events", "nation", "orders", "part", "region", "supplier")


def _sources(spark: SparkSession, sf: str, names: tuple[str, ...] = _STORED) -> list[ST.Source]:
    """Tables whose primary key counts their rows from 0."""
    return ST.sources_of([(STAR.table(n), "db", E.normalised(table(spark, sf, n)).withColumn(ST.ROW,
        F.col(STAR.table(n).pkey).cast("long"))) for n in names])


_OFFSETS = "o AS (" + " UNION ALL ".join(f"SELECT '{n}' AS t, (SELECT count(*) FROM {n}) AS n" for n
    in _STORED) + "), f AS (SELECT t, (sum(n) OVER (ORDER BY t) - n)::BIGINT AS first FROM o)"
_AT = lambda t: f"(SELECT first FROM f WHERE t = '{t}')"
_TIMES = {"orders": "epoch_us(o_orderdate) // 1000000", "events": "epoch_us(ts) // 1000000"}


def encode_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return ST.nodes(_sources(spark, sf))


NODES_SQL = f"WITH {_OFFSETS} " + " UNION ALL ".join((
    f"SELECT ({STAR.table(n).pkey} + {_AT(n)})::BIGINT AS node_id, '{n}' AS \"table\", 'db' AS split, "
    f"{STAR.table(n).pkey}::BIGINT AS row_idx, {'(' + _TIMES[n] + ')::BIGINT' if n in _TIMES else 'NULL::BIGINT'} "
    f"AS ts FROM {n}"
) for n in _STORED)


def encode_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between numbered rows, parents found by primary key."""
    return ST.edges(_sources(spark, sf), fk="key")


_FKS = [(n, c, p) for n in _STORED for c, p in STAR.table(n).fkeys.items()]
STORE_EDGES_SQL = f"WITH {_OFFSETS} " + " UNION ALL ".join((
    f"SELECT ({STAR.table(n).pkey} + {_AT(n)})::BIGINT AS child, ({c} + {_AT(p)})::BIGINT AS parent, '{n}' AS "
    f"child_table, 'db' AS child_split, {'(' + _TIMES[n] + ')::BIGINT' if n in _TIMES else 'NULL::BIGINT'} AS "
    f"child_ts, '{p}' AS parent_table, '{c}' AS fk_col FROM {n} WHERE {c} IN (SELECT {STAR.table(p).pkey} FROM {p})"
) for n, c, p in _FKS)

_CELLED = ("customer", "nation", "orders", "part")


def encode_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.cells(_sources(spark, sf, _CELLED)), 4)


#: The cell columns of the tables above and their kinds.
_CELL_COLUMNS = {"customer": {"c_name": "text", "c_acctbal": "number", "c_mktsegment": "text"}, "nation": {"n_name": "text"},
    "orders": {"o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "text"},
    "part": {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"}}


def _cells_sql() -> str:
    names = sorted(f"{c} of {t}" for t, cs in _CELL_COLUMNS.items() for c in cs)
    parts = []
    for t, cs in _CELL_COLUMNS.items():
        at = "+".join(["0", *[f"(SELECT count(*) FROM {p})" for p in _CELLED if p < t]])
        for c, kind in cs.items():
            value = {"text": "NULL::DOUBLE", "number": f"round(({c} - m) / d, 4)",
                "datetime": f"round((epoch_us({c})::DOUBLE / 86400000000.0::DOUBLE - m) / d, 4)"}[kind]
            stats = {"text": "", "number": f", (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM {t})", "datetime": (
                f", (SELECT avg(v) AS m, stddev_pop(v) AS d FROM (SELECT epoch_us({c})::DOUBLE / 86400000000.0::DOUBLE AS v "
                f"FROM {t}))"
            )}[kind]
            parts.append((
                f"SELECT ({STAR.table(t).pkey} + {at})::BIGINT AS node_id, '{t}' AS \"table\", 'db' AS split, '{c}' AS col, "
                f"{names.index(f'{c} of {t}')} AS col_id, '{kind}' AS sem, {value} AS num, {c if kind == 'text' else 'NULL'} AS "
                f"text FROM {t}{stats} WHERE {c} IS NOT NULL"
            ))
    return " UNION ALL ".join(parts)


def encode_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of cells, tables' names and columns' names, numbered in text order."""
    parts = _sources(spark, sf, _CELLED)
    return ST.dictionary(parts, ST.cells(parts))


_NAMES = sorted({*_CELL_COLUMNS, *(f"{c} of {t}" for t, cs in _CELL_COLUMNS.items() for c in cs)})
DICTIONARY_SQL = "SELECT text, count(*) AS n, (row_number() OVER (ORDER BY encode(text)) - 1)::BIGINT AS txt_id FROM (" + " UNION ALL ".join([*(f"SELECT {c} AS text FROM {t}" for t, cs in _CELL_COLUMNS.items() for c, k in cs.items() if k == "text"), f"SELECT unnest({_NAMES})"]) + ") WHERE text IS NOT NULL GROUP BY 1"

# Contexts of the churn labels: label rows are nodes of a table of their own, whose parent is the customer.
_LABEL = CODES["events"] + 1
_LN = lambda key, year: f"({_LABEL} * {SPAN}::BIGINT + {key} * 10000 + {year})"
_SIZES = (6, 12, 24)


def _label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The labels, worked out once and read again by every part of a context."""
    at = F.lit(_LABEL * SPAN) + F.col("c_custkey").cast("long") * 10000 + F.year("cutoff")
    return materialise(churn_labels(spark, sf).select(at.alias("node_id"), node("customer", "c_custkey").alias("parent"),
        S.seconds("cutoff").alias("ts"), F.col("churn").cast("double").alias("label")), "labels")


def _nodes(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    none, db = F.lit(None).cast("long"), F.lit("db").alias("split")
    people = table(spark, sf, "customer").select(node("customer", "c_custkey").alias("node_id"), F.lit("customer").alias("table"), db,
        none.alias("ts"))
    nations = table(spark, sf, "nation").select(node("nation", "n_nationkey").alias("node_id"), F.lit("nation").alias("table"), db,
        none.alias("ts"))
    regions = table(spark, sf, "region").select(node("region", "r_regionkey").alias("node_id"), F.lit("region").alias("table"), db,
        none.alias("ts"))
    orders = table(spark, sf, "orders").select(node("orders", "o_orderkey").alias("node_id"), F.lit("orders").alias("table"), db,
        S.seconds("o_orderdate").alias("ts"))
    labels = labels.select("node_id", F.lit("churn").alias("table"), F.lit("train").alias("split"), "ts")
    return ST.union([people, nations, regions, orders, labels])


def _edges(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    db = graph_edges(spark, sf).select("child", "parent", "child_ts", F.lit("db").alias("child_split"), F.lit("").alias("child_table"))
    labels = labels.select(F.col("node_id").alias("child"), "parent", F.col("ts").alias("child_ts"),
        F.lit("train").alias("child_split"), F.lit("churn").alias("child_table"))
    return db.unionByName(labels)


def _cells(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    def one(df: DataFrame, at, name: str, *columns) -> DataFrame:
        entry = [F.struct(F.lit(c).alias("col"), F.lit(i).alias("col_id"), F.lit(sem).alias("sem"),
            (F.lit(None).cast("double") if sem == "text" else v.cast("double")).alias("num"),
            (v.cast("string") if sem == "text" else F.lit(None).cast("string")).alias("text")) for c, i, sem, v in columns]
        return df.select(at.alias("node_id"), F.lit(name).alias("table"), F.inline(F.array(*entry)))

    return ST.union([
        one(table(spark, sf, "customer"), node("customer", "c_custkey"), "customer", ("c_mktsegment", 0, "text", F.col("c_mktsegment")),
            ("c_acctbal", 1, "number", F.col("c_acctbal"))),
        one(table(spark, sf, "nation"), node("nation", "n_nationkey"), "nation", ("n_name", 2, "text", F.col("n_name"))),
        one(table(spark, sf, "orders"), node("orders", "o_orderkey"), "orders", ("o_orderstatus", 3, "text", F.col("o_orderstatus")),
            ("o_totalprice", 4, "number", F.col("o_totalprice"))),
        one(labels, F.col("node_id"), "churn", ("label", 5, "number", F.col("label"))),
    ])


def _targets(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node_id").alias("target"), F.col("node_id").alias("node"), "ts",
        F.lit("churn").alias("table"))


def context_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The target, the customer's earlier labels, then two random earlier labels."""
    return _tiers(_label_rows(spark, sf))


def _tiers(labels: DataFrame) -> DataFrame:
    similar = C.seed_order(labels.select(F.col("node_id").alias("target"), F.col("parent").alias("entity"), F.col("ts").alias("cutoff")),
        labels.select(F.col("parent").alias("entity"), F.col("node_id").alias("node"), F.col("ts").alias("time")))
    similar = similar.select("target", F.col("node").alias("seed"), "rank")
    drawn = C.fallback(_targets(labels).select("target"), labels.select(F.col("node_id").alias("node"),
        F.timestamp_seconds("ts").cast("timestamp_ntz").alias("time")), 2, 7, ranked=True)
    return A.seed_tiers(_targets(labels), similar, drawn.select("target", F.col("node").alias("seed"), "rank"),
        labels.where("label IS NOT NULL").select(F.col("node_id").alias("seed")))


_LAB = (
    f"lab AS (SELECT {_LN('c_custkey', 'year(cutoff)')} AS node, {_N('customer', 'c_custkey')} AS parent, "
    f"(epoch_us(cutoff) // 1000000)::BIGINT AS ts, churn::DOUBLE AS label FROM ({_LABELS}))"
)


_TIERS = f"""{_LAB}, {fallback_sql('SELECT node, ts AS time FROM lab', 2, 7)},
ti AS (SELECT node AS target, node AS seed, 0 AS tier, 0 AS rank FROM lab
  UNION ALL SELECT t.node, l.node, 1, row_number() OVER (PARTITION BY t.node ORDER BY l.ts DESC, l.node) FROM lab t JOIN lab l ON l.parent = t.parent AND l.ts < t.ts
  UNION ALL SELECT target, node, 2, k FROM fb),
tf AS (SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY target, seed ORDER BY tier, rank) = 1),
tiers AS (SELECT target, seed, tier, (row_number() OVER (PARTITION BY target ORDER BY tier, rank, seed) - 1)::INTEGER AS place FROM tf)"""
TIERS_SQL = f"WITH {_TIERS} SELECT * FROM tiers"


def _context(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    cells = _cells(spark, sf, labels)
    starts = _targets(labels).select(F.col("node").alias("seed"), "node", "ts", "table")
    reached = A.bounded(A.bfs(starts, _edges(spark, sf, labels), 2, 3, 5, task_rule=True),
        cells.groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("cells")), 12)
    found = A.collected(_tiers(labels), reached.select("seed", "node", "depth"))
    return A.expand(found, cells, _nodes(spark, sf, labels), _targets(labels), "label", _SIZES[-1], leakage=["label"])


def context_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every label row's context: three tiers, three orders a customer, 12 cells a seed, 24 cells in all."""
    return rounded(_context(spark, sf, _label_rows(spark, sf)).drop("ts"), 4)


_CONTEXT = f"""{_TIERS}, e AS (SELECT DISTINCT child, parent, child_ts FROM ({EDGES_SQL})),
c AS (SELECT {_N('customer', 'c_custkey')} AS node, 'customer' AS tab, unnest(['c_mktsegment', 'c_acctbal']) AS col, unnest([0, 1]) AS col_id, unnest(['text', 'number']) AS sem, unnest([NULL, c_acctbal::DOUBLE]) AS num, unnest([c_mktsegment, NULL]) AS text, NULL::BIGINT AS ts FROM customer
  UNION ALL SELECT {_N('nation', 'n_nationkey')}, 'nation', 'n_name', 2, 'text', NULL, n_name, NULL FROM nation
  UNION ALL SELECT {_N('orders', 'o_orderkey')}, 'orders', unnest(['o_orderstatus', 'o_totalprice']), unnest([3, 4]), unnest(['text', 'number']), unnest([NULL, o_totalprice::DOUBLE]), unnest([o_orderstatus, NULL]), (epoch_us(o_orderdate) // 1000000)::BIGINT FROM orders
  UNION ALL SELECT node, 'churn', 'label', 5, 'number', label, NULL, ts FROM lab),
kids AS (SELECT l.node AS seed, e.child AS node FROM lab l JOIN e ON e.parent = l.parent AND (e.child_ts IS NULL OR e.child_ts <= l.ts) QUALIFY row_number() OVER (PARTITION BY l.node ORDER BY md5('5|' || l.parent || '|' || e.child), e.child) <= 3),
r AS (SELECT seed, node, min(depth) AS depth FROM (SELECT node AS seed, node, 0 AS depth FROM lab UNION ALL SELECT node, parent, 1 FROM lab UNION ALL SELECT seed, node, 2 FROM kids
  UNION ALL SELECT l.node, e.parent, 2 FROM lab l JOIN e ON e.child = l.parent UNION ALL SELECT l.node, o.node, 2 FROM lab l JOIN lab o ON o.parent = l.parent AND o.ts <= l.ts) GROUP BY 1, 2),
n AS (SELECT node, count(*) AS cells FROM c GROUP BY 1),
b AS (SELECT seed, node, depth FROM (SELECT r.*, sum(cells) OVER (PARTITION BY seed ORDER BY depth, node ROWS UNBOUNDED PRECEDING) AS running FROM r JOIN n USING (node)) WHERE running < 12),
m AS (SELECT target, place, seed, tier, node, depth FROM tiers JOIN b USING (seed) QUALIFY row_number() OVER (PARTITION BY target, node ORDER BY place) = 1),
x AS (SELECT m.*, tab, col, col_id, sem, num, text, m.node = target AND col = 'label' AND place = 0 AS is_target, c.ts FROM m JOIN c USING (node) JOIN lab t ON t.node = target WHERE (m.node = target AND col = 'label' AND place = 0) OR NOT (c.ts IS NOT DISTINCT FROM t.ts AND tab = 'churn' AND col = 'label')),
ctx AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY is_target DESC, place, depth, node, col_id) - 1)::INTEGER AS pos FROM x) WHERE pos < {_SIZES[-1]})"""
CONTEXT_SQL = (
    f'WITH {_CONTEXT} SELECT target, pos, node, tab AS "table", col, col_id, sem, round(num, 4) AS num, text, seed, '
    f'tier, depth, is_target FROM ctx'
)


def visible_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the labels that contexts of three sizes show of the target's own customer, else of all."""
    return _visible(spark, sf, _label_rows(spark, sf))


def _visible(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    context, targets = _context(spark, sf, labels), _targets(labels)
    sets = A.visible_sets(context, "churn", "label", list(_SIZES))
    parents = labels.select(F.col("node_id").alias("node"), F.array("parent").alias("parents"))
    return rounded(A.context_means(targets, context, A.matching(sets, parents, targets), list(_SIZES), "clf"))


VISIBLE_SQL = f"""
WITH {_CONTEXT}, s AS (SELECT target, z AS ctx_size, node, num AS label, o.parent = t.parent AS same FROM ctx JOIN lab o USING (node) JOIN lab t ON t.node = target, (VALUES (6), (12), (24)) v(z) WHERE col = 'label' AND NOT is_target AND pos < z),
k AS (SELECT * FROM s QUALIFY same OR NOT max(same) OVER (PARTITION BY target, ctx_size)),
a AS (SELECT target, ctx_size, avg(label) AS mean, count(label) AS labels FROM k GROUP BY 1, 2)
SELECT node AS target, z AS ctx_size, coalesce(labels, 0)::BIGINT AS labels, round(coalesce(mean, 0.5::DOUBLE), 6) AS prediction FROM lab CROSS JOIN (VALUES (6), (12), (24)) v(z) LEFT JOIN a ON a.target = node AND a.ctx_size = z
"""


def explicit_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A context for every customer, asked for by node: its own balance, then what a timeless row may see."""
    ids = table(spark, sf, "customer").select(node("customer", "c_custkey").alias("node_id"))
    labels = _label_rows(spark, sf)
    nodes = _nodes(spark, sf, labels)
    targets = A.explicit_targets(nodes, ids)
    found = A.contexts(nodes, _edges(spark, sf, labels), _cells(spark, sf, labels), targets, "c_acctbal", length=8, depth=1, skip_text=True)
    return rounded(found.select("target", "pos", "node", "table", "col", "num", "depth", "is_target"), 4)


EXPLICIT_SQL = (
    f"SELECT {_N('customer', 'c_custkey')} AS target, 0 AS pos, {_N('customer', 'c_custkey')} AS node, 'customer' "
    f"AS \"table\", 'c_acctbal' AS col, round(c_acctbal::DOUBLE, 4) AS num, 0 AS depth, true AS is_target FROM "
    f"customer WHERE c_acctbal IS NOT NULL"
)


def context_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, nodes and first places by table of each context."""
    return A.summary(_context(spark, sf, _label_rows(spark, sf)), "table")


SUMMARY_SQL = (
    f'WITH {_CONTEXT} SELECT target, tab AS "table", count(*) AS cells, count(DISTINCT node) AS nodes, min(pos) AS '
    f'first_pos, min(depth) AS depth FROM ctx GROUP BY 1, 2'
)


def context_graph(spark: SparkSession, sf: str) -> DataFrame:
    labels = _label_rows(spark, sf)
    return A.context_edges(_context(spark, sf, labels), _edges(spark, sf, labels))


GRAPH_SQL = (
    f"WITH {_CONTEXT}, s AS (SELECT DISTINCT target, node FROM ctx), g AS (SELECT child, parent FROM e UNION SELECT "
    f"node, parent FROM lab) SELECT a.target, child, parent FROM g JOIN s a ON a.node = child JOIN s b ON b.node = "
    f"parent AND b.target = a.target"
)


def context_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the assembled contexts and of the seed order; all are 0."""
    labels = _label_rows(spark, sf)
    targets, nodes = _targets(labels), _nodes(spark, sf, labels)
    shown = materialise(_context(spark, sf, labels).select("target", "node").distinct(), "shown")
    tiers = _tiers(labels).where("tier = 1").select("target", F.col("place").alias("rank"), F.col("seed").alias("node"))
    one = A.check_contexts(shown, nodes, targets).withColumn("of", F.lit("context"))
    return one.unionByName(A.check_seed_orders(tiers, nodes, targets).withColumn("of", F.lit("seeds")))


CHECKS_SQL = (
    "SELECT unnest(['unknown node', 'double node', 'later node', 'unknown target', 'missing target']) AS "
    "\"check\", 0::BIGINT AS found, 'context' AS \"of\" UNION ALL SELECT unnest(['unknown node', 'double node', "
    "'double rank', 'other table', 'not earlier', 'unknown target']), 0, 'seeds'"
)


def neighborhood_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the fixed neighbourhoods: later nodes are counted against the cutoff's second."""
    context = neighborhood_round_robin(spark, sf)
    targets = context.select("target").distinct().withColumn("ts", F.lit(None).cast("long"))
    nodes = _nodes(spark, sf, _label_rows(spark, sf)).select("node_id", F.lit(None).cast("long").alias("ts"))
    return A.check_contexts(context.select("target", "node"), nodes, targets)


NEIGHBORHOOD_CHECKS_SQL = (
    f"WITH c AS ({ROBIN_SQL}) SELECT 'unknown node' AS \"check\", count(*) FILTER (WHERE node // {SPAN} = "
    f"{CODES['events']}) AS found FROM c UNION ALL SELECT unnest(['double node', 'later node', 'unknown target', "
    f"'missing target']), 0"
)


def items_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty label rows of each cutoff by hash, each with one of three drawn configurations."""
    targets = _label_rows(spark, sf).select(F.col("node_id").alias("target"), "ts")
    return A.draw_config(A.item_cap(targets, ["ts"], 50, 2), [512, 1024, 2048], "local", 6)


ITEMS_SQL = (
    f"WITH {_LAB} SELECT node AS target, ts, ([512, 1024, 2048])[1 + ('0x' || substr(md5('6|' || node), 1, "
    f"8))::BIGINT % 3] AS local FROM lab QUALIFY row_number() OVER (PARTITION BY ts ORDER BY md5('2|' || node), "
    f"node) <= 50"
)


def column_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Context cells by column, with where a column's run starts."""
    return A.runs(A.by_column(_context(spark, sf, _label_rows(spark, sf))), "col_id").select("target", "place", "col_id", "starts")


RUNS_SQL = (
    f"WITH {_CONTEXT}, p AS (SELECT target, (row_number() OVER (PARTITION BY target ORDER BY col_id, pos) - "
    f"1)::INTEGER AS place, col_id FROM ctx) SELECT target, place, col_id, lag(col_id) OVER (PARTITION BY target "
    f"ORDER BY place) IS DISTINCT FROM col_id AS starts FROM p"
)


def evaluation_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC of the mean predictor at three context sizes: contexts, visible labels, predictions, scores in one plan."""
    labels = _label_rows(spark, sf)
    return rounded(EV.scores(_visible(spark, sf, labels), labels.select(F.col("node_id").alias("target"), "label"), "clf"))


EVALUATION_SQL = f"""
WITH p AS ({VISIBLE_SQL}), l AS (SELECT {_LN('c_custkey', 'year(cutoff)')} AS target, churn::INTEGER::DOUBLE AS label FROM ({_LABELS})),
s AS (SELECT ctx_size, label, rank() OVER (PARTITION BY ctx_size ORDER BY prediction) + (count(*) OVER (PARTITION BY ctx_size, prediction) - 1) / 2.0::DOUBLE AS r FROM p JOIN l USING (target))
SELECT ctx_size, 'roc_auc' AS metric, round(CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END, 6) AS value, count(*) AS n FROM s GROUP BY 1
"""


def knn_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The three vectors most like every twentieth one, none later than it; a vector's time is its id modulo 97."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), (F.col("vec_id") % 97).cast("long").alias("ts"),
        "embedding")
    targets = rows.where("node_id % 20 = 0").select(F.col("node_id").alias("target"), F.col("node_id").alias("node"))
    return EV.knn_seeds(rows, targets, 3, "embedding")


KNN_SEEDS_SQL = """
SELECT target, seed, rank::INTEGER AS rank FROM (SELECT q.vec_id AS target, r.vec_id AS seed, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, r.vec_id) AS rank
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND r.vec_id % 97 <= q.vec_id % 97 WHERE q.vec_id % 20 = 0) WHERE rank <= 3
"""


def adjacency_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every parent's children in order of time, a row each."""
    return numbered_children(graph_edges(spark, sf)).select("parent", "place", "child", "upto")


ADJACENCY_SQL = f"""
SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY child_ts NULLS FIRST, child % 64, child) - 1 AS place, child,
  count(*) OVER (PARTITION BY parent ORDER BY coalesce(child_ts, -62000000000) RANGE UNBOUNDED PRECEDING) AS upto FROM ({EDGES_SQL})
"""


QUERIES = {
    "adjacency_rows": (adjacency_rows, ADJACENCY_SQL),
    "evaluation_by_size": (evaluation_by_size, EVALUATION_SQL),
    "knn_seeds": (knn_seeds, KNN_SEEDS_SQL),
    "encode_nodes": (encode_nodes, NODES_SQL),
    "encode_edges": (encode_edges, STORE_EDGES_SQL),
    "encode_cells": (encode_cells, _cells_sql()),
    "encode_dictionary": (encode_dictionary, DICTIONARY_SQL),
    "context_tiers": (context_tiers, TIERS_SQL),
    "context_cells": (context_cells, CONTEXT_SQL),
    "visible_labels": (visible_labels, VISIBLE_SQL),
    "explicit_contexts": (explicit_contexts, EXPLICIT_SQL),
    "context_summary": (context_summary, SUMMARY_SQL),
    "context_graph": (context_graph, GRAPH_SQL),
    "context_checks": (context_checks, CHECKS_SQL),
    "neighborhood_checks": (neighborhood_checks, NEIGHBORHOOD_CHECKS_SQL),
    "items_capped": (items_capped, ITEMS_SQL),
    "column_runs": (column_runs, RUNS_SQL),
}
