"""Contexts put together: seeds in tiers, what each of them reaches, its cells in order, and the labels they show.

nodes(node_id, table, split, ts), edges(child, parent, child_table, child_split, child_ts) and
cells(node_id, table, col, col_id, sem, num, text) are those of an encoded dataset. A target is a label row: its value in
the target column is what is to be predicted and stands first in its context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_rank
from .graph import bfs, bounded
from .history import spread
from .predict import DEFAULTS


def explicit_targets(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(target, node, ts, table) of the nodes asked for; ids(node_id). Each is its own target, whatever table it is in."""
    return nodes.join(spread(ids.select("node_id").distinct()), "node_id", "left_semi").select(F.col("node_id").alias("target"),
        F.col("node_id").alias("node"), "ts", "table")


def item_cap(targets: DataFrame, by: list[str], items: int | None, seed: int = 0) -> DataFrame:
    """At most `items` targets of each task, in hash order; all of them without a cap."""
    if items is None:
        return targets
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_rank(seed, "target"), "target"))
    return targets.withColumn("__k", rank).where(F.col("__k") <= items).drop("__k")


def draw_config(targets: DataFrame, configs: list[int], name: str, seed: int = 0) -> DataFrame:
    """Targets with one of the configurations each, drawn evenly by hash."""
    number = F.conv(F.substring(hash_rank(seed, "target"), 1, 8), 16, 10).cast("long")
    return targets.withColumn(name, F.array(*map(F.lit, configs))[F.pmod(number, F.lit(len(configs))).cast("int")])


def seed_tiers(targets: DataFrame, similar: DataFrame | None = None, fallback: DataFrame | None = None,
    labelled: DataFrame | None = None) -> DataFrame:
    """(target, seed, tier, place): the target itself (0), seeds like it by rank (1), then others by rank (2).

    similar and fallback are (target, seed, rank). A seed counts in its first tier only, and never the target itself. Seeds of
    tiers 1 and 2 without a label are left out where labelled(seed) is given.
    """
    out = targets.select("target", F.col("node").alias("seed"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("rank"))
    for tier, more in ((1, similar), (2, fallback)):
        if more is None:
            continue
        more = more.select("target", "seed", F.lit(tier).alias("tier"), F.col("rank").cast("long").alias("rank"))
        if labelled is not None:
            more = more.join(spread(labelled.select("seed").distinct()), "seed", "left_semi").select(*out.columns)
        out = out.unionByName(more)
    first = out.groupBy("target", "seed").agg(F.min(F.struct("tier", "rank")).alias("o")).select("target", "seed", "o.tier", "o.rank")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("tier", "rank", "seed")) - 1).drop("rank")


def collected(tiers: DataFrame, reached: DataFrame) -> DataFrame:
    """(target, place, seed, tier, node, depth, first): what a target's seeds reach, in the order of its seeds.

    reached(seed, node, depth) is found once for each seed, however many targets share it. All seeds of a target share
    one map of visited depths: a later seed takes a node again only at a smaller depth than any before it. `first` tells
    where a node came in; its cells are shown there alone.
    """
    met = tiers.join(spread(reached), "seed")
    before = F.min("depth").over(Window.partitionBy("target", "node").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    kept = met.withColumn("__before", before).where("__before IS NULL OR depth < __before")
    return kept.select("target", "place", "seed", "tier", "node", "depth", F.col("__before").isNull().alias("first"))


def expand(found: DataFrame, cells: DataFrame, nodes: DataFrame, targets: DataFrame, column: str, length: int, skip_text: bool = False,
    leakage: list[str] | None = None, table: str | None = None) -> DataFrame:
    """(target, pos, node, table, col, col_id, sem, num, text, ts, seed, tier, depth, is_target): each context's first
    `length` cells.

    The target's value in `column` is at place 0. A node's cells come once, by seed, depth, node and column. Left out are
    text cells on request (the target's value excepted) and the leakage columns of the target's table on every row of the
    target's time (no time equals no time). A target without its value has no context.
    """
    shown = found.where("first").join(spread(cells.withColumnRenamed("node_id", "node")), "node")
    shown = shown.join(spread(nodes.select(F.col("node_id").alias("node"), "ts")), "node")
    of = targets.select("target", F.col("node").alias("__node"), F.col("ts").alias("__ts"), F.col("table").alias("__table"))
    shown = shown.join(spread(of), "target").withColumn("is_target", (F.col("node") == F.col("__node")) & (F.col("col") == column)
        & (F.col("place") == 0))
    if table is not None:
        shown = shown.where((F.col("__table") == table))
    if skip_text:
        shown = shown.where("is_target OR sem <> 'text'")
    if leakage:
        leaks = F.col("ts").eqNullSafe(F.col("__ts")) & (F.col("table") == F.col("__table")) & F.col("col").isin(leakage)
        shown = shown.where(F.col("is_target") | ~leaks)
    here = Window.partitionBy("target")
    order = [F.desc("is_target"), "place", "depth", "node", "col_id"]
    ranked = shown.withColumns({"pos": F.row_number().over(here.orderBy(*order)) - 1, "__known": F.max("is_target").over(here)})
    return ranked.where(F.col("__known") & (F.col("pos") < length)).select("target", "pos", "node", "table", "col", "col_id", "sem", "num",
        "text", "ts", "seed", "tier", "depth", "is_target")


def contexts(nodes: DataFrame, edges: DataFrame, cells: DataFrame, targets: DataFrame, column: str, *, length: int, depth: int = 2,
    width: int | None = None, local: int | None = None, similar: DataFrame | None = None, fallback: DataFrame | None = None,
    labelled: DataFrame | None = None, seed: int = 0, skip_text: bool = False, leakage: list[str] | None = None) -> DataFrame:
    """The cells of every target's context: tiers, expansion of each seed once, visited depths, cells, cut.

    local: the cells that one seed's expansion may hold; the node that reaches it and all later ones go.
    """
    tiers = seed_tiers(targets, similar, fallback, labelled)
    starts = tiers.select(F.col("seed").alias("node_id")).distinct().join(spread(nodes), "node_id").select(F.col("node_id").alias("seed"),
        F.col("node_id").alias("node"), "ts", "table")
    reached = bfs(starts, edges, depth, width, seed, task_rule=True)
    if local is not None:
        reached = bounded(reached, cells.groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("cells")), local).select("seed",
            "node", "depth")
    return expand(collected(tiers, reached), cells, nodes, targets, column, length, skip_text, leakage)


def visible_sets(context: DataFrame, table: str, column: str, sizes: list[int]) -> DataFrame:
    """(target, ctx_size, node, pos, label): the labels that a context of each size shows, the target's own apart."""
    labels = context.where((F.col("table") == table) & (F.col("col") == column) & ~F.col("is_target"))
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("pos") < s)
    return labels.withColumn("ctx_size", F.explode(fits)).select("target", "ctx_size", "node", "pos", F.col("num").alias("label"))


def matching(sets: DataFrame, parents: DataFrame, targets: DataFrame) -> DataFrame:
    """The labels of the target's own entity, or all where none is: parents(node, parents array) holds each label row's."""
    own = targets.select("target", F.col("node").alias("__node")).join(spread(parents.select(F.col("node").alias("__node"),
        F.col("parents").alias("__own"))), "__node").drop("__node")
    met = sets.join(spread(parents), "node").join(spread(own), "target").withColumn("__same", F.col("parents") == F.col("__own"))
    some = F.max("__same").over(Window.partitionBy("target", "ctx_size"))
    return met.withColumn("__some", some).where("__same OR NOT __some").select(*sets.columns)


def context_means(targets: DataFrame, context: DataFrame, sets: DataFrame, sizes: list[int], task_type: str) -> DataFrame:
    """(target, ctx_size, labels, prediction): the mean of the visible labels; the default where none is visible or the
    target has no context."""
    every = targets.select("target").withColumn("ctx_size", F.explode(F.array(*map(F.lit, sizes))))
    shown = context.where("is_target").select("target").withColumn("__shown", F.lit(True))
    means = sets.groupBy("target", "ctx_size").agg(F.avg("label").alias("mean"), F.count("label").alias("labels"))
    joined = every.join(spread(shown), "target", "left").join(spread(means), ["target", "ctx_size"], "left")
    guess = F.coalesce(F.when(F.col("__shown"), F.col("mean")), F.lit(DEFAULTS[task_type]))
    return joined.select("target", "ctx_size", F.coalesce("labels", F.lit(0)).cast("long").alias("labels"), guess.alias("prediction"))


def _tally(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in checks:
        one = df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found")
        out = one if out is None else out.unionByName(one)
    return out


def check_contexts(context: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(check, found), all 0 for good contexts(target, node): nodes that don't exist, nodes held twice, nodes later than
    the target, contexts of no target, targets without one."""
    known = nodes.select(F.col("node_id").alias("node"), F.col("ts").alias("__ts"))
    of = targets.select("target", F.col("ts").alias("__cut"))
    return _tally([
        ("unknown node", context.join(spread(known), "node", "left_anti")),
        ("double node", context.groupBy("target", "node").count().where("count > 1")),
        ("later node", context.join(spread(known), "node").join(spread(of), "target").where("__ts > __cut")),
        ("unknown target", context.select("target").distinct().join(spread(of), "target", "left_anti")),
        ("missing target", of.join(spread(context.select("target").distinct()), "target", "left_anti")),
    ])


def check_seed_orders(orders: DataFrame, nodes: DataFrame, targets: DataFrame, complete: bool = False) -> DataFrame:
    """(check, found), all 0 for good orders(target, rank, node): as for contexts; seeds must be of the target's table and
    strictly earlier. Targets without seeds are counted if `complete`."""
    known = nodes.select(F.col("node_id").alias("node"), F.col("ts").alias("__ts"), F.col("table").alias("__table"))
    of = targets.select("target", F.col("ts").alias("__cut"), "table")
    met = orders.join(spread(known), "node").join(spread(of), "target")
    checks = [
        ("unknown node", orders.join(spread(known), "node", "left_anti")),
        ("double node", orders.groupBy("target", "node").count().where("count > 1")),
        ("double rank", orders.groupBy("target", "rank").count().where("count > 1")),
        ("other table", met.where("__table <> table")),
        ("not earlier", met.where("NOT coalesce(__ts < __cut, false)")),
        ("unknown target", orders.select("target").distinct().join(spread(of), "target", "left_anti")),
    ]
    if complete:
        checks.append(("missing target", of.join(spread(orders.select("target").distinct()), "target", "left_anti")))
    return _tally(checks)


def summary(context: DataFrame, by: str) -> DataFrame:
    """Cells, nodes and labels of each target by `node`, `col`, `table`, `seed`, `tier` or `sem`: what a viewer lists."""
    keys = ["table", "col"] if by == "col" else [by]
    facts = [F.count("*").alias("cells"), F.countDistinct("node").alias("nodes"), F.min("pos").alias("first_pos"),
        F.min("depth").alias("depth")]
    return context.groupBy("target", *keys).agg(*facts)


def context_edges(context: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, child, parent): the distinct edges between nodes that one context shows."""
    shown = context.select("target", "node").distinct()
    down = edges.select("child", "parent").distinct().join(spread(shown.withColumnRenamed("node", "child")), "child")
    return down.join(spread(shown.withColumnRenamed("node", "parent")), ["target", "parent"]).select("target", "child", "parent")


def by_column(context: DataFrame) -> DataFrame:
    """Cells with `place`: in each context ordered by column id, equal ones as they stood, padding (no column) last."""
    order = Window.partitionBy("target").orderBy(F.col("col_id").asc_nulls_last(), "pos")
    return context.withColumn("place", F.row_number().over(order) - 1)


def runs(context: DataFrame, key: str, order: str = "place") -> DataFrame:
    """Cells with `starts`: whether the key differs from the one before it in its context."""
    previous = F.lag(key).over(Window.partitionBy("target").orderBy(order))
    first = F.row_number().over(Window.partitionBy("target").orderBy(order)) == 1
    return context.withColumn("starts", first | ~F.col(key).eqNullSafe(previous))


def shown_text(value: Column, most: int = 40) -> Column:
    """A value for display: at most `most` characters, the last of them an ellipsis where it was longer."""
    text = value.cast("string")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def shown_cell(sem: Column, num: Column, text: Column, most: int = 40) -> Column:
    """A cell for display: texts cut, numbers with three places."""
    return F.when(sem == "text", shown_text(text, most)).otherwise(F.format_string("%.3f", num))
