"""Contexts of label rows: ordered neighbourhoods, budgets, seed orders and label cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_rank, hash_uniform
from .history import spread


def neighborhood(targets: DataFrame, entities: DataFrame, labels: DataFrame, sources: list[DataFrame], width: int) -> DataFrame:
    """(target, pos, node, depth): the fixed neighbourhood of every target, one plan for all.

    targets(target, entity, cutoff); entities(entity, node); labels(entity, node, time), strictly before the cutoff;
    each source(entity, node, time, parents array<struct<node, depth>>), at the cutoff or before. First the entity
    (depth 1), then its latest labels (2), then the sources in turn by recency rank, each row (2) followed by its
    parents. A node stands where it comes first. `width` rows are taken of the labels and of each source, ranked
    before any parent is looked at.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    node = F.array(F.struct(F.col("node"), F.lit(2).alias("depth")))

    def latest(facts: DataFrame, strict: bool) -> DataFrame:
        test = (targets["entity"] == facts["entity"]) & ((facts["time"] < targets["cutoff"]) if strict
            else (facts["time"] <= targets["cutoff"]))
        met = targets.join(spread(facts), test).select("target", facts["time"], *[facts[c] for c in facts.columns if c not in ("entity", "time")])
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("time"),
            "node"))).where(F.col("rank") <= width)

    first = targets.join(spread(entities), "entity").select("target", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("source"),
        F.array(F.struct("node", F.lit(1).alias("depth"))).alias("nodes"))
    parts = first.unionByName(latest(labels, True).select("target", F.lit(1).alias("part"), "rank", F.lit(0).alias("source"),
        node.alias("nodes")))
    for i, source in enumerate(sources):
        parts = parts.unionByName(latest(source, False).select("target", F.lit(2).alias("part"), "rank", F.lit(i).alias("source"),
            F.concat(node, "parents").alias("nodes")))
    long = parts.select("target", "part", "rank", "source", F.posexplode("nodes").alias("place", "x")).select("target", "part", "rank",
        "source", "place", "x.node", "x.depth").where("node IS NOT NULL")
    order = F.struct("part", "rank", "source", "place")
    seen = long.groupBy("target", "node").agg(F.min(order).alias("o"), F.min_by("depth", order).alias("depth"))
    return seen.select("target", (F.row_number().over(Window.partitionBy("target").orderBy("o")) - 1).alias("pos"), "node", "depth")


def budget_prefix(ordered: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each context whose running size stays under the budget; the row that crosses it and all later go."""
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("running", total).where(F.col("running") < budget)


def nested_sizes(context: DataFrame, pos: str, sizes: list[int]) -> DataFrame:
    """Each row once for every context size that it falls into: prefixes of one order."""
    fits = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col(pos) < s)
    return context.withColumn("ctx_size", F.explode(fits))


def seed_order(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, rank, node): the entity's labels strictly earlier than the target, latest first, then by id."""
    past = labels.select(F.col("entity").alias("__entity"), F.col("time").alias("__time"), F.col("node").alias("__node"))
    own = targets.join(spread(past), (F.col("entity") == F.col("__entity")) & (F.col("__time") < F.col("cutoff")))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("__time"), "__node"))
    return own.select("target", rank.alias("rank"), F.col("__node").alias("node"))


def balanced(seeds: DataFrame, by: str, rank: str, positive: str, seed: int) -> DataFrame:
    """(..., place): negatives and positives drawn in turn, a hashed coin choosing who comes first of each pair."""
    inside = F.row_number().over(Window.partitionBy(by, positive).orderBy(rank))
    coin = hash_uniform(seed, by, "__k") < 0.5
    ordered = seeds.withColumn("__k", inside).withColumn("__first", F.when(coin == F.col(positive), 0).otherwise(1))
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__k", "__first"))).drop("__k", "__first")


#: Parts in which the rows of one time are ranked.
TIME_PARTS = 64


def by_time(rows: DataFrame, time: str, key: str, by: str | None = None) -> DataFrame:
    """rows with `place`, their position in time order from 0 (of each `by`), and `upto`, the number of rows no later; a
    whole-number key orders equal times, by its remainder first. Rows without a time are left out.

    Counts by time and remainder are added up, by day first, so a task ranks the rows of one time and remainder only.
    """
    part = F.pmod(F.col(key), F.lit(TIME_PARTS)).cast("int")
    dealt = rows.where(F.col(time).isNotNull()).withColumn("__part", part).withColumn("__by", F.col(by) if by else F.lit(0))
    counts = dealt.groupBy("__by", F.col(time).alias("__time"), "__part").agg(F.count("*").alias("__n")).withColumn("__day",
        F.date_trunc("day", "__time"))
    per_day = counts.groupBy("__by", "__day").agg(F.sum("__n").alias("__all"))
    before = per_day.select("__by", "__day", (F.sum("__all").over(Window.partitionBy("__by").orderBy("__day"))
        - F.col("__all")).alias("__days"))
    inside = Window.partitionBy("__by", "__day")
    running = counts.withColumns({
        "__before": F.sum("__n").over(inside.orderBy("__time", "__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"),
        "__upto": F.sum("__n").over(inside.orderBy("__time")),
    })
    placed = running.join(spread(before), ["__by", "__day"]).select(F.col("__by").alias("__b"), "__time", F.col("__part").alias("__p"),
        (F.col("__days") + F.col("__before")).alias("__before"), (F.col("__days") + F.col("__upto")).alias("upto"))
    ranked = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__by", time, "__part").orderBy(key)))
    met = ranked.join(spread(placed), (F.col("__by") == F.col("__b")) & (F.col(time) == F.col("__time")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__k") - 1).alias("place"), "upto")


def fallback(targets: DataFrame, rows: DataFrame, count: int, seed: int, time: str = "time", node: str = "node", tried: int = 3,
    ranked: bool = False) -> DataFrame:
    """(target, node), on request with rank: `count` random rows no later than the target and other than it, or all of
    them where there are fewer.

    Rows have places in time order, so "no later" is a prefix, and a draw is a hashed place joined by equality: no
    target meets all rows. `tried` times `count` places are drawn for each; repeats and the target itself drop out, and
    the first places of all, which come last, fill what is missing then.
    """
    placed = by_time(rows, time, node)
    drawn = placed.select(F.col(node).alias("target"), F.col("upto").alias("__upto")).join(spread(targets.select("target")), "target")
    drawn = drawn.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(tried * count + count + 1))))
    hashed = F.floor(hash_uniform(seed, "target", "__i") * F.col("__upto")).cast("long")
    drawn = drawn.withColumn("place", F.when(F.col("__i") <= tried * count,
        hashed).otherwise(F.col("__i") - (tried * count + 1))).where(F.col("place") < F.col("__upto"))
    once = drawn.groupBy("target", "place").agg(F.min("__i").alias("__i"))
    met = once.join(spread(placed.select("place", node)), "place").where(F.col("target") != F.col(node))
    chosen = met.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("__i"))).where(F.col("rank") <= count)
    return chosen.select("target", node, *(["rank"] if ranked else []))


def masked(cells: DataFrame, most: float, seed: int, keys: list[str], by: str) -> DataFrame:
    """Cells with `masked`: a hashed number under a probability that is itself hashed for each context."""
    return cells.withColumn("masked", hash_uniform(seed, by, *keys) < hash_uniform(seed + 1, by) * most)


def sampled(rows: DataFrame, by: list[str], count: int, seed: int, key: str) -> DataFrame:
    """`count` rows of each group without replacement, in hash order."""
    return rows.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(hash_rank(seed, key),
        key))).where(F.col("draw") <= count)


def label_leak(cells: DataFrame, target_time: str, time: str, column: str, leakage: list[str]) -> DataFrame:
    """Without leaking columns on the target's row and on every row of the same time (null times are equal)."""
    return cells.where(~(F.col(time).eqNullSafe(F.col(target_time)) & F.col(column).isin(leakage)))


def relation_counts(cells: DataFrame, by: str = "target") -> DataFrame:
    """(by, pos, feat, nbr, col): for each cell, how many cells of its context stand in each relation to it.

    cells(by, pos, node, column, parents array). feat: on the same row or one of its parents; nbr: on a child of its
    row; col: in the same column. Counts by row and column are joined, so no pair of cells is ever formed.
    """
    rows = cells.groupBy(by, "node").agg(F.count("*").alias("n"), F.first("parents").alias("parents"))
    up = rows.select(by, F.col("node").alias("child"), "n", F.explode("parents").alias("node"))
    own = rows.select(by, F.col("node").alias("child"), F.col("node"))
    reach = up.select(by, "child", "node").unionByName(own.select(by, "child", "node")).distinct()
    feat = reach.join(spread(rows.select(by, "node", "n")), [by, "node"]).groupBy(by, F.col("child").alias("node")).agg(F.sum("n").alias("feat"))
    nbr = up.groupBy(by, "node").agg(F.sum("n").alias("nbr"))
    same = cells.groupBy(by, "column").agg(F.count("*").alias("col"))
    out = cells.join(spread(feat), [by, "node"], "left").join(spread(nbr), [by, "node"], "left").join(spread(same), [by, "column"], "left")
    return out.select(by, "pos", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("feat", "nbr", "col")])
