"""Expansion over the foreign-key graph: level by level, joins only.

edges(child, parent, child_ts): nodes are longs. A child is visible from a seed with a time if it is timeless or not
later than the seed; from a timeless seed, if it is timeless. Parents are always visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_rank, hash_uniform
from ..sources.shared import materialise
from .context import by_time
from .history import as_of, spread

#: Node numbers are a table's code times this, plus the key.
SPAN = 1 << 40


#: Seconds of a bucket of children of one parent, and parts in which one is ranked.
BUCKET, PARTS = 30 * 86_400, 64


def _thinned(edges: DataFrame, width: int, seed: int) -> DataFrame:
    """Edges with what a capped expansion needs: a child's bucket of time and its hash rank inside it.

    A bucket that lies wholly before a seed's time can show its first `width` children only, so a hub gives that many for
    each bucket and all of one bucket, not all its children. Children without a time are one bucket. A bucket is ranked in
    parts first, and only the first `width` of each part with each other.
    """
    order = [hash_rank(seed, "parent", "child"), F.col("child")]
    dealt = edges.withColumn("bucket", F.floor(F.col("child_ts") / F.lit(BUCKET))).withColumn("part",
        F.pmod(F.xxhash64("child"), F.lit(PARTS)).cast("int"))
    dealt = dealt.withColumn("k", F.row_number().over(Window.partitionBy("parent", "bucket", "part").orderBy(*order)))
    ahead = F.col("k") <= width
    group = Window.partitionBy("parent", "bucket", F.when(ahead, -1).otherwise(F.col("part"))).orderBy(*order)
    return dealt.withColumn("in_bucket", F.when(ahead, F.row_number().over(group)).otherwise(width + 1)).drop("part", "k")


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, width: int | None = None, seed: int = 0, checkpoint: bool = False,
    task_rule: bool = False) -> DataFrame:
    """(seed, node, depth): every node within `depth` steps, at its smallest depth.

    seeds(seed, node, ts). A node expanded shows all its parents and at most `width` of its visible children, in the
    parent's hash order. The frontier of each level holds only nodes not reached before. With checkpoint=True each level
    is written to the checkpoint folder, so deep expansions keep short lineages. With task_rule=True seeds have `table`
    and edges `child_table` and `child_split`: label rows are shown only to seeds of their own table, and no width holds for them.
    """
    extra = ["table"] if task_rule else []
    reached = seeds.select("seed", "node", "ts", *extra, F.lit(0).alias("depth"))
    frontier = reached
    plain = edges.where("child_split = 'db'") if task_rule else edges
    ranked = plain if width is None else _thinned(plain.select("child", "parent", "child_ts").distinct(), width, seed)
    visible = F.col("child_ts").isNull() | (F.col("child_ts") <= F.col("ts"))
    for level in range(1, depth + 1):
        up = frontier.join(spread(edges), frontier["node"] == edges["child"]).select("seed", "ts", *extra, F.col("parent").alias("node"))
        met = frontier.join(spread(ranked), frontier["node"] == ranked["parent"])
        if width is None:
            down = met.where(visible)
        else:
            whole = F.col("child_ts").isNull() | (F.col("bucket") < F.floor(F.col("ts") / F.lit(BUCKET)))
            down = met.where(visible & (~whole | (F.col("in_bucket") <= width))).select("seed", "ts", *extra, F.col("node").alias("via"),
                "child").distinct()
            rank = F.row_number().over(Window.partitionBy("seed", "via").orderBy(hash_rank(seed, "via", "child"), "child"))
            down = down.withColumn("k", rank).where(F.col("k") <= width)
        found = up.unionByName(down.select("seed", "ts", *extra, F.col("child").alias("node")))
        if task_rule:
            labels = edges.where("child_split <> 'db'").withColumnRenamed("child_table", "__table")
            own = frontier.join(spread(labels), (frontier["node"] == labels["parent"]) & (frontier["table"] == labels["__table"])).where(visible)
            found = found.unionByName(own.select("seed", "ts", *extra, F.col("child").alias("node")))
        frontier = found.distinct().join(spread(reached.select("seed", "node")), ["seed", "node"], "left_anti").select("seed", "node", "ts", *extra,
            F.lit(level).alias("depth"))
        if checkpoint:
            frontier = frontier.checkpoint()
        reached = reached.unionByName(frontier)
    return reached.select("seed", "node", "depth")


def bounded(reached: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Nodes of each seed in order of depth whose cells, added up, stay under the budget. sizes(node, cells)."""
    total = F.sum("cells").over(Window.partitionBy("seed").orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, 0))
    return reached.join(spread(sizes), "node").withColumn("running", total).where(F.col("running") < budget)


def visits(sources: DataFrame, edges: DataFrame, length: int, same_table: int = SPAN, least: float = 1e-9) -> DataFrame:
    """(source, node, visits): expected visits per walk of `length` nodes, to other nodes of the source's table.

    sources(source, ts). A step goes to any parent or visible child (visible from the source), each edge as likely as
    another. Sampling walks would give these numbers with noise. Mass under `least` is dropped at each step, which keeps
    long walks short of memory; least=0 drops nothing.
    """
    mass = sources.select("source", "ts", F.col("source").alias("node"), F.lit(1.0).alias("p"))
    seen = None
    for _ in range(length - 1):
        up = mass.join(spread(edges), mass["node"] == edges["child"]).select("source", "ts", "node", "p", F.col("parent").alias("to"))
        visible = F.col("child_ts").isNull() | F.col("ts").isNull() | (F.col("child_ts") <= F.col("ts"))
        down = mass.join(spread(edges), mass["node"] == edges["parent"]).where(visible).select("source", "ts", "node", "p",
            F.col("child").alias("to"))
        steps = up.unionByName(down)
        degree = steps.groupBy("source", "node").agg(F.count("*").alias("degree"))
        mass = steps.join(spread(degree), ["source", "node"]).groupBy("source", "ts",
            F.col("to").alias("node")).agg(F.sum(F.col("p") / F.col("degree")).alias("p")).where(F.col("p") >= least)
        kept = mass.where((F.floor(F.col("node") / same_table) == F.floor(F.col("source") / same_table))
            & (F.col("node") != F.col("source"))).select("source", "node", "p")
        seen = kept if seen is None else seen.unionByName(kept)
    return seen.groupBy("source", "node").agg(F.sum("p").alias("visits"))


#: Seconds that stand for "no time", before all times.
TIMELESS = -62_000_000_000


def numbered_children(edges: DataFrame) -> DataFrame:
    """(parent, child, t, place, upto): each parent's children by time, timeless ones first, numbered from 0; upto: how many
    are no later. A row a child and no list a parent, so a hub is no heavier than its children."""
    timed = edges.select("child", "parent", F.timestamp_seconds(F.coalesce("child_ts", F.lit(TIMELESS))).cast("timestamp_ntz").alias("t"))
    return by_time(timed, "t", "child", "parent").select("parent", "child", "t", "place", "upto")


def walk_sample(sources: DataFrame, edges: DataFrame, walks: int, length: int, seed: int = 0, same_table: int = SPAN) -> DataFrame:
    """(source, node, visits): visits per walk to other nodes of the source's table, estimated by `walks` walks of `length`
    nodes from each source; what `visits` gives exactly, with a standard error of at most length / sqrt(walks).

    Neighbours are numbered: a node's parents first, then its children by time, so that the visible ones are a prefix. A
    step draws a number by hash and finds the neighbour by an equi-join; a hub's children are never joined as a whole, and a
    step has no more rows than walks. Each step is written to the shared folder. A walk ends where there is no neighbour.
    """
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("to"))
    up = up.withColumn("i", F.row_number().over(Window.partitionBy("at").orderBy("to")) - 1)
    parents = up.groupBy("at").agg(F.count("*").alias("n_up"))
    down = materialise(numbered_children(edges), "children")
    steps = down.groupBy("parent", "t").agg(F.max("upto").alias("upto"))
    drawn = sources.select("source", F.timestamp_seconds(F.coalesce("ts", F.lit(-TIMELESS))).cast("timestamp_ntz").alias("until"))
    walkers = drawn.withColumns({"walk": F.explode(F.sequence(F.lit(1), F.lit(walks))), "at": F.col("source")})
    seen = None
    for step in range(1, length):
        asked = walkers.select("at", "until").distinct()
        visible = as_of(asked, steps, ("at", "parent"), "t", ["upto"], tie="upto", cutoff="until", strict=False).select("at", "until",
            "upto")
        here = walkers.join(visible, ["at", "until"]).join(parents, "at", "left").fillna(0, ["upto", "n_up"])
        here = here.where("upto + n_up > 0").withColumn("draw",
            F.floor(hash_uniform(seed, "source", "walk", F.lit(step)) * (F.col("upto") + F.col("n_up"))).cast("long"))
        above = here.where("draw < n_up").join(up, (here["at"] == up["at"]) & (F.col("draw") == up["i"])).select("source", "until", "walk",
            F.col("to").alias("at"))
        below = here.where("draw >= n_up").join(down, (F.col("at") == F.col("parent"))
            & (F.col("draw") - F.col("n_up") == F.col("place"))).select("source", "until", "walk", F.col("child").alias("at"))
        walkers = materialise(above.unionByName(below), "walkers")
        own = (F.floor(F.col("at") / same_table) == F.floor(F.col("source") / same_table)) & (F.col("at") != F.col("source"))
        met = walkers.where(own).select("source", F.col("at").alias("node"))
        seen = met if seen is None else seen.unionByName(met)
    return seen.groupBy("source", "node").agg((F.count("*") / F.lit(float(walks))).alias("visits"))


def ranked_seeds(visited: DataFrame, times: DataFrame, prefer_latest: bool, seed: int) -> DataFrame:
    """(source, node, rank): by time (none last) then visits, or by visits alone; a hash breaks ties."""
    order = ([F.desc_nulls_last("ts")] if prefer_latest else []) + [F.desc(F.round("visits", 9)), hash_rank(seed, "source", "node"),
        F.col("node")]
    return visited.join(spread(times), "node").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(
        *order))).select("source", "node", "rank")
