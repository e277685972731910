"""Point-in-time history: what was known of an entity before a cutoff.

A spine has one row for each (entity, cutoff). `before` joins facts on the entity with the time test in the
join condition, so the test runs inside the join and partial aggregation follows it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, days_between


def spread(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt by key, and neither is sent through the driver.

    Rows that were unfolded, joined or counted are more than Spark guesses from the files they came from, where a few bytes
    stand for a row; going by the guess, it would gather millions of them in the driver to broadcast them.
    """
    return side.hint("merge")


def before(spine: DataFrame, facts: DataFrame, on: list[tuple[str, str]], time: str, cutoff: str = "cutoff", strict: bool = True,
    how: str = "inner") -> DataFrame:
    """Spine rows with every fact of their entity before the cutoff, and `days_ago`."""
    seen = facts[time] < spine[cutoff] if strict else facts[time] <= spine[cutoff]
    for left, right in on:
        seen = seen & (spine[left] == facts[right])
    return spine.join(spread(facts), seen, how).withColumn("days_ago", days_between(cutoff, time))


def within(spine: DataFrame, facts: DataFrame, on: list[tuple[str, str]], time: str, days: int, cutoff: str = "cutoff",
    how: str = "left") -> DataFrame:
    """Spine rows with the facts of the `days` days after the cutoff: the window of a forecast label."""
    test = (facts[time] > spine[cutoff]) & (facts[time] <= spine[cutoff] + F.expr(f"INTERVAL {days} DAY"))
    for left, right in on:
        test = test & (spine[left] == facts[right])
    return spine.join(spread(facts), test, how)


def spine_of(entities: DataFrame, key: str, cutoffs: list[str]) -> DataFrame:
    """Every entity at every cutoff; the cutoffs are a literal array, so no join is needed."""
    times = F.array(*[F.lit(c).cast("timestamp_ntz") for c in cutoffs])
    return entities.select(key, F.explode(times).alias("cutoff"))


def spine_between(entities: DataFrame, key: str, first: str, last: str, days: int) -> DataFrame:
    """Every entity at regular cutoffs."""
    times = F.expr(f"sequence(TIMESTAMP_NTZ'{first}', TIMESTAMP_NTZ'{last}', INTERVAL {days} DAY)")
    return entities.select(key, F.explode(times).alias("cutoff"))


def as_of(spine: DataFrame, facts: DataFrame, key: tuple[str, str], time: str, values: list[str], tie: str, cutoff: str = "cutoff",
    strict: bool = True) -> DataFrame:
    """The latest fact before each cutoff, without multiplying spine by facts.

    Both sides are laid in one time line for each entity, and the last fact's values are carried forward. One
    shuffle by entity; rows grow as the sum of both sides.
    """
    left, right = key
    packed = F.struct(F.col(time).alias("__time"), *[F.col(v) for v in values])
    fact_first = 1 if strict else 0  # at equal times, spine rows before or after facts
    line = (
        facts.where(F.col(time).isNotNull())
        .select(F.col(right).alias(left), F.col(time).alias("__at"), F.lit(fact_first).alias("__side"), F.col(tie).alias("__tie"),
            packed.alias("__fact"), F.lit(None).cast(spine.schema[cutoff].dataType).alias(cutoff))
        .unionByName(spine.select(left, F.col(cutoff).alias("__at"), F.lit(1 - fact_first).alias("__side"),
            F.lit(None).cast(facts.schema[tie].dataType).alias("__tie"), F.lit(None).alias("__fact"), cutoff), allowMissingColumns=False)
    )
    order = Window.partitionBy(left).orderBy("__at", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = line.withColumn("__last", F.last("__fact", ignorenulls=True).over(order)).where(F.col(cutoff).isNotNull())
    return last.select(left, cutoff, F.col("__last.__time").alias("as_of_time"), *[F.col(f"__last.{v}").alias(v) for v in values])


def sums_before(facts: DataFrame, asked: DataFrame, by: list[str], time: str, values: list[str], cutoff: str = "cutoff") -> DataFrame:
    """(by..., cutoff, values...): for each row of asked(by..., cutoff), the sums of its group's facts strictly before it.

    Facts are added up by time, cutoffs stand between the times in one line; days are summed first, so a task orders the
    times of one group's day, and of a group only its days. Sums of no facts are null.
    """
    timed = facts.groupBy(*by, F.col(time).alias("__t")).agg(*[F.sum(v).alias(v) for v in values]).withColumn("__side", F.lit(1))
    nothing = [F.lit(None).cast(timed.schema[v].dataType).alias(v) for v in values]
    marks = asked.select(*by, F.col(cutoff).alias("__t"), *nothing, F.lit(0).alias("__side")).distinct()
    line = timed.select(*by, "__t", *values, "__side").unionByName(marks).withColumn("__day", F.date_trunc("day", "__t"))
    days = line.groupBy(*by, "__day").agg(*[F.sum(v).alias(v) for v in values])
    run = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__day").alias("__before"),
        *[F.sum(v).over(run).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(*by, "__day").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    summed = line.withColumns({v: F.sum(v).over(inside) for v in values}).where("__side = 0")
    same = F.col("__day") == F.col("__before")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    both = lambda v: F.when(F.col(v).isNotNull() | F.col(f"__{v}").isNotNull(),
        F.coalesce(v, F.lit(0)) + F.coalesce(f"__{v}", F.lit(0))).alias(v)
    return summed.join(spread(earlier), same).select(*by, F.col("__t").alias(cutoff), *map(both, values))


def first_by(value: str | Column, *order) -> Column:
    """FIRST(value ORDER BY ...): the value at the smallest order key; ties are the caller's to break."""
    return F.min_by(value, F.struct(*order))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(value, condition: Column) -> Column:
    return F.sum(F.when(condition, col(value)))


def avg_if(value, condition: Column) -> Column:
    return F.avg(F.when(condition, col(value)))


def dedup_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the first by all columns, so the choice is the same on every run."""
    order = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def zscored(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Columns as finite floats less their mean, over their population deviation (under 1e-8: 1).

    One row of statistics is broadcast; `fit_on` restricts the rows they are taken from.
    """
    from ..functions.scalars import finite

    clean = df.select(*[c for c in df.columns if c not in columns], *[finite(c).alias(c) for c in columns])
    base = clean if fit_on is None else clean.where(fit_on)
    stats = base.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    joined = clean.join(F.broadcast(stats))
    scale = lambda c: F.when(F.col(f"__s_{c}") < 1e-8, 1.0).otherwise(F.col(f"__s_{c}"))
    return joined.select(*[c for c in df.columns if c not in columns],
        *[((F.col(c) - F.col(f"__m_{c}")) / scale(c)).alias(c) for c in columns])
