"""Scalar expressions of the feature programs. Everything is double, so no decimal arithmetic creeps in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def num(x: Column | str, default: float = 0.0) -> Column:
    """A number as double, null as the default."""
    return F.coalesce(col(x).cast("double"), F.lit(float(default)))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Calendar-day borders crossed (not elapsed days), as bigint."""
    return F.datediff(col(later), col(earlier)).cast("bigint")


def log_scaled(x, top: float) -> Column:
    """ln(1+x)/ln(top+1), at most 1; a count of null is 0, and values at or under -1 give 0."""
    v = num(x)
    return F.when(v <= -1, 0.0).otherwise(F.least(F.log(1 + v) / F.log(F.lit(float(top) + 1)), F.lit(1.0)))


def log_ratio(x, scale: float) -> Column:
    """ln(1+x)/scale, at most 1."""
    v = num(x)
    return F.when(v <= -1, 0.0).otherwise(F.least(F.log(1 + v) / F.lit(float(scale)), F.lit(1.0)))


def decay(days, tau: float, default: float = 9999) -> Column:
    return F.exp(-num(days, default) / F.lit(float(tau)))


def capped(x, scale: float, default: float) -> Column:
    return F.least(num(x, default) / F.lit(float(scale)), F.lit(1.0))


def centred(x, scale: float) -> Column:
    """A change as a share around one half, within 0..1."""
    return F.least(F.greatest(F.lit(0.5) + num(x) / F.lit(float(scale)), F.lit(0.0)), F.lit(1.0))


def ratio(a, b, default: float) -> Column:
    return F.when(num(b) > 0, num(a) / num(b)).otherwise(F.lit(float(default)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def finite(x) -> Column:
    """Null, NaN and infinities as 0."""
    v = col(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def seconds(time: Column | str) -> Column:
    """Epoch seconds of a timestamp, cut toward zero and held within 32 bits; null for null."""
    micros = F.unix_micros(col(time).cast("timestamp"))
    whole = F.when(micros < 0, -F.floor(-micros / F.lit(1_000_000.0))).otherwise(F.floor(micros / F.lit(1_000_000.0))).cast("bigint")
    return F.when(micros.isNotNull(), F.greatest(F.least(whole, F.lit(2**31 - 1)), F.lit(-(2**31))))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x).cast("double")))


def soft_clip(x, low: float, high: float) -> Column:
    v = F.greatest(F.lit(low) - F.log1p(F.abs(col(x))), col(x))
    return F.least(F.lit(high) + F.log1p(F.abs(v)), v)


def next_power_of_two(n: Column | str) -> Column:
    """The smallest power of two that is at least n (1 for n under 1)."""
    power = F.ceil(F.log2(col(n).cast("double")) - 1e-12)
    return F.when(col(n) <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), power)).cast("bigint")


def hash_rank(seed: int, *keys) -> Column:
    """A reproducible stand-in for a random number that any SQL engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def hash_uniform(seed: int, *keys) -> Column:
    """hash_rank as a number in [0, 1)."""
    return F.conv(F.substring(hash_rank(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def column_name(column, table) -> Column:
    return F.concat(col(column), F.lit(" of "), col(table))


def column_of(name) -> Column:
    """The column's part of "<column> of <table>": what stands before the last " of "."""
    return F.regexp_extract(col(name), "^(.*) of ", 1)


def table_of(name) -> Column:
    """The table's part of "<column> of <table>": what stands after the last " of "."""
    return F.regexp_extract(col(name), "^.* of (.*)$", 1)
