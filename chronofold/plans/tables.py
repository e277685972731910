"""The star schema's tables as a relational database: keys, foreign keys and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest

#: The relations of the supplied tables.
STAR = Manifest.of({
    "region": {"pkey": "r_regionkey"},
    "nation": {"pkey": "n_nationkey", "fkeys": {"n_regionkey": "region"}},
    "customer": {"pkey": "c_custkey", "fkeys": {"c_nationkey": "nation"}},
    "supplier": {"pkey": "s_suppkey", "fkeys": {"s_nationkey": "nation"}},
    "part": {"pkey": "p_partkey"},
    "orders": {"pkey": "o_orderkey", "time_col": "o_orderdate", "fkeys": {"o_custkey": "customer"}},
    "lineitem": {"time_col": "l_shipdate", "fkeys": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}},
    "events": {"pkey": "event_id", "time_col": "ts", "fkeys": {"user_id": "customer"}},
})

#: Cutoffs of the forecast tasks over orders, and over events.
ORDER_CUTOFFS = ("1997-01-01", "1998-06-01", "2000-01-01", "2001-03-01")
EVENT_FIRST, EVENT_LAST = "2024-01-08", "2024-01-29"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamped(text: str):
    return F.lit(text).cast("timestamp_ntz")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so results compare across engines.

    Like DuckDB's round, the number is scaled as a double, rounded to a whole one (halves away from zero) and scaled back;
    Spark's own round takes the number's decimals instead, and on 0.5046875 the two differ in the sixth digit. What
    overflows by scaling stays as it is.
    """
    scale = F.lit(10.0**digits)

    def cut(c: str) -> Column:
        scaled = F.col(c) * scale
        return F.when(F.abs(scaled) == float("inf"), F.col(c)).otherwise(F.round(scaled) / scale).alias(c)

    return df.select(*[cut(c) if t == "double" else F.col(c) for c, t in df.dtypes])
