"""Plumbing shared by the text operators: shared-folder tables, Arrow batches, connected groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, fresh_path, materialise, shared_dir

__all__ = ["connected", "discard", "fresh_path", "join_by_key", "map_batches", "map_stream", "materialise", "shared_dir", "slices",
    "texts_of"]


#: The setting that bounds Arrow batches, and the bound: a JVM and a worker each hold some batches of each task.
BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def give_back() -> None:
    """Return to the system what this worker has freed: workers outlive their tasks, and what one holds idle the next ones
    lack."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, after which the worker gives its free memory back.

    Arrow batches of at most BATCH_BYTES are asked for, if the session has a higher bound; nothing but memory depends on it.
    """
    bound = df.sparkSession.conf.get(BOUND, None)
    if bound is None or not bound.rstrip("b").isdigit() or int(bound.rstrip("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(BOUND, f"{BATCH_BYTES}b")

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def slices(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str,
    rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that what is made of long texts is there for few at a time.

    Arrow batches themselves are bounded in bytes; their number of rows stays the session's.
    """

    def run(batches):
        for batch in slices(batches, rows):
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return map_stream(df, run, schema)


#: Rows of one key that a join may send to one task, and the most keys of more that are broadcast.
KEY_ROWS, HOT_KEYS = 256, 50_000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with table(key, weight, ...), which has one row for each key and, as weight, how many rows hold it.

    Keys of many rows are broadcast: with the limit at total / HOT_KEYS rows there are HOT_KEYS of them at most. The rows of
    all others are dealt by key. Both frames are read twice and should be stored ones; rows of no key drop out.
    """
    limit = max(KEY_ROWS, total // HOT_KEYS)
    hot = table.where(F.col(weight) > limit).drop(weight).withColumn("__hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    rest = tagged.where("__hot IS NULL").select(*rows.columns).join(table.where(F.col(weight) <= limit).drop(weight), key)
    return tagged.where("__hot").drop("__hot").unionByName(rest)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Labels fall to the smallest label among neighbours, then jump to their label's label, so chains
    shorten by half a round. Each round is a join and a pre-aggregated minimum; a hub's rows are split
    by the skew-join rule. Edges and labels never reach the driver, only the count of changes does.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"),
        F.least("a", "m").alias("component")), f"{name}-labels")
    while True:
        lowered = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
            .join(labels, "node")
            .select("node", F.least("near", "component").alias("low"), F.col("component").alias("was"))
        )
        lowered = materialise(lowered, f"{name}-low")
        jumped = (
            lowered.join(lowered.select(F.col("node").alias("low"), F.col("low").alias("jump")), "low", "left")
            .select("node", F.least("low", F.coalesce("jump", "low")).alias("component"), "was")
        )
        jumped = materialise(jumped, f"{name}-labels")
        changed = jumped.where("component <> was").limit(1).count()
        discard(labels, lowered)
        labels = jumped.select("node", "component")
        if not changed:
            discard(both)
            return labels
