"""Exact nearest vectors of a query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one pass holds in every task, rows that are compared with them at once, and how many of the
#: queries meet these rows at once: a matrix of their cosines takes 8 MB, and a handful of such are held.
BLOCK_BYTES, ROWS, QUERIES = 32 << 20, 1024, 1024


def _usable(df: DataFrame, key: str, vector: str, time: str | None) -> DataFrame:
    at = F.col(time).cast("long") if time else F.lit(None).cast("long")
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"),
        at.alias("t")).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")


def _passes(queries: DataFrame) -> list[tuple]:
    """The queries in blocks of bounded size: (ids, times, matrix) by dimension, one block in the driver at a time."""
    sized = queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    for d, n in [(r["d"], r["n"]) for r in sized]:
        parts = -(-n * d * 8 // BLOCK_BYTES)
        for i in range(parts):
            rows = queries.where((F.size("v") == d) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == i)).collect()
            if rows:
                yield [r["id"] for r in rows], [r["t"] for r in rows], np.array([r["v"] for r in rows], float)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str, time: str | None = None) -> DataFrame:
    """(query, key, cosine, rank): the k rows most similar to each query, itself left out.

    With `time` (whole numbers), only rows no later than the query count, and rows or queries without a time meet any.
    A block of queries of bounded size is broadcast and the rows pass it once, in numpy; a task keeps k for each query of
    what it read, so what is shuffled is k rows a query and task. Null, zero and other-sized vectors are left out.
    """
    asked, seen = _usable(queries, key, vector, time), _usable(rows, key, vector, time)
    partial = seen.sparkSession.createDataFrame([], f"query long, {key} long, cosine double")
    for ids, times, matrix in _passes(asked):
        partial = partial.unionByName(_against(seen, ids, times, matrix, k, key))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), key))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def _against(rows: DataFrame, ids: list, times: list, matrix: np.ndarray, k: int, key: str) -> DataFrame:
    with np.errstate(all="ignore"):
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((np.array(ids, np.int64),
        np.array([np.inf if t is None else t for t in times], float), unit))

    def best(batches):
        names, cutoffs, unit = shared.value
        top = np.full((len(names), k), -np.inf)
        who = np.full((len(names), k), -1, np.int64)
        for batch in batches:
            lengths = np.array(batch.column("v").value_lengths())
            fits = np.flatnonzero(lengths == unit.shape[1])
            for at in range(0, len(fits), ROWS):
                part = batch.take(pa.array(fits[at : at + ROWS]))
                vs = np.asarray(part.column("v").flatten(), float).reshape(len(part), -1)
                own = np.asarray(part.column("id"))
                when = np.array([-np.inf if t is None else t for t in part.column("t").to_pylist()], float)
                with np.errstate(all="ignore"):
                    vs = (vs / np.linalg.norm(vs, axis=1, keepdims=True)).T
                for q in (slice(i, i + QUERIES) for i in range(0, len(names), QUERIES)):
                    with np.errstate(all="ignore"):
                        cos = unit[q] @ vs
                    cos[~np.isfinite(cos) | (names[q, None] == own[None, :]) | (when[None, :] > cutoffs[q, None])] = -np.inf
                    every, owners = np.hstack([top[q], cos]), np.hstack([who[q], np.broadcast_to(own, cos.shape)])
                    # Best first, by rounded cosine and then by key, as the final ranking has it.
                    order = np.lexsort((owners, -np.round(every, 9)), axis=1)[:, :k]
                    top[q], who[q] = np.take_along_axis(every, order, 1), np.take_along_axis(owners, order, 1)
        some = np.isfinite(top)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, some.sum(1))), pa.array(who[some]), pa.array(top[some])],
            ["query", key, "cosine"])

    return rows.mapInArrow(best, f"query long, {key} long, cosine double")
