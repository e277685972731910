"""Packing by power-of-two decomposition.

A document's ids are split into pieces whose lengths are the powers of two of its length: as many of the
full window as fit, then the binary digits of the rest, longest first. Each piece is a sequence by itself,
so no sequence crosses documents and none is padded; sequences of one length share a range of ids, so a
trainer draws whole batches of equal length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .wordpieces import Library, coder, vocabulary

WINDOW, END_ID = 2048, 1
#: Cuts of texts that a worker keeps and characters that it encodes together: fewer than elsewhere, as packing stands in a
#: pipeline whose workers do more.
CACHE_ENTRIES, TOGETHER = 200_000, 2_000_000
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def binary_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Piece lengths of n tokens, in text order; window is a power of two."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(window.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, the piece's place, its ids (little-endian uint32) and sequence.

    A null or empty text is one piece, the end id. sequence_id holds the length's exponent, the partition and
    a count, so it is unique and ordered by length; a task's rows are replaced together if it runs again.
    Repeated rows are packed each by itself; null ids pass through.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    counts = np.zeros(64, np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        if getattr(run, "task", None) != (task.taskAttemptId() if task else 0):
            run.task = task.taskAttemptId() if task else 0
            counts[:] = 0
        cols: list[list] = [[] for _ in range(7)]
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        for doc, ids in zip(batch.column("id").to_pylist(), coder(Library, path, entries=CACHE_ENTRIES, chars=TOGETHER).ids_of(texts), strict=True):
            ids += end
            at, n = 0, len(ids) // 4
            for length in binary_lengths(n, window):
                power = length.bit_length() - 1
                row = (doc, at, length, ids[4 * at : 4 * (at + length)], n, power << 58 | part << 34 | int(counts[power]), 0)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                counts[power] += 1
                at += length
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, SCHEMA, rows=1024)


def digest(pieces: DataFrame) -> DataFrame:
    """Contract 3's columns of packed pieces."""
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Contract 3 over all documents: a row for each piece, at least one (the end id) for each document, null texts included."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json")))
