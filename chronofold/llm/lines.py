"""Line deduplication across documents: normalised lines are hashed, a hash's documents are counted, and
lines that several documents hold stay only in the smallest of them."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts_of

#: Fixed value: the white space stripped from a line's ends.
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The hash of each line's key; None where the key has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8").split(b"\n"):
        key = line.strip(BLANKS).lower()  # of bytes, lower() changes A-Z alone
        short = len(key) < least or (not key.isascii() and len(key.decode("utf-8")) < least)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def drop_lists(docs: DataFrame, least: int = 10, documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, alt, drops array<binary>): for each document, the keys it must lose.

    A key counts once for each document. Rows with null ids are documents told apart by `alt`, a hash of their text; they
    come after all others, in the order of their hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), nameless(id_col, text_col).alias("alt"),
        F.col(text_col).cast("string").alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, alts, keys = [], [], []
        for doc, alt, text in zip(batch.column("id").to_pylist(), batch.column("alt").to_pylist(), texts_of(batch), strict=True):
            own = {k for k in line_keys(text, least) if k}
            ids += [doc] * len(own)
            alts += [alt] * len(own)
            keys += own
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(alts, pa.int64()), pa.array(keys, pa.binary())],
            ["id", "alt", "key"])

    held = materialise(map_batches(rows, hashed, "id long, alt long, key binary"), "line-keys")
    keeper = [F.min("id").alias("keeper"), F.min("alt").alias("alt_keeper")]
    if documents == 2:  # two documents or more: the smallest and the largest differ, so no distinct count is needed
        several = held.groupBy("key").agg(*keeper, F.max("id").alias("last"), F.max("alt").alias("alt_last"))
        several = several.where("keeper < last OR alt_keeper < alt_last OR (keeper IS NOT NULL AND alt_keeper IS NOT NULL)")
    else:
        once = held.select("key", "id", "alt").distinct()
        several = once.groupBy("key").agg(F.count("*").alias("n"), *keeper).where(F.col("n") >= documents)
    several = materialise(several.select("key", "keeper", "alt_keeper"), "shared-lines")
    losing = held.join(several, "key").where("CASE WHEN id IS NOT NULL THEN id <> keeper ELSE keeper IS NOT NULL OR alt <> alt_keeper END")
    return losing.groupBy("id", "alt").agg(F.collect_set("key").alias("drops"))


def nameless(id_col: str, text_col: str):
    """A hash of the text where the id is null, else null."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def dedup_lines(docs: DataFrame, least: int = 10, documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` reassembled from the lines that stay, and two columns: cf_lines, cf_dropped.

    A null or empty text is one empty line and stays as it is. All rows and columns are kept, whatever they are named.
    """
    drops = drop_lists(docs, least, documents, id_col, text_col)
    names = docs.columns
    place = names.index(text_col)
    cells = docs.select("*", nameless(id_col, text_col)).toDF(*(f"c{i}" for i in range(len(names))), "a")
    met = F.col(f"c{names.index(id_col)}").cast("long").eqNullSafe(drops["id"]) & cells["a"].eqNullSafe(drops["alt"])
    joined = cells.join(drops, met, "left").select(*(f"c{i}" for i in range(len(names))), "drops")

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, drops in zip(batch.column(place).to_pylist(), batch.column("drops").to_pylist(), strict=True):
            n_lines.append((text or "").count("\n") + 1)
            if drops and text:
                gone = set(drops)
                lines = [x for x, k in zip(text.split("\n"), line_keys(text, least), strict=True) if k not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                text = "\n".join(lines)
            else:
                n_dropped.append(0)
            texts.append(text)
        cols = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            [*(f"c{i}" for i in range(len(names))), "cf_lines", "cf_dropped"])

    fields = ", ".join(f"c{i} {'string' if i == place else docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    return map_batches(joined, kept, f"{fields}, cf_lines long, cf_dropped long").toDF(*names, "cf_lines", "cf_dropped")


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Contract 6 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("cf_lines").alias("n_lines"), F.col("cf_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r AS rowid_, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT lines.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
