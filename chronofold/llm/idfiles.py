"""Token-id files: frequency-ranked ids, one to four bytes each, lengths in separate control bytes.

A record holds a document's ids as ranks (0 for the corpus's most frequent id). Four ids share a control
byte of four two-bit lengths; the control bytes of a record stand before its data bytes. A reader looks the
control bytes up in a table of 256 rows and gathers all ids of a record with numpy. Records lie in shards
in ascending document order; the shard's header table (`ranks`) maps ranks back to ids.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, map_batches, map_stream, materialise, slices
from .wordpieces import Library, coder, vocabulary

END_ID = 2
#: Characters and texts encoded together (a whole Arrow batch as a rule), cuts that a worker keeps (each group numbers them
#: anew, so more cost more than they spare), and records coded together: few, so that arrays stay in its cache.
TOGETHER, TEXTS, CACHE_ENTRIES, RECORDS = 16_000_000, 8192, 500_000, 64
#: Row c: the four lengths, less one, that control byte c stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :]) & 3).astype(np.int64)

#: The least ranks of two, three and four bytes.
STEPS = np.array([1 << 8, 1 << 16, 1 << 24], np.uint32)


def padded_places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records of so many ids each, laid one after another in whole quads: every id's place, and the records' first
    quads, the end of the last included."""
    quads = np.concatenate([[0], np.cumsum(-(-sizes // 4))])
    return np.arange(sizes.sum()) + np.repeat(4 * quads[:-1] - (np.cumsum(sizes) - sizes), sizes), quads


def encode_many(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of records of unsigned 32-bit ranks, sizes[i] of them in record i."""
    extra = np.searchsorted(STEPS, ranks, side="right") if len(ranks) and ranks.max() > 0xFFFF else (ranks > 0xFF).astype(np.int64)
    places, quads = padded_places(sizes)
    padded = np.zeros(4 * int(quads[-1]), np.uint8)
    padded[places] = extra
    four = padded.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    ends = np.cumsum(extra + 1)
    data, at = np.empty(int(ends[-1]) if len(ranks) else 0, np.uint8), ends - (extra + 1)
    data[at] = ranks & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        if not len(more):
            break
        data[at[more] + k] = ranks[more] >> np.uint32(8 * k) & 0xFF
    data, borders = data.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    cut = lambda raw, at: [raw[i:j] for i, j in itertools.pairwise(at.tolist())]
    return cut(control, quads), cut(data, borders)


def decode_many(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The ranks of records whose control bytes and data bytes are given one after another, by table lookup."""
    extra = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[padded_places(sizes)[0]]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(extra + 1) - (extra + 1)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, and write `out`/records and `out`/ranks.

    Texts are encoded once; their ids wait in a shared table while the frequencies are added up (one number
    for each vocabulary entry and task). Null texts are empty, null ids come first, rows of equal id lie in
    an unspecified but fixed order, repeated rows stay. The rank table has a row for each id in use.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def ids(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        got = [np.frombuffer(x + end, "<u4") for x in coder(Library, path, entries=CACHE_ENTRIES, chars=TOGETHER).ids_of(texts)]
        small = [x.astype("<u2").tobytes() if x.max() < 0xFFFF else b"\xff\xff" + x.tobytes() for x in got]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(small, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    staged = materialise(map_batches(rows, ids, "id long, ids binary", rows=TEXTS), "token-ids")

    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices([batch], 1024):
                found = np.bincount(np.concatenate(list(map(wide, part.column("ids").to_pylist()))))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token_id", "n"])

    n_ids = map_stream(staged, counts, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    # At most the vocabulary's size, so the driver may hold it.
    by_count = sorted(n_ids.collect(), key=lambda r: (-r.n, r.token_id))
    ranks = [r.token_id for r in by_count]
    spark.createDataFrame([(i, t, r.n) for i, (t, r) in enumerate(zip(ranks, by_count, strict=True))],
        "rank long, token_id long, n long").coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(max(ranks, default=0) + 1, np.int64)
    rank_of[ranks] = np.arange(len(ranks))
    shared = spark.sparkContext.broadcast(rank_of.astype(np.uint32))

    def code(batches):
        shard, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1024):
            found = list(map(wide, batch.column("ids").to_pylist()))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            control, data = [], []
            for at in range(0, len(found), RECORDS):
                some = slice(at, at + RECORDS)
                for have, more in zip((control, data), encode_many(shared.value[np.concatenate(found[some])], sizes[some]), strict=True):
                    have += more
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            cols = [[shard] * len(found), starts, sizes, control, data]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["id", "shard", "before", "n", "control", "data"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = staged.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("ids"))
    map_stream(ordered, code, "id long, shard int, before long, n long, control binary, data binary").write.option("compression",
        "zstd").parquet(f"{out}/records")
    discard(staged)


def wide(raw: bytes) -> np.ndarray:
    """Staged ids: two bytes each, or four after a mark of two."""
    return np.frombuffer(raw[2:], "<u4") if raw[:2] == b"\xff\xff" else np.frombuffer(raw, "<u2")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(id, start, ids binary): every record decoded; start counts the ids of all records before it."""
    records = spark.read.parquet(f"{out}/records")
    rank_rows = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r.token_id for r in rank_rows], np.uint32))
    # One row for each shard file.
    sizes = sorted(map(tuple, records.groupBy("shard").agg(F.sum("n").alias("n")).collect()))
    starts, total = {}, 0
    for shard, n in sizes:
        starts[shard], total = total, total + n

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.asarray(batch.column("n"), np.int64)
        control, data, raw = batch.column("control").to_pylist(), batch.column("data").to_pylist(), b""
        for at in range(0, len(sizes), RECORDS):
            some = slice(at, at + RECORDS)
            raw += id_of.value[decode_many(b"".join(control[some]), b"".join(data[some]), sizes[some])].astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        ids = [raw[i:j] for i, j in itertools.pairwise([0, *ends])]
        begin = [starts[shard] + before for shard, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(),
            strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(begin, pa.int64()), pa.array(ids, pa.binary())],
            ["id", "start", "ids"])

    return map_batches(records.select("id", "shard", "before", "n", "control", "data"), decode, "id long, start long, ids binary", rows=512)


def op7_ids(spark, sf_dir: str) -> DataFrame:
    """Contract 7 over all documents: write the files, read them back."""
    out = fresh_path(spark, "id-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), out)
    return read_ids(spark, out).select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
