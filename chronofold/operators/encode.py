"""Encoding of relational tables: row ids, statistics, normalised typed cells, dictionary and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import seconds
from ..sources.manifest import Manifest, Table
from ..sources.shared import materialise

NUMBER, TEXT, DATETIME, BOOLEAN = "number", "text", "datetime", "boolean"


def sem_type(kind: T.DataType) -> str:
    """The semantic type of a column; structs and maps are an error."""
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.NumericType, T.DayTimeIntervalType)):
        return NUMBER
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType)):
        return TEXT
    raise TypeError(f"no cell type for {kind.simpleString()}")


def normalised(df: DataFrame) -> DataFrame:
    """Dates as timestamps, binary and lists as text, intervals as microseconds, decimals as double."""
    out = []
    for f in df.schema:
        c, k = F.col(f.name), f.dataType
        if isinstance(k, (T.DateType, T.TimestampType)):
            c = c.cast("timestamp_ntz")
        elif isinstance(k, T.BinaryType):
            c = F.decode(c, "UTF-8")
        elif isinstance(k, T.ArrayType):
            c = F.to_json(c)
        elif isinstance(k, T.DecimalType):
            c = c.cast("double")
        elif isinstance(k, T.DayTimeIntervalType):
            c = F.expr((
                f"CAST(EXTRACT(DAY FROM `{f.name}`) AS BIGINT) * 86400000000 + CAST(EXTRACT(HOUR FROM `{f.name}`) AS BIGINT) * "
                f"3600000000 + CAST(EXTRACT(MINUTE FROM `{f.name}`) AS BIGINT) * 60000000 + CAST(EXTRACT(SECOND FROM "
                f"`{f.name}`) * 1000000 AS BIGINT)"
            ))
        out.append(c.alias(f.name))
    return df.select(*out)


def value_columns(df: DataFrame, table: Table) -> dict[str, str]:
    """Semantic types of the columns that make cells: all but keys."""
    return {f.name: sem_type(f.dataType) for f in df.schema if f.name not in table.keys}


def as_number(name: str, kind: str) -> Column:
    """A value as double: booleans 0 and 1, times in days since 1970, NaN as null."""
    if kind == DATETIME:
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double") / 86400000000.0
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def column_stats(df: DataFrame, table: Table, by: list[str] | None = None) -> DataFrame:
    """(by..., col, sem, n, mean, std): sample deviation, and 1 where it is 0 or unknown. One pass over the table."""
    by = by or []
    kinds = {c: k for c, k in value_columns(df, table).items() if k in (NUMBER, BOOLEAN) and c not in by}
    aggs = [x for c, k in kinds.items() for x in (F.count(as_number(c, k)).alias(f"n_{c}"), F.avg(as_number(c, k)).alias(f"m_{c}"),
        F.stddev_samp(as_number(c, k)).alias(f"s_{c}"))]
    if not kinds:
        none = df.select(*by).limit(0)
        return none.select(*by, *[F.lit(None).cast(k).alias(c) for c,
            k in (("col", "string"), ("sem", "string"), ("n", "long"), ("mean", "double"), ("std", "double"))])
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("sem"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"),
        guarded(F.col(f"s_{c}")).alias("std")) for c, k in kinds.items()])
    return wide.select(*by, F.inline(rows))


def guarded(std: Column) -> Column:
    return F.when(std.isNull() | F.isnan(std) | (std == 0), 1.0).otherwise(std)


def datetime_stats(tables: dict[str, DataFrame], manifest: Manifest) -> DataFrame:
    """One mean and population deviation over every time value of every table, keys apart."""
    parts = None
    for name, df in tables.items():
        for c, k in value_columns(df, manifest.table(name)).items():
            if k == DATETIME:
                v = as_number(c, k)
                one = df.agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
                parts = one if parts is None else parts.union(one)
    # Moments are added up, so each table is read once and a handful of rows meet.
    total = parts.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "var")).alias("p"))
    spread = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["n"] * (p["var"] + F.pow(p["mean"] - F.col("mean"), 2)))
    return total.select("n", "mean", F.sqrt(spread / F.col("n")).alias("std"))


def train_stats(stats: DataFrame, split: str = "split") -> DataFrame:
    """Statistics of the training split for all splits, by column name."""
    return stats.select("table" if "table" in stats.columns else "col", *([] if "table" not in stats.columns else ["col"]), split).join(
        stats.where(F.col(split) == "train").drop(split), [c for c in ("table", "col") if c in stats.columns], "left")


def cells(df: DataFrame, table: Table, row: Column, stats: DataFrame, time_stats: DataFrame,
    kinds: dict[str, str] | None = None) -> DataFrame:
    """(row_idx, table, col, sem, num, text): a row for each value that is neither null, NaN nor a key.

    The table is read once: an array of its cells is unfolded. Numbers are z-scored with the column's statistics,
    times with the global ones; an infinite score is an error. `kinds` names the columns to take, all but keys if unset.
    """
    kinds = value_columns(df, table) if kinds is None else kinds
    entry = lambda c, k: F.struct(F.lit(c).alias("col"), F.lit(k).alias("sem"),
        (F.lit(None).cast("double") if k == TEXT else as_number(c, k)).alias("raw"),
        (F.col(c).cast("string") if k == TEXT else F.lit(None).cast("string")).alias("text"))
    long = df.select(row.alias("row_idx"), F.explode(F.array(*[entry(c, k) for c, k in kinds.items()])).alias("x")).select("row_idx",
        "x.*").where("raw IS NOT NULL OR text IS NOT NULL")
    known = stats.select("col", "mean", "std").unionByName(time_stats.select(F.explode(F.array(*[F.lit(c) for c,
        k in kinds.items() if k == DATETIME] or [F.lit(None).cast("string")])).alias("col"), "mean", "std"))
    scored = long.join(F.broadcast(known), "col", "left").withColumn("num", (F.col("raw") - F.col("mean")) / guarded(F.col("std")))
    checked = F.when(F.abs(F.col("num")) == float("inf"), F.raise_error(F.concat(F.lit("infinite value in "),
        F.col("col")))).otherwise(F.col("num"))
    return scored.select("row_idx", F.lit(table.name).alias("table"), "col", "sem", checked.cast("double").alias("num"), "text")


def vocabulary(frames: list[DataFrame]) -> DataFrame:
    """(text, n): the distinct strings of all given one-column frames, counted after map-side addition."""
    out = frames[0].toDF("text")
    for f in frames[1:]:
        out = out.unionByName(f.toDF("text"))
    return out.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n"))


def with_text_ids(vocab: DataFrame) -> DataFrame:
    """Dense ids by text order, as txt_id.

    The texts are sorted by ranges into files once, and both the files' sizes and the places in them are read from there:
    ranges are cut by a sample, which is not the same when it is drawn again.
    """
    sorted_once = materialise(vocab.repartitionByRange("text").sortWithinPartitions("text"), "vocabulary")
    placed = sorted_once.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__k"))
    counts = placed.groupBy("__file").agg(F.count("*").alias("__c"))
    number = F.regexp_extract("__file", "^part-([0-9]+)", 1).cast("long")
    before = counts.select("__file", (F.sum("__c").over(Window.orderBy(number, "__file")) - F.col("__c")).alias("__before"))
    return placed.join(before, "__file").select(*vocab.columns, (F.col("__before") + F.col("__k")).alias("txt_id"))


def offsets(counts: DataFrame) -> DataFrame:
    """(table, n, node_offset): running offsets in name order over (table, n)."""
    w = Window.orderBy("table").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("node_offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def edges(tables: dict[str, DataFrame], manifest: Manifest) -> DataFrame:
    """(child_table, child, child_ts, fk_col, parent_table, parent): every non-null foreign key, lists unfolded.

    Keys are named by primary key; children without one are left out, as nothing can name them.
    """
    out = None
    for child, fk, parent in manifest.edges():
        t = manifest.table(child)
        if child not in tables or not t.pkey:
            continue
        df = tables[child]
        key = F.explode(fk) if isinstance(df.schema[fk].dataType, T.ArrayType) else F.col(fk)
        ts = seconds(t.time_col) if t.time_col and sem_type(df.schema[t.time_col].dataType) == DATETIME else F.lit(None).cast("long")
        one = df.select(F.lit(child).alias("child_table"), F.col(t.pkey).cast("long").alias("child"), ts.alias("child_ts"),
            F.lit(fk).alias("fk_col"), F.lit(parent).alias("parent_table"), key.alias("__key"))
        one = one.where("__key IS NOT NULL" + (" AND NOT isnan(__key)" if isinstance(one.schema["__key"].dataType,
            (T.DoubleType, T.FloatType)) else "")).withColumn("parent", F.col("__key").cast("long")).drop("__key")
        out = one if out is None else out.unionByName(one)
    return out


def adjacency(edge: DataFrame) -> DataFrame:
    """(parent_table, parent, child_table, children): children by time, timeless first, then by key."""
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("child_ts", F.lit(-(2**62))).alias("t"), "child")))
    return edge.groupBy("parent_table", "parent", "child_table").agg(F.transform(ordered, lambda x: x["child"]).alias("children"))


def cyclic_names(columns: DataFrame, seed: int) -> DataFrame:
    """(col, shown): names moved round one cycle in seeded hash order; with two or more, none keeps its own."""
    from ..functions.scalars import hash_rank

    w = Window.orderBy(hash_rank(seed, "col"), "col")
    first = F.first("col").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return columns.select("col", F.coalesce(F.lead("col").over(w), first).alias("shown"))


def boolean_as_number(cell: DataFrame) -> DataFrame:
    return cell.withColumn("sem", F.when(F.col("sem") == BOOLEAN, NUMBER).otherwise(F.col("sem")))


def padded(context: DataFrame, by: str, pos: str, value: str, length: int) -> DataFrame:
    """(by, values, is_padding): each context as arrays of a fixed length; missing places are null and padding."""
    kept = context.where(F.col(pos) < length).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("v"))
    values = F.concat(F.transform("v", lambda x: x[value]), F.array_repeat(F.lit(None).cast(context.schema[value].dataType),
        F.greatest(F.lit(length) - F.size("v"), F.lit(0))))
    return kept.select(by, values.alias("values"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: i >= F.size("v")).alias("is_padding"))


def embedded(texts: DataFrame, column: str, embed: Callable[[list[str]], Iterable[Iterable[float]]] | None = None,
    batch: int = 256) -> DataFrame:
    """(column, embedding) of the distinct texts: by `embed`, which gives a vector for each of a batch of texts and is
    called in the workers, or by hashed character n-grams."""
    if embed is None:
        return hashed_embedding(texts, column)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch).column(0)
                vectors = [list(map(float, v)) for v in embed([t or "" for t in part.to_pylist()])]
                yield pa.RecordBatch.from_arrays([part, pa.array(vectors, pa.list_(pa.float64()))], [column, "embedding"])

    return texts.select(F.col(column).cast("string")).distinct().mapInArrow(run, f"`{column}` string, embedding array<double>")


def hashed_embedding(texts: DataFrame, column: str, dimension: int = 64, width: int = 3) -> DataFrame:
    """(column, embedding): hashed character n-grams with signs, scaled to unit length; no model is needed."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("__t") - width + 1, F.lit(1))),
        lambda i: F.substring(F.col("__t"), i, F.lit(width)))
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(dimension))
    sign = lambda g: F.when(F.pmod(F.xxhash64(F.lit("sign"), g), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    one = texts.select(column).distinct().withColumn("__t", F.concat(F.lit(" "), F.lower(F.coalesce(column, F.lit(""))), F.lit(" ")))
    long = one.select(column, F.explode(grams).alias("g")).select(column, place(F.col("g")).alias("i"),
        sign(F.col("g")).alias("s")).groupBy(column, "i").agg(F.sum("s").alias("s"))
    wide = long.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "s"))).alias("m"),
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return wide.select(column, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.try_divide(F.coalesce(F.try_element_at("m", i), F.lit(0.0)), F.col("norm"))).alias("embedding"))
