"""From a dataset folder to an encoded one: nodes, typed cells, edges, dictionary, columns, tables and metadata.

A node is a row of a table or of a label split. Nodes are numbered through all tables: first the tables by name, then
the label splits by task and split name. A foreign key names its parent by row position, or with fk="key" by primary key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import seconds
from ..sources.manifest import Database, Files, Manifest, Table, positioned, safe_name, write_meta
from . import encode as E
from .graph import numbered_children

ROW = "__row"


@dataclass(frozen=True)
class Source:
    """One table, or one split of a task's labels; rows are numbered in `__row`."""

    table: Table
    split: str
    df: DataFrame
    rows: int
    offset: int

    @property
    def name(self) -> str:
        return self.table.name


def sources_of(frames: list[tuple[Table, str, DataFrame]]) -> list[Source]:
    """Sources with their offsets, in the order given; frames hold `__row`. Counts are one number a table."""
    out, offset = [], 0
    for table, split, df in frames:
        rows = df.count()
        out.append(Source(table, split, df, rows, offset))
        offset += rows
    return out


def database_sources(db: Database, skip_tasks: bool = False, skip_db: bool = False) -> list[Source]:
    """A dataset's tables by name, then its tasks' splits by task and split name."""
    frames = [] if skip_db else [(db.manifest.table(n), "db", E.normalised(positioned(db.table(n), ROW))) for n in sorted(db.names)]
    for name in [] if skip_tasks else sorted(db.tasks):
        task = db.tasks[name]
        for split, df in sorted(db.splits(name).items()):
            frames.append((Table(name, None, task.time_col, task.fkeys), split, E.normalised(positioned(df, ROW))))
    return sources_of(frames)


def node_id(source: Source) -> Column:
    return F.col(ROW) + F.lit(source.offset)


def node_ts(source: Source) -> Column:
    """Seconds of the row's time; none if the table has no time column, or one that holds no times."""
    t = source.table.time_col
    timed = t in source.df.columns and E.sem_type(source.df.schema[t].dataType) == E.DATETIME
    return seconds(t) if timed else F.lit(None).cast("long")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def nodes(sources: list[Source]) -> DataFrame:
    """(node_id, table, split, row_idx, ts) of every row."""
    return union([s.df.select(node_id(s).alias("node_id"), F.lit(s.name).alias("table"), F.lit(s.split).alias("split"),
        F.col(ROW).alias("row_idx"), node_ts(s).alias("ts")) for s in sources])


def edges(sources: list[Source], fk: str = "position") -> DataFrame | None:
    """(child, parent, child_table, child_split, child_ts, parent_table, fk_col): every foreign key that names a row; lists are
    unfolded. None if there are no foreign keys."""
    if fk not in ("position", "key"):
        raise ValueError("fk is 'position' or 'key'")
    parents, out = {s.name: s for s in sources if s.split == "db"}, []
    for s in sources:
        for column, parent_name in s.table.fkeys.items():
            p = parents.get(parent_name)
            if p is None or column not in s.df.columns:
                continue
            kind = s.df.schema[column].dataType
            key = F.explode(column) if isinstance(kind, T.ArrayType) else F.col(column)
            one = s.df.select(node_id(s).alias("child"), F.lit(s.name).alias("child_table"), F.lit(s.split).alias("child_split"),
                node_ts(s).alias("child_ts"), F.lit(parent_name).alias("parent_table"), F.lit(column).alias("fk_col"), key.alias("__key"))
            floating = isinstance(one.schema["__key"].dataType, (T.DoubleType, T.FloatType))
            one = one.where("__key IS NOT NULL" + (" AND NOT isnan(__key)" if floating else ""))
            if fk == "position" or not p.table.pkey:
                outside = (F.col("__key") < 0) | (F.col("__key") >= p.rows)
                place = F.when(outside, F.raise_error(F.concat(F.lit(f"{s.name}.{column} names no row of {parent_name}: "),
                    F.col("__key").cast("string"))).cast("long")).otherwise(F.col("__key").cast("long"))
                one = one.withColumn("parent", place + p.offset)
            else:
                keys = p.df.select(F.col(p.table.pkey).alias("__pkey"), node_id(p).alias("parent"))
                one = one.join(keys, F.col("__key") == F.col("__pkey"))
            out.append(one.select("child", "parent", "child_table", "child_split", "child_ts", "parent_table", "fk_col"))
    return union(out) if out else None


def column_names(sources: list[Source]) -> list[str]:
    """"<column> of <table>" of every cell column, in order; a column's id is its place."""
    return sorted({f"{c} of {s.name}" for s in sources for c in E.value_columns(s.df.drop(ROW), s.table)})


def cells(sources: list[Source]) -> DataFrame:
    """(node_id, table, split, col, col_id, sem, num, text): a row for each value that is neither null, NaN nor a key.

    Label splits are scored with the training split's statistics, by column name; times with those of all tables.
    """
    times = E.datetime_stats({f"{s.name}/{s.split}": s.df.drop(ROW) for s in sources},
        Manifest({f"{s.name}/{s.split}": Table(f"{s.name}/{s.split}", s.table.pkey, s.table.time_col, s.table.fkeys) for s in sources}))
    ids = {name: i for i, name in enumerate(column_names(sources))}
    train = {s.name: s for s in sources if s.split == "train"}
    out = []
    for s in sources:
        fit = train.get(s.name, s)
        stats = E.column_stats(fit.df.drop(ROW), fit.table)
        one = E.cells(s.df, s.table, node_id(s), stats, times, E.value_columns(s.df.drop(ROW), s.table)).withColumnRenamed("row_idx",
            "node_id")
        own = F.create_map(*[x for c in E.value_columns(s.df.drop(ROW), s.table) for x in (F.lit(c),
            F.lit(ids[f"{c} of {s.name}"]))] or [F.lit(""), F.lit(0)])
        out.append(one.select("node_id", "table", F.lit(s.split).alias("split"), "col", own[F.col("col")].alias("col_id"), "sem", "num",
            "text"))
    return union(out)


def dictionary(sources: list[Source], cell: DataFrame) -> DataFrame:
    """(text, n, txt_id): the strings of all text cells, the tables' names and the columns' names."""
    spark = cell.sparkSession
    names = sorted({s.name for s in sources}) + column_names(sources)
    named = spark.createDataFrame([(n,) for n in names], "text string")
    return E.with_text_ids(E.vocabulary([cell.where("sem = 'text'").select("text"), named]))


def prepare(spark: SparkSession, dataset: str, out: str, *, source: str | None = None, skip_tasks: bool = False, skip_db: bool = False,
    skip_graph: bool = False, fk: str = "position") -> dict:
    """Encode a dataset folder into `out` and return its metadata, which is written last: a folder without it is unfinished.

    nodes, cells and edges are Parquet, dealt by table; adjacency numbers each parent's children by time; vocab holds (text, n, txt_id), columns (col_id, name), tables
    (table, split, n, node_offset). With skip_graph there are no edges and no adjacency.
    """
    db = Database.load(spark, dataset, skip_tasks=skip_tasks, skip_db=skip_db)
    parts = database_sources(db, skip_tasks, skip_db)
    if not parts:
        raise ValueError(f"nothing to encode in {dataset}")
    files = ["nodes", "cells", "vocab", "columns", "tables"]
    nodes(parts).write.partitionBy("table").parquet(f"{out}/nodes")
    cells(parts).write.partitionBy("table").parquet(f"{out}/cells")
    dictionary(parts, read(spark, out, "cells")).write.parquet(f"{out}/vocab")
    spark.createDataFrame(list(enumerate(column_names(parts))), "col_id int, name string").coalesce(1).write.parquet(f"{out}/columns")
    spark.createDataFrame([(s.name, s.split, s.rows, s.offset) for s in parts],
        "table string, split string, n long, node_offset long").coalesce(1).write.parquet(f"{out}/tables")
    if not skip_graph and (edge := edges(parts, fk)) is not None:
        edge.write.partitionBy("parent_table").parquet(f"{out}/edges")
        numbered_children(read(spark, out, "edges")).select("parent", "place", "child", "upto").write.parquet(f"{out}/adjacency")
        files += ["edges", "adjacency"]
    facts = {
        "source": source or dataset,
        "nodes": sum(s.rows for s in parts),
        "cells": read(spark, out, "cells").count(),
        "texts": read(spark, out, "vocab").count(),
        "tables": [{"table": s.name, "split": s.split, "n": s.rows, "node_offset": s.offset} for s in parts],
        "tasks": {n: {"entity_table": t.entity_table, "entity_col": t.entity_col, "target_col": t.target_col,
            "task_type": t.task_type} for n, t in db.tasks.items()},
        "files": sorted(files),
    }
    write_meta(spark, out, **facts)
    return facts


def prepare_many(spark: SparkSession, datasets: dict[str, str], out_root: str, *, index: int = 0, of: int = 1, skip_existing: bool = True,
    **options) -> dict[str, str]:
    """(name: "done", "skipped" or the error) of this worker's share of datasets {name: folder}; one that fails stops no other."""
    files, report = Files(spark), {}
    for name in sorted(datasets)[index::of]:
        out = f"{out_root}/{safe_name(name)}"
        if skip_existing and files.exists(f"{out}/meta.json"):
            report[name] = "skipped"
            continue
        try:
            files.delete(out)
            prepare(spark, datasets[name], out, **options)
            report[name] = "done"
        except Exception as failed:  # noqa: BLE001 - reported for this dataset, the others go on
            report[name] = f"{type(failed).__name__}: {failed}"
    return report


def read(spark: SparkSession, path: str, what: str) -> DataFrame:
    """A part of an encoded dataset: nodes, cells, edges, adjacency, vocab, columns or tables."""
    return spark.read.parquet(f"{path}/{safe_name(what)}")


def times_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(node_id, ts) of the nodes asked for; ids(node_id)."""
    return read(spark, path, "nodes").select("node_id", "ts").join(ids, "node_id", "left_semi")


def column_id(spark: SparkSession, path: str, column: str, table: str) -> int:
    """The id of "<column> of <table>", or a KeyError."""
    found = read(spark, path, "columns").where(F.col("name") == f"{column} of {table}").first()
    if found is None:
        raise KeyError(f"{column} of {table}")
    return found["col_id"]
