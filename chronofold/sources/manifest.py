"""Datasets described by manifests: tables, keys, foreign keys and times, and label tables split by time."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Table:
    """A table's relations; columns that it does not name are plain values."""

    name: str
    pkey: str | None = None
    time_col: str | None = None
    fkeys: dict[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> set[str]:
        return {*self.fkeys, *([self.pkey] if self.pkey else [])}


@dataclass(frozen=True)
class Task:
    """A label table: what is predicted (clf or reg) of which entity at which time."""

    name: str
    entity_table: str
    entity_col: str
    target_col: str
    task_type: str
    time_col: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    leakage: tuple[str, ...] = ()

    @property
    def fkeys(self) -> dict[str, str]:
        return {self.entity_col: self.entity_table, **dict(self.pairs)}


@dataclass(frozen=True)
class Manifest:
    tables: dict[str, Table]

    @staticmethod
    def of(spec: dict) -> Manifest:
        """From a mapping; fields that are not known are ignored."""
        known = ("pkey", "time_col", "fkeys")
        return Manifest({n: Table(n, **{k: v for k, v in (t or {}).items() if k in known and v is not None}) for n, t in spec.items()})

    def table(self, name: str) -> Table:
        """A table that the manifest leaves out has no relations."""
        return self.tables.get(name, Table(name))

    def edges(self) -> list[tuple[str, str, str]]:
        """(child table, foreign key, parent table)"""
        return [(t.name, c, p) for t in self.tables.values() for c, p in t.fkeys.items()]

    def as_dict(self) -> dict:
        return {t.name: {"pkey": t.pkey, "time_col": t.time_col, "fkeys": dict(t.fkeys)} for t in self.tables.values()}


def safe_name(name: str) -> str:
    """A catalog or file name as given, or an error: no path, no empty name."""
    if not name or name in (".", "..") or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


class Files:
    """Text files, listings and deletes through Hadoop's file systems, so any store Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        rows = self.spark.read.text(path, wholetext=True).collect()
        return rows[0][0] if rows else ""

    def move(self, path: str, to: str) -> None:
        """Rename a file over what is there."""
        fs, p = self._at(path)
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        fs.delete(target, True)
        if not fs.rename(p, target):
            raise OSError(f"cannot move {path} to {to}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()


@dataclass
class Database:
    """A dataset folder: manifest.yaml, db/<table>.parquet, tasks/<task>/{manifest.yaml, <split>.parquet}."""

    spark: SparkSession
    path: str
    manifest: Manifest
    tasks: dict[str, Task]
    names: list[str]

    @staticmethod
    def load(spark: SparkSession, path: str, *, skip_tasks: bool = False, skip_db: bool = False) -> Database:
        import yaml

        files = Files(spark)
        spec = yaml.safe_load(files.read(f"{path}/manifest.yaml")) or {}
        names = [] if skip_db else [n.removesuffix(".parquet") for n in files.names(f"{path}/db") if n.endswith(".parquet")]
        tasks = {}
        for name in [] if skip_tasks else files.names(f"{path}/tasks"):
            t = yaml.safe_load(files.read(f"{path}/tasks/{name}/manifest.yaml")) or {}
            kind = "clf" if "class" in str(t.get("task_type", "")) or t.get("task_type") == "clf" else "reg"
            tasks[name] = Task(name, t["entity_table"], t["entity_col"], t["target_col"], kind, t.get("time_col"),
                tuple(map(tuple, (t.get("pairs") or {}).items())), tuple(t.get("leakage") or ()))
        return Database(spark, path, Manifest.of(spec.get("tables", spec)), tasks, names)

    def table(self, name: str, row_col: str | None = None) -> DataFrame:
        """A table, on request with the position of each row in its file."""
        df = self.spark.read.parquet(f"{self.path}/db/{safe_name(name)}.parquet")
        return df.withColumn(row_col, F.col("_metadata.row_index")) if row_col else df

    def splits(self, task: str) -> dict[str, DataFrame]:
        """A task's splits that exist."""
        files, paths = Files(self.spark), {s: f"{self.path}/tasks/{safe_name(task)}/{s}.parquet" for s in SPLITS}
        return {s: self.spark.read.parquet(p) for s, p in paths.items() if files.exists(p)}

    def labels(self, task: str) -> DataFrame:
        """A task's splits that exist, in one frame with `split`."""
        out = None
        for split, df in self.splits(task).items():
            one = df.withColumn("split", F.lit(split))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError(f"no split of {task}")
        return out

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for SQL."""
        for name in self.names:
            self.table(name).createOrReplaceTempView(prefix + name)
        return [prefix + n for n in self.names]


def write_database(tables: dict[str, DataFrame], manifest: Manifest, path: str,
    tasks: dict[str, tuple[Task, dict[str, DataFrame]]] | None = None) -> None:
    """Tables, label splits and manifests in the dataset layout."""
    import yaml

    spark = next(iter(tables.values())).sparkSession
    files = Files(spark)
    for name, df in tables.items():
        df.write.parquet(f"{path}/db/{safe_name(name)}.parquet")
    files.write(f"{path}/manifest.yaml", yaml.safe_dump({"tables": manifest.as_dict()}))
    for name, (task, splits) in (tasks or {}).items():
        spec = {"entity_table": task.entity_table, "entity_col": task.entity_col, "target_col": task.target_col,
            "task_type": task.task_type, "time_col": task.time_col, "pairs": dict(task.pairs), "leakage": list(task.leakage)}
        files.write(f"{path}/tasks/{safe_name(name)}/manifest.yaml", yaml.safe_dump(spec))
        for split, df in splits.items():
            df.write.parquet(f"{path}/tasks/{name}/{safe_name(split)}.parquet")


def import_tables(spark: SparkSession, path: str, database: str) -> list[tuple[str, int]]:
    """Copy all Parquet tables of a folder into a catalog database, all or none; (table, rows) of each.

    Any name that exists already stops the import before a row is written; a failure later drops what was made.
    """
    safe_name(database)
    names = [n.removesuffix(".parquet") for n in Files(spark).names(path) if n.endswith(".parquet")]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    clash = [n for n in map(safe_name, names) if spark.catalog.tableExists(f"`{database}`.`{n}`")]
    if clash:
        raise ValueError(f"tables exist already: {clash}")
    made = []
    try:
        for n in names:
            spark.read.parquet(f"{path}/{n}.parquet").write.mode("errorifexists").saveAsTable(f"`{database}`.`{n}`")
            made.append(n)  # after the write: a table that another session made in the meantime is not ours to drop
        return [(n, spark.table(f"`{database}`.`{n}`").count()) for n in names]
    except Exception:
        for n in made:
            spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{n}`")
        raise


def read_labels(spark: SparkSession, path: str, time_col: str) -> DataFrame:
    """A CSV or Parquet label file with its time column as a timestamp."""
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    kind = df.schema[time_col].dataType.typeName()
    return df if kind in ("timestamp_ntz",) else df.withColumn(time_col, F.col(time_col).cast("timestamp_ntz"))


def read_external(spark: SparkSession, url: str, names: list[str], by: dict[str, tuple[str, int, int]] | None = None, parts: int = 64,
    **options: str) -> dict[str, DataFrame]:
    """Tables of a database over JDBC; its driver must be on the class path.

    by: for a table, a numeric column with its least and largest value, by which it is read in `parts` tasks.
    """
    out = {}
    for n in names:
        reader = spark.read.format("jdbc").options(url=url, dbtable=n, **options)
        if n in (by or {}):
            column, low, high = by[n]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        out[n] = reader.load()
    return out


def positioned(df: DataFrame, name: str) -> DataFrame:
    """A Parquet table with the position of each row from 0: files by path, then rows as they lie.

    Only the files' row counts are added up, one number a file.
    """
    if len(df.inputFiles()) <= 1:
        return df.withColumn(name, F.col("_metadata.row_index"))
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("__c"))
    before = counts.select("__file", (F.sum("__c").over(Window.orderBy("__file")) - F.col("__c")).alias("__before"))
    return placed.join(before, "__file").select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A surrogate key: the row's position in its table."""
    return positioned(df, name)


def export(spark: SparkSession, query: str, path: str, args: list | dict | None = None) -> DataFrame:
    """Write the rows of a query with bound parameters (? or :name) as Parquet, and read them back."""
    spark.sql(query, args=args).write.parquet(path)
    return spark.read.parquet(path)


def discover(spark: SparkSession, root: str, complete: str = "meta.json") -> list[str]:
    """Prepared datasets under a folder: those whose `complete` file is there."""
    files = Files(spark)
    return [n for n in files.names(root) if files.exists(f"{root}/{n}/{complete}")]


def share_of(names: list[str], index: int, of: int, done: set[str] = frozenset()) -> list[str]:
    """The names of one worker out of several, without those that are done."""
    return [n for n in sorted(names)[index::of] if n not in done]


def write_meta(spark: SparkSession, path: str, **facts) -> None:
    Files(spark).write(f"{path}/meta.json", json.dumps({"format": 1, **facts}, indent=1, sort_keys=True, default=str))


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read(f"{path}/meta.json"))


def resolve(spark: SparkSession, name: str, roots: list[str]) -> str:
    """The first root that holds a dataset; stores that must be downloaded from are not asked."""
    files = Files(spark)
    for root in roots:
        if files.exists(where := str(PurePosixPath(root) / safe_name(name)) if "://" not in root else f"{root}/{safe_name(name)}"):
            return where
    raise FileNotFoundError(f"{name} is under none of {roots}")
