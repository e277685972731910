"""Task lists: selection, include files, automatic tasks, stored features and run logs."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import BOOLEAN, NUMBER, value_columns
from ..sources.manifest import Files, Table


@dataclass(frozen=True)
class TaskSpec:
    """What is predicted: a column of a table of a database, as classification (clf) or regression (reg)."""

    db: str
    table: str
    target: str
    task_type: str
    split: str = "test"
    leakage: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"{self.db}/{self.table}"


def include_list(text: str) -> list[str]:
    """Names of an include file, one a line; what follows # is comment, blank lines are skipped."""
    return [name for line in text.splitlines() if (name := line.split("#", 1)[0].strip())]


def select(tasks: Iterable[TaskSpec], names: Iterable[str] | None = None, task_type: str | None = None,
    split: str | None = None) -> list[TaskSpec]:
    """Tasks of the named databases or `db/task` names, of a type and of a split; names that fit nothing are an error."""
    every = list(tasks)
    if names is not None:
        wanted = set(names)
        known = {t.db for t in every} | {t.name for t in every}
        if wanted - known:
            raise ValueError(f"no such tasks: {sorted(wanted - known)}")
        every = [t for t in every if t.db in wanted or t.name in wanted]
    return [t for t in every if task_type in (None, t.task_type) and split in (None, t.split)]


def autocomplete_tasks(db: str, df: DataFrame, table: Table) -> list[TaskSpec]:
    """A task for each boolean (classification) and number (regression) column, by declared types."""
    kinds = {BOOLEAN: "clf", NUMBER: "reg"}
    return [TaskSpec(db, table.name, c, kinds[k]) for c, k in value_columns(df, table).items() if k in kinds]


def store_features(features: DataFrame, path: str, key: str = "node") -> None:
    """Feature vectors as Parquet by key, with a note of their columns beside them."""
    features.write.parquet(f"{path}/features")
    Files(features.sparkSession).write(f"{path}/meta.json", json.dumps({"key": key, "columns": [c for c in features.columns if c != key]}))


def stored_features(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """The stored features of the nodes asked for, by a join on their key; nodes without any have nulls."""
    meta = json.loads(Files(spark).read(f"{path}/meta.json"))
    return nodes.select(meta["key"]).join(spark.read.parquet(f"{path}/features"), meta["key"], "left")


class RunLog:
    """Seconds of each stage and metric lines of a run, written as JSON."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.metrics: list[dict] = []

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def metric(self, **values) -> None:
        self.metrics.append(values)

    def write(self, spark: SparkSession, path: str) -> None:
        files = Files(spark)
        files.write(f"{path}/runtime.json", json.dumps({"stages": self.seconds, "total": sum(self.seconds.values())}))
        files.write(f"{path}/metrics.jsonl", "".join(json.dumps(m) + "\n" for m in self.metrics))


def context_summary(context: DataFrame, by: str = "target") -> DataFrame:
    """(by, node, table, cells, depth, first): what a context holds of each node, for inspection."""
    return context.groupBy(by, "node", "table").agg(F.count("*").alias("cells"), F.min("depth").alias("depth"), F.min("pos").alias("first"))
