"""Deep feature synthesis: aggregates along foreign-key paths, cut at the label row's time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import before


@dataclass(frozen=True)
class Path:
    """A child table of an entity: its foreign key, its time, the numbers to aggregate and its own children."""

    name: str
    table: DataFrame
    fk: str
    key: str | None = None
    time: str | None = None
    numbers: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    children: tuple[Path, ...] = ()


def aggregates(path: Path, extra: list[str] = ()) -> list[Column]:
    """count; max, min, mean and std of numbers; the most frequent category, the smallest among equals."""
    out = [F.count("*").alias(f"{path.name}_count")]
    for c in [*path.numbers, *extra]:
        out += [f(F.col(c).cast("double")).alias(f"{path.name}_{n}_{c}") for n,
            f in (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_samp))]
    return out + [F.mode(c, True).alias(f"{path.name}_mode_{c}") for c in path.categories]


def synthesise(spine: DataFrame, key: str, paths: list[Path], depth: int, cutoff: str = "cutoff") -> DataFrame:
    """The spine with the features of every path down to `depth`.

    At each depth a child row is first given its own children's features, then the rows before the cutoff are
    aggregated; deeper children are cut at the same cutoff through their own time.
    """
    out = spine
    for path in paths:
        if path.time:
            met = before(spine, path.table, [(key, path.fk)], path.time, cutoff).drop("days_ago")
        else:
            met = spine.join(path.table, spine[key] == path.table[path.fk])
        extra: list[str] = []
        if depth > 1 and path.key:
            for child in path.children:
                rows = met.select(F.col(path.key).alias("__k"), F.col(cutoff).alias("__c")).distinct()
                test = (rows["__k"] == child.table[child.fk]) & ((child.table[child.time] < rows["__c"]) if child.time else F.lit(True))
                deep = rows.join(child.table, test).groupBy("__k",
                    "__c").agg(*aggregates(Path(child.name, child.table, child.fk, numbers=child.numbers)))
                made = [c for c in deep.columns if c not in ("__k", "__c")]
                met = met.join(deep, (met[path.key] == deep["__k"]) & (met[cutoff] == deep["__c"]), "left").drop("__k", "__c")
                extra += made
        feats = met.groupBy(key, cutoff).agg(*aggregates(path, extra))
        out = out.join(feats, [key, cutoff], "left")
    return out
