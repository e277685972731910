"""Near-duplicate vectors by spherical-cap filters.

Filters are directions made of two random unit vectors, one from a code for each half of the (rotated) space.
A vector lies in a filter's cap if its product with the direction reaches a bound. List decoding finds all its
caps without trying each filter: the products with the two codes are sorted, and only sums that can reach the
bound are formed. A vector is also in the cap nearest to it. Vectors that share a cap are compared in double
precision, and a pair counts in the smallest of its common caps only. The bound makes a cap hold a handful of
unrelated vectors at any corpus size. As filters of one pair of codes are not independent, several turned sets of
them are used: as many as find the asked share of random pairs at exactly the least cosine. Where that would
take too many sets, the caps are made larger.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, join_by_key, map_batches, map_stream, materialise

COSINE, MISS, CAP, SEED = 0.9, 0.05, 8, 11
#: Share of pairs at the least cosine that the sets of filters must find together, of so many random ones.
RECALL, TRIALS, MOST_SETS = 0.98, 600, 40
#: Members of a cap compared at once; larger caps are cut into pairs of parts of this size.
PART = 1024


def bound_and_codes(n: int, cosine: float = COSINE, miss: float = MISS, cap: int = CAP) -> tuple[float, int]:
    """The bound in standard deviations, and the size of each half's code, for n vectors."""
    from statistics import NormalDist

    normal, rest = NormalDist(), math.sqrt(1 - cosine * cosine)
    z = normal.inv_cdf(1 - min(0.05, cap / max(n, 1)))
    grid = np.linspace(z, z + 6, 2000)
    near = np.array([normal.cdf((cosine * x - z) / rest) for x in grid])
    both = float(np.trapezoid(np.exp(-grid * grid / 2) / math.sqrt(2 * math.pi) * near, grid))
    return z, max(4, math.ceil(math.sqrt(math.log(1 / miss) / both)))


class Caps:
    """The filters for vectors of one dimension: `sets` turned pairs of codes."""

    def __init__(self, dimension: int, z: float, size: int, sets: int):
        self.dimension, self.half, self.size, self.bound, self.count = dimension, dimension - dimension // 2, size, z * math.sqrt(2 / dimension), sets
        self.sets: dict[int, tuple] = {}

    def codes_of(self, i: int) -> tuple:
        """Set i's turn and codes, made when first asked for."""
        if i not in self.sets:
            rng = np.random.default_rng([SEED, self.dimension, i])
            turn = np.linalg.qr(rng.normal(size=(self.dimension, self.dimension)))[0]
            codes = [rng.normal(size=(self.size, d)) for d in (self.half, self.dimension // 2)]
            self.sets[i] = turn, [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) for c in codes]
        return self.sets[i]

    def of_set(self, vectors: np.ndarray, i: int) -> list[np.ndarray]:
        turn, codes = self.codes_of(i)
        turned = vectors @ turn
        left, right = turned[:, : self.half] @ codes[0].T, turned[:, self.half :] @ codes[1].T
        if not right.shape[1]:
            right = np.zeros_like(left)
        order, out, nearest = np.argsort(-right, axis=1), [], left.argmax(1)
        for a, b, by, top in zip(left, np.take_along_axis(right, order, 1), order, nearest, strict=True):
            able = np.flatnonzero(a >= self.bound - b[0])
            counts = np.searchsorted(-b, a[able] - self.bound, side="right")
            which = np.repeat(able, counts)
            place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            found = which * self.size + by[place] if len(which) else np.array([top * self.size + by[0]])
            out.append(found + i * self.size * self.size)
        return out

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the ascending numbers of the caps it lies in."""
        if not self.count:  # the one cap of all
            return [np.zeros(1, np.int64)] * len(vectors)
        each = [self.of_set(vectors, i) for i in range(self.count)]
        return [np.sort(np.concatenate(caps)) for caps in zip(*each, strict=True)]


def sets_needed(dimension: int, z: float, size: int, cosine: float = COSINE, recall: float = RECALL) -> int | None:
    """How many sets of filters find `recall` of random pairs at exactly `cosine`; the trial is the same on every run.

    None if MOST_SETS do not.
    """
    rng = np.random.default_rng([SEED, dimension])
    x = rng.normal(size=(TRIALS, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    caps, missed = Caps(dimension, z, size, MOST_SETS), np.ones(TRIALS, bool)
    for i in range(MOST_SETS):
        near = zip(caps.of_set(x[missed], i), caps.of_set(y[missed], i), strict=True)
        missed[missed] = [not len(np.intersect1d(a, b, assume_unique=True)) for a, b in near]
        if missed.mean() <= 1 - recall:
            return i + 1
    return None


def filters_needed(n: int, dimension: int, cosine: float = COSINE, miss: float = MISS) -> tuple[float, int, int]:
    """The bound, the size of the codes and the sets for n vectors; caps grow until the trial reaches its recall."""
    cap = CAP
    while True:
        z, size = bound_and_codes(n, cosine, miss, cap)
        if sets := sets_needed(dimension, z, size, cosine):
            return z, size, sets
        if cap >= 0.05 * n:
            raise ValueError(f"{MOST_SETS} sets of the largest caps miss the recall {RECALL} at dimension {dimension}, cosine {cosine}")
        cap *= 2


def unit(raw: bytes) -> np.ndarray:
    """A stored vector at unit length, in double precision: a mark of its dimension and width, then its components."""
    x = np.frombuffer(raw[5:], "<f4" if raw[4] == 4 else "<f8").astype(float)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def named(rows: DataFrame) -> DataFrame:
    """(id, name, raw): a vector's components as doubles and their hash; null for vectors that link with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, raws = [], []
        for v in batch.column("v").to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, "<f8")
            good = x is not None and np.isfinite(x).all() and x.any()
            names.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if good else None)
            with np.errstate(over="ignore"):
                short = good and (x.astype("<f4") == x).all()
            raws.append(len(x).to_bytes(4, "little") + bytes([4 if short else 8]) + x.astype("<f4" if short else "<f8").tobytes() if good
                else None)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.binary()), pa.array(raws, pa.binary())],
            ["id", "name", "raw"])

    return map_batches(rows, run, "id long, name binary, raw binary", rows=2048)


def compare(name: list[bytes], weight: np.ndarray, x: np.ndarray, filters: Caps, cap: int, side: np.ndarray, whole: bool, cosine: float):
    """Links inside one cap, or between its two sides: (names, weights newly linked, smallest name reached)."""
    a = np.arange(len(name)) if whole else np.flatnonzero(side == 0)
    b = a if whole else np.flatnonzero(side == 1)
    linked = x[a] @ x[b].T >= cosine
    if whole:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    keep = np.unique(np.concatenate([a[linked.any(1)], b[linked.any(0)]]))
    smaller = [c[: np.searchsorted(c, cap)] for c in filters.decode(x[keep])]
    columns, at = np.unique(np.concatenate(smaller), return_inverse=True)
    mine = linked
    if len(columns):
        in_cap = np.zeros((len(name), len(columns)), np.float32)
        in_cap[np.repeat(keep, list(map(len, smaller))), at] = 1
        mine = linked & (in_cap[a] @ in_cap[b].T == 0)
    gained = np.zeros(len(name), np.int64)
    np.add.at(gained, a, mine @ weight[b])
    if not whole:
        np.add.at(gained, b, mine.T @ weight[a])
    order = np.argsort(np.array(name, object))
    label = np.empty(len(name), np.int64)
    label[order] = np.arange(len(name))
    while True:
        before = label.copy()
        low_a = np.where(linked, label[b][None, :], len(name)).min(1)
        np.minimum.at(label, a, low_a)
        low_b = np.where(linked, label[a][:, None], len(name)).min(0)
        np.minimum.at(label, b, low_b)
        if (label == before).all():
            break
    return keep, gained, order[label]


def links(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(a, b, gained): for the distinct vectors (name, raw, weight), a name, a smaller name it reaches by links,
    and the weight of vectors newly found linked to a."""
    # A row for each dimension of more than PART vectors; the fewer of any other are all compared with each other.
    many = vectors.groupBy(F.substring("raw", 1, 4).alias("mark")).agg(F.count("*").alias("n")).where(F.col("n") > PART).collect()
    sized = {d: filters_needed(r.n, d, cosine, miss) for r in many for d in [int.from_bytes(r.mark, "little")]}

    def filters_for():
        made: dict[int, Caps] = {}
        return lambda d: made.get(d) or made.setdefault(d, Caps(d, *sized.get(d, (0.0, 1, 0))))

    def caps_of(batches):
        filters = filters_for()
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            caps: list = [None] * len(raws)
            dims = [int.from_bytes(r[:4], "little") for r in raws]
            for d in set(dims):
                which = [i for i, x in enumerate(dims) if x == d]
                for i, c in zip(which, filters(d).decode(np.stack([unit(raws[i]) for i in which])), strict=True):
                    caps[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(caps, pa.list_(pa.int64()))],
                ["name", "raw", "weight", "dim", "caps"])

    capped = materialise(map_stream(vectors.select("name", "raw", "weight").repartition("name"), caps_of,
        "name binary, raw binary, weight long, dim int, caps array<long>"), "caps")
    each = capped.select("name", "raw", "weight", "dim", F.explode("caps").alias("cap"))
    sizes = each.groupBy("dim", "cap").agg(F.count("*").alias("n")).where("n > 1").select("dim", "cap",
        F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = each.join(sizes, ["dim", "cap"]).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    job = dealt.select("dim", "cap", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "name", "raw", "weight")
    ordered = job.repartition("dim", "cap", "lo", "hi").sortWithinPartitions("dim", "cap", "lo", "hi")

    def finish(key, rows, filters):
        if len(rows) < 2:
            return [], [], []
        name, raw, weight, side = zip(*rows, strict=True)
        dim, cap, lo, hi = key
        found = compare(list(name), np.array(weight), np.stack(list(map(unit, raw))), filters(dim), cap, np.array(side), lo == hi, cosine)
        if not found:
            return [], [], []
        keep, gained, low = found
        return [name[i] for i in keep], [name[low[i]] for i in keep], gained[keep].tolist()

    def run(batches):
        filters, key, rows, ready = filters_for(), None, [], ([], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "cap", "lo", "hi", "name", "raw", "weight", "side")]
            for dim, cap, lo, hi, *row in zip(*columns, strict=True):
                if (dim, cap, lo, hi) != key:
                    for have, more in zip(ready, finish(key, rows, filters), strict=True):
                        have.extend(more)
                    key, rows = (dim, cap, lo, hi), []
                rows.append(row)
            yield out(ready)
            ready = ([], [], [])
        yield out(finish(key, rows, filters))

    def out(columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()),
            pa.array(columns[2], pa.int64())], ["a", "b", "gained"])

    return map_stream(ordered, run, "a binary, b binary, gained long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
    miss: float = MISS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are compared once and count as linked with each other, repeated rows and equal ids included.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Null ids count for no minimum.
    """
    rows = materialise(named(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))), "vectors")
    nodes = rows.where("name IS NOT NULL").groupBy("name").agg(F.first("raw").alias("raw"), F.count("*").alias("weight"),
        F.min("id").alias("rep"))
    nodes = materialise(nodes, "distinct-vectors")
    found = materialise(links(nodes, cosine, miss), "vector-links")
    gained = found.groupBy(F.col("a").alias("name")).agg(F.sum("gained").alias("gained"))
    groups = connected(found.where("a <> b").select("a", "b"), "vector-groups").withColumnRenamed("node", "name")
    joined = nodes.select("name", "weight", "rep").join(gained, "name", "left").join(groups, "name", "left").withColumn("component",
        F.coalesce("component", "name"))
    joined = materialise(joined, "vector-nodes")
    total = rows.count()
    smallest = materialise(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")),
        "vector-groups")
    of_node = join_by_key(joined, smallest, "component", "members", total)
    of_node = of_node.select("name", (F.col("weight") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "component_id", "weight")
    linked = rows.where("name IS NOT NULL").select("id", "name")
    done = join_by_key(linked, materialise(of_node, "vector-components"), "name", "weight", total).select("id",
        F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("name IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """Contract 5 over all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
