"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes.

Documents of equal shingle sets are one node, named by a 128-bit hash of the set. Tokens (shingles) are
ordered by a sketch of their counts, rare ones first. By the prefix principle two sets of similarity t or more, cut to prefixes long
enough, share a token there. Rare tokens are indexed singly. Frequent tokens are dealt into classes by
hash; a prefix is extended until it would survive one unmatched token in every class, and then a pair must
share a rare token or two tokens of one class, so combinations of two within a class are indexed instead of
single frequent tokens. A prefix of p tokens is extended by about p/12, which keeps combinations near 7p. Each
entry carries how much its set can share with one that it meets there first, so most pairs that a key brings
together are ruled out unread. Sets of under about ten tokens have frequent ones indexed singly.

A set also has a parity: a bitmap of about a bit and a half a token that holds, for each slot, whether the set has an
odd number of tokens there. Two parities differ in no more slots than the sets differ in tokens, so a pair whose
parities differ too much is not similar, and no set is read for it. That leaves hardly any pair but the similar ones,
so the sets that are moved grow with the links and not with the accidental meetings.

A key's nodes are not paired with each other at once: each is tried against the best-connected node it meets and
against another one, what passes is one group for the time being, and only pairs of nodes that share a key and are in
different groups are tried one by one. Then sets are fetched and compared, the groups are formed anew of real links,
and pairs of a key that are in different groups now and were not tried yet are tried. So a group of n similar documents
costs about n comparisons, not n squared, and every component is exact.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected, discard, join_by_key, map_batches, map_stream, materialise, slices, texts_of
from .shingles import WIDTH, shingle_set

#: Similarity in percent; ranges in which sketches are added up; texts whose tokens are in memory at once.
PERCENT, RANGES, ROWS = 80, 64, 1024
#: A sketch has about a slot for so many characters of text, between these powers of two. 64 MB of levels are the most
#: that is broadcast; beyond it (about 3 GB of text) slots are shared by more tokens, which costs candidates, not links.
CHARS_A_SLOT, LEAST_BITS, MOST_BITS = 48, 18, 26
#: A token is frequent from this count of its slot on, or from so many times the mean slot.
FREQUENT, TIMES_MEAN = 64, 4
#: Entries of a key in one part of a join; entries of a key known to be hot from the sketch in one part of the first sort.
KEY_PART, HOT_PART = 512, 1 << 16
#: Bits of the filter of candidate nodes, and turns in which a node is tried against one node of each key.
FILTER_BITS, ROUNDS = 26, 2
_MULT = np.uint64(0xD6E8FEB86659FD93)


def set_name(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes(), seed=len(tokens))


def node_number(name: bytes) -> int:
    """56 bits of a name. Candidates are found by number; sets are verified and linked by name, so two nodes of one
    number cost a comparison more."""
    return int.from_bytes(name[:7], "big")


def number_of(name: str = "name"):
    return F.conv(F.hex(F.substring(name, 1, 7)), 16, 10).cast("long")


def parity(tokens: np.ndarray) -> bytes:
    """For each slot of a power of two of at least len(tokens) and 64, whether an odd number of tokens is there."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int, percent: int = PERCENT) -> bool:
    """False if parities x, y of sets of n and m tokens rule out that similarity. A parity of twice the size folds into
    one of the size by an exclusive or of slots that are equal modulo the size."""
    if len(x) > len(y):
        x, y = y, x
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    differ = int(np.bitwise_count(u ^ v).sum())
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n of which one at least is shared with any set of that similarity."""
    return n - -(-percent * n // 100) + 1


def size_class(n: int, percent: int = PERCENT) -> int:
    """Sets of that similarity are in equal or adjacent classes."""
    return int(math.log(n) / math.log(100 / percent))


def classes_of(kappa: int, percent: int = PERCENT) -> int:
    """Hash classes of frequent tokens for size class kappa; 0: frequent tokens are indexed singly."""
    return int(math.ceil((1 - percent / 100) * (100 / percent) ** kappa / 12)) if kappa >= 9 else 0


def sketch_bits(chars: int) -> int:
    """Bits of a slot number of the sketch of a corpus of so many characters."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1, chars / CHARS_A_SLOT)))))


def level(counts):
    """Counts in eighths of a doubling, as one byte; in order with the counts."""
    return np.minimum(255, np.round(8 * np.log2(1 + np.asarray(counts, float)))).astype(np.uint8)


def hot_parts(levels: np.ndarray) -> np.ndarray:
    """Parts in which the entries of a token of that level are sorted; 0: it isn't hot."""
    counts = np.exp2(levels / 8.0)
    return np.where(counts >= 2 * HOT_PART, counts // HOT_PART, 0).astype(np.int32)


def index_keys(tokens: np.ndarray, levels: np.ndarray, frequent: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys (int64) under which a set is indexed, for each the most tokens that it can share with a set it meets
    there first, and the parts of hot keys. tokens: ascending; levels: each slot's, a power of two of them; frequent:
    the least level of a frequent token.

    Tokens are taken by level, then by hash. If the first token that two sets share is at place i of a set of n (from
    0), they share n - i at most. For combinations, the earliest complete one has at most one shared token of each
    class before its second token, so they share at most n - i and as many as there are classes.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    p = prefix_size(n, percent)
    own = levels[(tokens >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]
    order = np.argsort(own, kind="stable")
    tokens, own = tokens[order], own[order]
    rare = int(np.searchsorted(own, frequent))
    if rare >= p:
        return tokens[:p].view(np.int64), n - np.arange(p), hot_parts(own[:p])
    need, common, heights = p - rare, tokens[rare:], own[rare:]
    keys, rest, least = [tokens[:rare]], [n - np.arange(rare)], [own[:rare]]
    for kappa in (size_class(n, percent), size_class(n, percent) + 1):
        classes = classes_of(kappa, percent)
        if not classes:
            keys.append(common[:need])
            rest.append(n - rare - np.arange(need))
            least.append(heights[:need])
            continue
        group = ((common * _MULT) >> np.uint64(33)) % np.uint64(classes)
        first = np.zeros(len(common), bool)
        first[np.unique(group, return_index=True)[1]] = True
        cut = int(np.searchsorted(np.cumsum(~first), need)) + 1
        place = np.argsort(group[:cut], kind="stable")
        groups, dealt, height = group[:cut][place], common[:cut][place], heights[:cut][place]
        salt = np.uint64((2 * kappa + 1) * int(_MULT) % 2**64)
        step = 1
        while step < cut and (same := groups[step:] == groups[:-step]).any():
            mixed = (dealt[:-step][same] * _MULT ^ dealt[step:][same]) * salt
            keys.append(mixed ^ mixed >> np.uint64(31))
            rest.append(n - rare - place[step:][same] + classes)
            least.append(np.minimum(height[:-step][same], height[step:][same]))
            step += 1
    return np.concatenate(keys).view(np.int64), np.concatenate(rest), hot_parts(np.concatenate(least))


def scan(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> DataFrame:
    """Rows (id, n, name, parity, content) of all documents, and rows (slots, counts) with each task's sketch of token
    counts. content: a 128-bit hash of the text; null texts have the empty text's."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n", "name", "parity", "content", "slots", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        sketch, seen = np.zeros(1 << bits, np.uint16), set()
        for batch in slices(batches, ROWS):
            texts, cols, fresh = texts_of(batch), ([], [], []), []
            for text in texts:
                tokens = shingle_set(text, width)
                name = set_name(tokens)
                for col, value in zip(cols, (len(tokens), name, parity(tokens) if len(tokens) else None), strict=True):
                    col.append(value)
                if name not in seen:
                    seen.add(name)
                    fresh.append(tokens)
            if fresh:
                slots, counts = np.unique(np.concatenate(fresh) >> np.uint64(64 - bits), return_counts=True)
                slots = slots.astype(np.int64)
                sketch[slots] = np.minimum(sketch[slots].astype(np.int64) + counts, 65535)
            cols = [*cols, [content_hash(t) for t in texts], *[[None] * len(texts)] * 2]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)
        if seen:
            parts = sketch.reshape(RANGES, -1)
            for i in range(RANGES):
                cols = [*[[None]] * 5, [i], [zlib.compress(parts[i].tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return map_stream(rows, run, "id long, n long, name binary, parity binary, content binary, slots int, counts binary")


def content_hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def slot_levels(scanned: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Each slot's level, and the least level of frequent tokens: a byte a slot comes to the driver, at most 64 MB."""
    total = scanned.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, TIMES_MEAN * total >> bits)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(raw), np.uint16)
                if i not in sums:
                    sums[i] = np.zeros(len(found), np.int64)
                sums[i] += found
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
            pa.array([level(s).tobytes() for s in sums.values()], pa.binary())], ["slots", "levels"])

    parts = map_stream(scanned.where("slots IS NOT NULL").select("slots", "counts").repartition("slots"), add,
        "slots int, levels binary").collect()
    levels = np.zeros((RANGES, (1 << bits) // RANGES), np.uint8)
    for r in parts:
        levels[r.slots] = np.frombuffer(r.levels, np.uint8)
    return levels.ravel(), int(level(least))


def index(docs: DataFrame, levels: np.ndarray, frequent: int, text_col: str, width: int, percent: int) -> DataFrame:
    """(key, node, bounds, parts): every node's number under its keys, with its size and what it can share there in one
    number; a task writes a node once, however many copies it has."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        seen = set()
        for batch in slices(batches, ROWS):
            found = []
            for text in texts_of(batch):
                tokens = shingle_set(text, width)
                if len(tokens) and (name := set_name(tokens)) not in seen:
                    seen.add(name)
                    keys, rest, parts = index_keys(tokens, shared.value, frequent, percent)
                    found.append((keys, np.full(len(keys), node_number(name), np.int64), rest << 32 | len(tokens), parts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)],
                    ["key", "node", "bounds", "parts"])

    return map_stream(docs.select(F.col(text_col).cast("string").alias("text")), run, "key long, node long, bounds long, parts int")


def shared_entries(keyed: DataFrame) -> DataFrame:
    """(key, node, rest, n, parts) of the keys that two nodes or more have; parts: in how many a key is dealt from here on.

    A key that the sketch knows to be hot is sorted in parts already here, and stays without proof that others have it.
    """
    salt = F.when(F.col("parts") > 0, 1 + F.pmod("node", "parts")).otherwise(0)
    here = Window.partitionBy("key", "salt")
    found = keyed.withColumn("salt", salt).withColumns({"lo": F.min("node").over(here), "hi": F.max("node").over(here),
        "copies": F.count("*").over(here)})
    found = found.where("lo <> hi OR parts > 0").withColumn("parts",
        F.when(F.col("parts") > 0, F.col("parts")).otherwise((1 + F.floor(F.col("copies") / KEY_PART)).cast("int")))
    return found.select("key", "node", F.shiftright("bounds", 32).alias("rest"), F.col("bounds").bitwiseAND(0xFFFFFFFF).alias("n"),
        "parts").distinct()


def with_key_facts(entries: DataFrame, **facts) -> DataFrame:
    """Entries with aggregates of their key: added up before the shuffle and joined part by part, so that no task gets
    more than KEY_PART entries of one key (or HOT_PART of a hot one)."""
    totals = entries.groupBy("key", "parts").agg(*(f.alias(name) for name, f in facts.items()))
    totals = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return entries.withColumn("part", F.pmod("node", "parts").cast("int")).join(totals, ["key", "part"]).drop("part")


def several(entries: DataFrame, of: str) -> DataFrame:
    """The entries whose key has two or more values of a column."""
    return with_key_facts(entries, lo=F.min(of), hi=F.max(of)).where("lo <> hi").drop("lo", "hi")


def node_filter(nodes: DataFrame):
    """A broadcast test that holds for all node numbers given and for few others; its size, 8 MB, depends on nothing."""
    spark = nodes.sparkSession
    hashed = nodes.select(F.pmod("node", F.lit(1 << FILTER_BITS)).alias("h"))
    words = hashed.groupBy(F.shiftright("h", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 31 AS INT))"))
        .alias("bits"))

    def gather(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(c)).astype("<u4").tobytes()], pa.binary()) for c in ("w",
                "bits")], ["w", "bits"])

    bits = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    for r in map_stream(words, gather, "w binary, bits binary").collect():
        bits[np.frombuffer(r.w, "<u4")] = np.frombuffer(r.bits, "<u4")
    shared = spark.sparkContext.broadcast(bits)

    def holds(name: bytes) -> bool:
        h = node_number(name) % (1 << FILTER_BITS)
        return bool(int(shared.value[h >> 5]) >> (h & 31) & 1)

    return holds


def node_sets(docs: DataFrame, nodes: DataFrame, text_col: str, width: int) -> DataFrame:
    """(name, tokens binary) of the nodes numbered, and of few others that the filter lets through."""
    holds = node_filter(nodes)

    def run(batches):
        seen = set()
        for batch in slices(batches, ROWS):
            names, sets = [], []
            for text in texts_of(batch):
                tokens = shingle_set(text, width)
                if len(tokens) and (name := set_name(tokens)) not in seen and holds(name):
                    seen.add(name)
                    names.append(name)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["name", "tokens"])

    found = map_stream(docs.select(F.col(text_col).cast("string").alias("text")), run, "name binary, tokens binary")
    return materialise(found.dropDuplicates(["name"]), "node-sets")


def likely(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """(x, y, passed) for pairs(x, y): whether the parities leave it possible that they are similar.

    parities(node, n, parity) may have several rows of a number; a pair passes if any of them do.
    """
    left = parities.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px"))
    right = parities.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        passed = [may_be_similar(*row, percent) for row in zip(*(batch.column(c).to_pylist() for c in ("px", "py", "nx", "ny")),
            strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(passed, pa.bool_())], ["x", "y", "passed"])

    met = pairs.join(left, "x").join(right, "y").select("x", "y", "px", "py", "nx", "ny")
    return map_batches(met, run, "x long, y long, passed boolean", rows=4096)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, a, b, linked) for pairs(x, y) of node numbers: names, and whether the sets are similar enough."""
    left = sets.select(number_of().alias("x"), F.col("name").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(number_of().alias("y"), F.col("name").alias("b"), F.col("tokens").alias("tb"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            linked.append(100 * both >= percent * (len(u) + len(v) - both))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in "xyab"), pa.array(linked, pa.bool_())], [*"xyab", "linked"])

    met = pairs.join(left, "x").join(right, "y").select(*"xyab", "ta", "tb")
    return map_batches(met, run, "x long, y long, a binary, b binary, linked boolean", rows=256)


def apart(entries: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Entries with their node's group, of the keys that several groups have. groups(node, joined); others are alone."""
    here = entries.withColumn("component", F.col("node"))
    if groups is not None:
        here = here.join(groups, "node", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")
    return several(here, "component")


FITS = "least(rest, its_rest) * ({0} + 100) >= (n + its_n) * {0}"


def one_each(here: DataFrame, turn: int, percent: int) -> DataFrame:
    """(x, y): each node with the best-connected one of all that it meets, or in later turns one picked by hash."""
    order = ["degree", "node", "n", "rest", "component"]
    rank = F.struct(*order) if turn == 0 else F.struct(F.xxhash64("component", F.lit(turn)).alias("hash"), *order)
    met = with_key_facts(here, best=F.max(rank)).withColumns({"its_n": F.col("best.n"), "its_rest": F.col("best.rest")})
    met = met.where(F.col("component") != F.col("best.component")).where(FITS.format(percent))
    met = met.groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("other"))
    return met.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()


def each_other(here: DataFrame, percent: int) -> DataFrame:
    """(x, y): the pairs of nodes of a key that are in different groups and could be similar by their places in it."""
    that = here.select("key", F.col("node").alias("other"), F.col("n").alias("its_n"), F.col("rest").alias("its_rest"),
        F.col("component").alias("its"), "parts")
    that = that.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = here.withColumn("part", F.pmod("node", "parts").cast("int")).join(that, ["key", "part"])
    met = met.where("node < other AND component <> its").where(FITS.format(percent))
    return met.select(F.col("node").alias("x"), F.col("other").alias("y")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, name, n, content, component_id, first): every row's node, set size, text's hash, component and the node that
    stands for it.

    Rows without words (null, empty or blank texts) have n 0, are linked with nothing and are their own
    component. Repeated rows and equal ids share a node if their sets are equal. Null ids count for no minimum:
    a component of null ids alone has a null component_id.
    """
    bits = sketch_bits(docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0)
    scanned = materialise(scan(docs, id_col, text_col, width, bits), "shingle-scan")
    rows = scanned.where("slots IS NULL").select("id", "n", "name", "content")
    nodes = rows.where("n > 0").groupBy("name").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    entries = shared_entries(index(docs, *slot_levels(scanned, bits), text_col, width, percent))
    # Under a key, no set shares more than the key's largest rest, nor with a smaller set than its smallest.
    able = F.least("rest", "most") * (100 + percent) >= (F.col("n") + F.greatest("least", F.col("n") * percent / 100)) * percent
    met = materialise(entries, "shared-keys")
    entries = several(with_key_facts(met, most=F.max("rest"), least=F.min("n")).where(able).drop("most", "least"), "node")
    entries = materialise(entries.withColumn("degree", F.count("*").over(Window.partitionBy("node"))), "index")
    discard(met)
    # Distinct before the join, so that copies are added up where they are read.
    parities = scanned.where("n > 0").select(number_of().alias("node"), "n", "parity").distinct()
    parities = materialise(parities.join(entries.select("node").distinct(), "node", "left_semi"), "parities")

    tried = groups = None
    for turn in range(ROUNDS + 1):
        here = apart(entries, groups)
        pairs = one_each(here, turn, percent) if turn < ROUNDS else each_other(materialise(here, "open-keys"), percent)
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        met = materialise(likely(pairs, parities, percent), "tried")
        tried = met if tried is None else tried.union(met)
        if turn < ROUNDS and (turn == 0 or not met.where("passed").isEmpty()):
            groups = connected(tried.where("passed").select(F.col("x").alias("a"), F.col("y").alias("b")),
                "likely").withColumnRenamed("component", "joined")
    chosen = tried.where("passed").select("x", "y").distinct()
    links = checked_links(docs, chosen, text_col, width, percent)
    found = connected(links, "shingle-links").withColumnRenamed("node", "name")
    # Groups of pairs that looked similar and were not may have hidden pairs.
    here = apart(entries, found.select(number_of().alias("node"), number_of("component").alias("joined")))
    hidden = materialise(likely(each_other(materialise(here, "open-keys"), percent).join(tried, ["x", "y"], "left_anti"), parities,
        percent), "hidden").where("passed").select("x", "y").distinct()
    if not hidden.isEmpty():
        more = checked_links(docs, hidden, text_col, width, percent)
        if not more.isEmpty():
            found = connected(links.union(more), "shingle-links").withColumnRenamed("node", "name")
    grouped = materialise(nodes.join(found, "name", "left").withColumn("component", F.coalesce("component", "name")), "grouped")
    first = F.min_by("name", F.struct(F.col("rep").isNull(), "rep", "name")).alias("first")
    smallest = materialise(grouped.groupBy("component").agg(F.min("rep").alias("component_id"), first, F.count("*").alias("members")),
        "groups")
    total = rows.count()
    named = join_by_key(grouped.select("name", "copies", "component"), smallest, "component", "members", total)
    named = materialise(named.select("name", "copies", "component_id", "first"), "components")
    worded = join_by_key(rows.where("n > 0"), named, "name", "copies", total).select("id", "name", "n", "content", "component_id", "first")
    return worded.union(rows.where("n = 0").select("id", "name", "n", "content", F.col("id"), F.lit(None).cast("binary")))


def checked_links(docs: DataFrame, pairs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(a, b), names, of the pairs(x, y) of node numbers whose sets are similar enough."""
    sets = node_sets(docs, pairs.select(F.explode(F.array("x", "y")).alias("node")), text_col, width)
    links = materialise(verified(pairs, sets, percent).where("linked").select("a", "b"), "links")
    discard(sets)
    return links


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns; rows without words all stay.

    Of several rows of that id and shingle set, the one with the least hash of its text stays, and of those with one
    text too, the one with the least hash of all its columns (any, if they are equal). Components of null ids alone keep
    one row likewise. Rows whose text occurs in no other row's component stay without a shuffle: a filter of fixed size
    tells them from the others (and from a few more, which lose nothing by it); only those are joined and ranked.
    """
    found = materialise(components(docs, id_col, text_col, width, percent).where("n > 0"), "members")
    first = found.where("name = first AND id <=> component_id").groupBy("name", "id").agg(F.min("content").alias("content"))
    stays = first.select(F.col("id").alias("its_id"), F.col("content").alias("its_content"))
    doubtful = found.groupBy("name").agg(F.count("*").alias("rows"),
        F.first("first").alias("first")).where("rows > 1 OR name <> first").select("name")
    holds = node_filter(found.join(doubtful, "name", "left_semi").select(number_of("content").alias("node")))
    place, names = docs.columns.index(text_col), docs.columns

    def pick(batch: pa.RecordBatch, sure: bool) -> pa.RecordBatch:
        marks = [content_hash(t or "") for t in batch.column(place).cast(pa.string()).to_pylist()]
        mask = pa.array([(not holds(m)) == sure for m in marks], pa.bool_())
        if sure:
            return batch.filter(mask)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())],
            [*(f"c{i}" for i in range(len(names))), "content"]).filter(mask)

    sure = map_batches(docs, lambda batch: pick(batch, True), docs.schema)
    fields = ", ".join(f"c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    others = map_batches(docs, lambda batch: pick(batch, False), f"{fields}, content binary")
    row_id, cells = F.col(f"c{names.index(id_col)}").cast("long"), [f"c{i}" for i in range(len(names))]
    one = others.join(stays, (others["content"] == stays["its_content"]) & row_id.eqNullSafe(stays["its_id"]), "left_semi")
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy(row_id,
        "content").orderBy(F.xxhash64(F.to_json(F.struct(*cells))))))
    return sure.unionByName(one.where("rank = 1").select(*cells).toDF(*names))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Contract 10 over all documents."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
