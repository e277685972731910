"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what it lets pass.

A listed entry is a host and a path prefix. A page's URL stands for every host suffix at a label border with
every listed prefix length of its path. The filter has one 64-bit word a block, so a probe is one lookup; only
candidates that pass are joined with the list, which removes false positives. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter at most (8 bytes each), bits set for a key, and entries up to which the list is broadcast.
MOST_BLOCKS, BITS, BROADCAST_ROWS = 1 << 17, 4, 50_000
#: Copies of the list where it is joined by shuffle, so that a hot entry's pages are spread.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bits(key: Column) -> Column:
    """A key's bits in its block's word."""
    h = F.xxhash64(F.lit("bits"), key)
    word = F.lit(0).cast("long")
    for k in range(BITS):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
            F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return word


def blocked_filter(listed: DataFrame, blocks: int) -> Column:
    """The filter's words as one array value; its size depends on `blocks` alone."""
    spark = listed.sparkSession
    words = listed.groupBy(place(F.col("key"), blocks).cast("long").alias("id")).agg(F.bit_or(bits(F.col("key"))).alias("word"))
    full = spark.range(blocks).join(words, "id", "left").select(F.struct("id",
        F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("w"))
    return full.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("words")).scalar()


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; listed has host, path and verdict.

    The longest fitting entry decides; a url without any gets `default` and a null rule. Null and malformed
    urls have empty host and path and fit nothing. Repeated pages are judged each; entries listed twice count
    once (the first verdict by name). An empty list lets everything through to the default.
    """
    entries = listed.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"),
        F.col("verdict").alias("v")).where("h IS NOT NULL AND p IS NOT NULL")
    entries = entries.groupBy(F.concat("h", "p").alias("key"), F.length("p").alias("size")).agg(F.min("v").alias("listed_verdict"))
    n, sizes = entries.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    plain = [F.col("id"), F.col("host"), F.col("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not n:
        return rows.select(*plain)
    blocks = 64
    while blocks < n and blocks < MOST_BLOCKS:
        blocks *= 2
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(s) for s in sizes]),
        lambda s: F.when(F.length("path") >= s, F.substring(F.col("path"), F.lit(1), s))), lambda p: p.isNotNull())
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    words = blocked_filter(entries, blocks)
    passing = F.filter("candidates", lambda k: F.get(F.col("words"), place(k, blocks)).bitwiseAND(bits(k)) == bits(k))
    probed = rows.withColumn("candidates", candidates).withColumn("words", words).select("id", "host", "path", passing.alias("hits"))
    none = probed.where(F.size("hits") == 0).select(*plain)
    some = probed.where(F.size("hits") > 0).withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "host", "path",
        F.explode("hits").alias("key"))
    if n <= BROADCAST_ROWS:
        joined = some.join(F.broadcast(entries), "key", "left")
    else:
        salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = some.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    best = F.struct(F.when(F.col("listed_verdict").isNotNull(), F.length("key")).alias("size"),
        F.when(F.col("listed_verdict").isNotNull(), F.col("key")).alias("rule"), F.col("listed_verdict").alias("v"))
    decided = joined.groupBy("uid", "id", "host", "path").agg(F.max(best).alias("best"))
    return none.unionByName(decided.select("id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.v", F.lit(default)).alias("verdict")))


#: Fixed values of contract 1.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block")]


def op1_urls(spark, sf_dir: str) -> DataFrame:
    """Contract 1 over all pages."""
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed).withColumnRenamed("id", "page_id")


OP1_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
cut AS (SELECT r, page_id, regexp_extract(t, '^([^/?#]*)', 1) AS raw, t FROM rest),
parts AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(t, length(raw) + 1), '^([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT r, page_id, host, path, h || p AS rule, v,
               row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST) AS k
        FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
"""
