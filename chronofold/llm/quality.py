"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its measurements and one bit for each rule
that it fails. Policies are versioned masks over the bits, so a new policy, or what each rule costs a policy
on its own, is bitwise work on the ledger and never reads the texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts_of
from .shingles import WIDTH, window_hashes, word_hashes

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: Name and failing condition of each rule, in bit order.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "exclamations": "10 * n_exclaims > n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that a document must pass.
POLICIES = {"base": BASE, "v1": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measures(text: str) -> tuple[int, ...]:
    """A text's MEASURES."""
    words = text.encode("utf-8").split()
    hashes = window_hashes(word_hashes(words))
    repeated = 0
    if len(hashes) > 1:
        _, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
        if (again := count[place] > 1).any():
            covered = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(again)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + WIDTH, -1)
            repeated = int((np.cumsum(covered) > 0).sum())
    seen, n_lines, n_dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), n_lines, n_dup, repeated, text.count("!")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES..., fail_bits) of every row.

    Null and empty texts have no words and fail `few_words`. Repeated rows and null ids pass through.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(measures, texts_of(batch)), strict=True)) or [[]] * len(MEASURES)
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in found)], ["id", *MEASURES])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = map_batches(rows, run, "id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return measured.withColumn("fail_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it, never the texts."""
    return materialise(ledger(docs, id_col, text_col), "quality-ledger")


def verdicts(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy: every rule of the policy and of the base holds."""
    return entries.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(mask(BASE)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(mask({*BASE, *POLICIES[policy]})) == 0,
    })


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failing, only): documents that fail a rule, and those that the policy would keep without it.

    The ledger is first counted by its bits, of which there are no more patterns than 2 ** len(RULES).
    """
    used = mask(POLICIES[policy])
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(used).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r, 1 << i) for i, r in enumerate(RULES) if used >> i & 1]
    exploded = patterns.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r).alias("name"), F.lit(b).cast("long").alias("bit")) for r,
        b in rules])))
    hit = F.col("bits").bitwiseAND(F.col("rule.bit"))
    return exploded.groupBy(F.col("rule.name").alias("rule")).agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("rule.bit"), F.col("n")).otherwise(0)).alias("only"),
    )


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Contract 8 over all documents, from the stored ledger; fail_bits has a bit for each rule that a document fails."""
    found = verdicts(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
five AS (SELECT r, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS f
         FROM pos WINDOW o AS (PARTITION BY r ORDER BY p)),
win AS (SELECT r, p, count(*) OVER (PARTITION BY r, f) AS c FROM five WHERE f IS NOT NULL),
rep AS (SELECT r, count(DISTINCT q)::BIGINT AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM win WHERE c > 1) GROUP BY r),
ln AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup FROM ln GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 100 * n_dup_lines > 30 * n_lines AND NOT 10 * n_exclaims > n_words
       AND NOT word_chars > 14 * n_words AND NOT word_chars < 2 * n_words AS kept,
       ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 16 * (10 * n_exclaims > n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT)::BIGINT AS fail_bits
FROM b
"""
