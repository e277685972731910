"""Personal data: exact patterns, then information-theoretic sanitisation of the terms that give them away.

Patterns find e-mail and IP addresses, card and phone numbers. Each value found is a protected entity. The
terms around its mentions are counted against the corpus: a term discloses an entity by the share of the
entity's information content that their pointwise mutual information makes up. Terms over the first threshold
are generalised to a placeholder, over the second removed, wherever they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_stream, materialise, texts_of

KINDS = ("email", "ip", "card", "phone")
TERM, REMOVED = "term", "gone"
#: Words and code points of context on each side of a mention; contexts a term needs beside one entity.
CONTEXT_WORDS, CONTEXT_CHARS, SUPPORT = 8, 160, 3
#: Shares of an entity's information content at which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Terms handed to the workers at once; more are handled in further passes.
TERMS_AT_ONCE = 200_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Matches begin at a run of digits and take it whole, so neither run nor match is ever tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LETTERS = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @ back over the local part and on over the domain; time is linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            out.append((start, domain.end(), 0))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base matches, by start and kind."""
    out = emails(text) if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def entity(text: str, span: Span) -> int:
    """A hash of the value mentioned: case, blanks and punctuation don't matter."""
    value = text[span[0] : span[1]]
    value = value.lower() if span[2] < 2 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{span[2]}:{value}") >> 1


def hidden(text: str, spans: list[Span]) -> str:
    """The text with its spans blanked, so that no term is taken from them."""
    out, at = [], 0
    for start, end, _ in spans:
        if end > at:
            out += [text[at:start], " " * (end - max(start, at))]
            at = end
    return "".join([*out, text[at:]])


def mentions(text: str):
    """(entity, hash of its context, the context's terms) for each mention."""
    spans = base_spans(text)
    rest = hidden(text, spans) if spans else ""
    for span in spans:
        before = LETTERS.findall(rest[max(0, span[0] - CONTEXT_CHARS) : span[0]].lower())[-CONTEXT_WORDS:]
        after = LETTERS.findall(rest[span[1] : span[1] + CONTEXT_CHARS].lower())[:CONTEXT_WORDS]
        yield entity(text, span), xxhash.xxh3_64_intdigest(" ".join([*before, "@", *after])) >> 1, {*before, *after}


def chunks(terms: DataFrame) -> list[DataFrame]:
    """Terms in parts of about TERMS_AT_ONCE at most, so that what the workers get is bounded."""
    parts = -(-terms.count() // TERMS_AT_ONCE)
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) for i in range(parts)]


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, share): terms that disclose some entity, with the largest share of its information.

    With N distinct texts, n_e contexts of an entity, n_et of them with the term and n_t distinct texts with the term,
    the share is ln(N n_et / (n_e n_t)) / ln(N / n_e). Equal contexts and equal texts count once, so copies of a
    document are no evidence for a term or against it; a term needs SUPPORT contexts. Null texts and ids do no harm.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(e, c, sorted(terms)) for text in texts_of(batch) for e, c, terms in mentions(text)]
        e, c, t = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(c, pa.int64()), pa.array(t, pa.list_(pa.string()))],
            ["entity", "context", "terms"])

    contexts = materialise(map_batches(texts, found, "entity long, context long, terms array<string>").dropDuplicates(["entity",
        "context"]), "contexts")
    entities = contexts.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    beside = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity",
        "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= SUPPORT)
    pairs = materialise(beside.join(entities, "entity"), "entity-terms")
    candidates = materialise(pairs.select("term").distinct(), "candidate-terms")
    parts = chunks(candidates)
    if not parts:
        return docs.sparkSession.createDataFrame([], "term string, share double")
    total = texts.select(F.xxhash64(F.coalesce("text", F.lit("")))).distinct().count()
    counted = None
    for i, part in enumerate(parts):
        wanted = docs.sparkSession.sparkContext.broadcast({r.term: i for i, r in enumerate(part.collect())})
        each = map_batches(texts, term_finder(wanted), "name binary, numbers binary").dropDuplicates(["name"])
        one = map_stream(each.select("numbers"), term_counter(wanted), "term string, n long")
        if len(parts) > 1:  # so that one part's terms at a time are with the workers
            one = materialise(one, f"counted-{i}")
            wanted.destroy()
        counted = one if counted is None else counted.union(one)
    n_t = counted.groupBy("term").agg(F.sum("n").alias("n_t"))
    information = F.log(F.lit(float(total)) / F.col("n_e"))
    share = F.when(information > 0, F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t",
        "n_et"))) / information).otherwise(0.0)
    scored = pairs.join(n_t, "term").groupBy("term").agg(F.max(share).alias("share"))
    return scored.where(F.col("share") >= GENERALISE)


def term_finder(wanted):
    """(name, numbers): the hash of every text that holds wanted terms, and their numbers as unsigned 32-bit."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, numbers = [], []
        for text in texts_of(batch):
            if found := wanted.value.keys() & LETTERS.findall(text.lower()):
                names.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                numbers.append(np.array(sorted(map(wanted.value.__getitem__, found)), "<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(numbers, pa.binary())], ["name", "numbers"])

    return run


def term_counter(wanted):
    def run(batches):
        counts = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("numbers").to_pylist()), "<u4"), minlength=len(counts))
        rows = [(t, counts[i]) for t, i in wanted.value.items() if counts[i]]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["term", "n"])

    return run


def term_spans(text: str, spans: list[Span], shares: dict[str, float]) -> list[Span]:
    """Spans of disclosing terms outside the base spans; kind 4 is generalised, 5 removed."""
    if not shares or len(lowered := text.lower()) != len(text):
        lowered = "".join(c if len(low := c.lower()) != 1 else low for c in text) if shares else ""
    rest = hidden(lowered, spans)
    return [(m.start(), m.end(), 4 + (s >= REMOVE)) for m in LETTERS.finditer(rest)
        if (s := shares.get(m[0])) is not None] if shares else []


def find(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans array<struct<start, stop, kind>>): all spans of every whole text, null text as empty.

    Terms go to the workers in parts of bounded size: a pass over the rows for each part, written to the shared folder
    but for the last. Repeated rows and null ids pass through.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return marked(rows, terms, "text", "spans")


def marked(rows: DataFrame, terms: DataFrame, text_col: str, name: str | None) -> DataFrame:
    """rows with a last column `name`: the spans of every text, a null text's are none. Without a name, rows with cleaned
    texts instead, in the same pass."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
    place, names = rows.columns.index(text_col), rows.columns
    numbered = [f"c{i}" for i in range(len(names))]
    plain = ", ".join(f"c{i} {rows.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    fields = f"{plain}, spans array<struct<start: long, stop: long, kind: int>>"

    def with_terms(part: dict | None, first: bool, cleaned: bool):
        shared = rows.sparkSession.sparkContext.broadcast(part or {})

        def spans_of(text: str, before: list | None) -> list[Span]:
            had = [(s["start"], s["stop"], s["kind"]) for s in before or ()]
            base = [s for s in had if s[2] < len(KINDS)] if before is not None else base_spans(text)
            more = [s for s in had if s[2] >= len(KINDS)]
            return sorted([*base, *more, *term_spans(text, base, shared.value)], key=lambda s: (s[0], s[2]))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(place).to_pylist()
            had = [None] * len(texts) if first else batch.column("spans").to_pylist()
            found = [spans_of(t or "", before) for t, before in zip(texts, had, strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            if cleaned:
                columns[place] = pa.array([clean(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)], pa.string())
                return pa.RecordBatch.from_arrays(columns, numbered)
            told = [[{"start": a, "stop": b, "kind": k} for a, b, k in spans] for spans in found]
            return pa.RecordBatch.from_arrays([*columns, pa.array(told, kind)], [*numbered, "spans"])

        return run

    out = rows.toDF(*numbered)
    parts = chunks(terms) or [None]
    for i, part in enumerate(parts):
        shares = None if part is None else {r.term: r.share for r in part.collect()}
        last = i + 1 == len(parts)
        ends = last and name is None
        out = map_batches(out, with_terms(shares, i == 0, ends), plain if ends else fields, rows=256)
        if not last:
            out = materialise(out, "marked")
    return out.toDF(*names, *([name] if name else []))


def clean(text: str, spans: list[Span]) -> str:
    """The text with placeholders for its spans; removed terms leave nothing."""
    names, out, at = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", ""), [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], names[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with personal data and disclosing terms replaced in `text_col`; null texts stay null."""
    return marked(docs, terms, text_col, None)


def op2_privacy(spark, sf_dir: str) -> DataFrame:
    """Contract 2 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = materialise(disclosing_terms(docs), "disclosing-terms")
    found = find(docs, terms)
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM, REMOVED)])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])),
        ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.expr(f"CAST(size(filter(spans, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
