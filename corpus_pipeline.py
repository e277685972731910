"""Corpus preparation: language, shared lines, near copies, personal data, packing.

Each stage takes what the one before it kept, as Parquet in the shared folder. All of them take null ids, texts and other
columns, empty and very long texts, repeated rows, empty tables and any further columns; what becomes of them is said at
each stage. Further columns pass through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import language, lines, ngram_join, packing, privacy
from chronofold.llm.common import materialise
from chronofold.llm.wordpieces import vocabulary


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars as the text has it now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on their labels, is sure of.

    Null texts, and those without a letter, have no language and go. Labels may be null; without any label nothing can be
    identified and all documents go. Repeated rows are judged alike.
    """
    return language.keep_identified(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by documents stay in the smallest one; documents that this leaves without a word go.

    A null, empty or blank text has no line to lose and stays. Rows of one id are one document; rows without an id are
    told apart by their text.
    """
    found = lines.dedup_lines(docs).toDF(*(f"c{i}" for i in range(len(docs.columns))), "lines", "dropped")
    text = F.col(f"c{docs.columns.index('text')}")
    left = found.where((F.col("dropped") == 0) | F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return counted(left.drop("lines", "dropped").toDF(*docs.columns), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Documents without a word (null, empty, blank) all stay. Of repeated rows one stays, as `keep_first` has it.
    """
    return ngram_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it give way to placeholders.

    Null texts stay null, empty ones empty; all rows stay.
    """
    terms = materialise(privacy.disclosing_terms(docs), "disclosing-terms")
    return counted(privacy.sanitise(docs, terms), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, none across documents: a row for each piece.

    A null or empty text is one piece, the end id. Rows of equal or null ids are packed each by itself.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
