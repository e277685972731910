"""The pipeline's stages, each against what its operator's brute force says of its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import packing, privacy, wordpieces
from tests.llm.test_text_operators import SF, brute_components, brute_lines


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "language_id" else None
        docs = stage(spark, docs, SF).cache()
        seen[name] = after = docs.collect()
        if name != "packing":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in after)
        if name == "line_dedup":
            want = brute_lines([(i, r.text) for i, r in before.items()])
            assert {(r.doc_id, r.text) for r in after} == {(i, t) for i, n, t in want if t.strip(" \t\n\x0b\x0c\r") or t == before[i].text}
        elif name == "near_duplicates":
            groups = brute_components([r.text for r in before.values()], list(before))
            assert {r.doc_id for r in after} == {i for i, (n, c) in groups.items() if i == c}
        elif name == "personal_data":
            assert {r.doc_id for r in after} == set(before) and not any(privacy.base_spans(r.text) for r in after)
    texts = {r.doc_id: r.text for r in seen["personal_data"]}
    fast = wordpieces.Library(wordpieces.vocabulary("word_bpe_49k.json"))
    for i, t in texts.items():
        own = sorted((r for r in seen["packing"] if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == fast.ids_of([t])[0] + np.array([packing.END_ID], "<u4").tobytes()
    assert len(seen["packing"]) == corpus_pipeline.run(spark, SF).count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cf_id long, cf_drops string, cf_set binary, content string, spans int, drops int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from tall old trees near the quiet river".split()


def odd_rows():
    long = " ".join(WORDS[i * 7 % 21] + str(i % 97) for i in range(9000))
    texts = [None, "", " \n\t ", "one line of words that two have\nand its own end of it", "one line of words that two have\nanother end that differs here", "one line of words that two have", long, long, long + " tail", "write to a@b.org or 10.0.0.1 please, said someone there", "12 34 !?"]
    rows = [(i if i % 5 else None, t, "en" if i % 3 else None, None, None, i, "d", b"s", "c", i, i) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("start", range(1, 5))
def test_stages_take_odd_rows_and_clashing_names(spark, start):
    """Every stage but the first, which would drop what is odd, on the odd rows themselves."""
    name, stage = corpus_pipeline.STAGES[start]
    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and len([r for r in rows if r.start == 0]) == docs.count()
        return
    assert out.columns == docs.columns
    kept = Counter((r.cf_id, r.text) for r in rows)
    if name == "line_dedup":
        # 3 keeps the shared line, 4 its own end; 5 loses all it has and goes; nameless 0, 5 and 10 are apart by their texts.
        assert {i: t for i, t in kept if i in (3, 4, 5)} == {3: odd_rows()[3][1], 4: "another end that differs here"} and sum(n for (i, _), n in kept.items() if i in (0, 1, 2, 10)) == 4
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    elif name == "near_duplicates":
        assert sum(n for (i, _), n in kept.items() if i in (6, 7, 8)) == 1 and (6, odd_rows()[6][1]) in kept
        assert sum(n for (i, _), n in kept.items() if i in (0, 1, 2, None)) == 4 and len(rows) == docs.count() - 4
    else:
        assert len(rows) == docs.count() and (9, "write to <EMAIL> or <IP> please, said someone there") in kept and (0, None) in kept and (1, "") in kept


def test_language_stage_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[j * (i + 1) % 21] for j in range(30)), "en", None, None, i, "d", b"s", "c", i, i) for i in range(1, 80)] + odd_rows(), COLUMNS)
    out = corpus_pipeline.language_id(spark, docs, SF)
    rows = out.collect()
    assert out.columns == docs.columns and not [r for r in rows if r.text is None or not any(map(str.isalpha, r.text))]
    assert sum(r.cf_drops == "d" and 1 <= (r.doc_id or 0) < 80 for r in rows) > 70
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
