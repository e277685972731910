"""The text operators' queries by name, and DuckDB text for those that SQL can express."""

from __future__ import annotations

from . import idfiles, language, lines, neighbours, ngram_join, packing, privacy, quality, urls, wordpieces

QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_privacy": privacy.op2_privacy,
    "op3_packing": packing.op3_packing,
    "op4_bpe": wordpieces.op4_bpe,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_lines": lines.op6_lines,
    "op7_ids": idfiles.op7_ids,
    "op8_quality": quality.op8_quality,
    "op9_language": language.op9_language,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLES = {"op1_urls": urls.OP1_SQL, "op6_lines": lines.OP6_SQL, "op8_quality": quality.OP8_SQL}
