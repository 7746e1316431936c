"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import ann, decontam, gru_lm, html_main, jaccard, langid, line_dedup, packing, url_rules, warc

QUERIES = {
    "op1_url_filter": url_rules.op1_url_filter,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_html_main_text": html_main.op4_html_main_text,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_warc_roundtrip": warc.op7_warc_roundtrip,
    "op8_language_id": langid.op8_language_id,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_lm_scoring": gru_lm.op10_lm_scoring,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op3_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_warc_roundtrip": warc.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
