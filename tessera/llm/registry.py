"""The numbered queries, the pipeline query, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontamination, html_extraction, jaccard_join, language_id, line_dedup, quality_rules, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_language_id": language_id.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_decontamination": decontamination.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_bpe": bpe.op8,
    "op9_html_extraction": html_extraction.op9,
    "op10_quality_rules": quality_rules.op10,
}

ORACLE_SQL = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
}
