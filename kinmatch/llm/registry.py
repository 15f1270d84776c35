"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from kinmatch.llm import bpe, exact_dedup, html_main, lm_score, mixing, ngram_join, quality_knn, quality_rules, toxicity, warc


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_quality_knn": quality_knn.op3_quality_knn,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc_fixity": warc.op8_warc_fixity,
        "op9_html_main_text": html_main.op9_html_main_text,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op8_warc_fixity": warc.ORACLE,
        "op10_mix_sources": mixing.ORACLE,
    }
