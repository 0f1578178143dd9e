"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, html_extraction, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing_sources": mixing.op1_mixing_sources,
        "op2_huffman_token_files": token_files.op2_huffman_token_files,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
        "op6_html_extraction": html_extraction.op6_html_extraction,
        "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_substring_dedup": line_dedup.op9_substring_dedup,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.OP3_SQL, "op5_ngram_jaccard_join": ngram_join.OP5_SQL, "op7_embedding_near_dedup": embedding_dedup.OP7_SQL, "op9_substring_dedup": line_dedup.OP9_SQL}
