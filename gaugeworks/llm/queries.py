"""The numbered queries and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import (
    op1_jaccard_join,
    op2_url_filter,
    op3_exact_dedup,
    op4_token_files,
    op5_token_counts,
    op6_packing,
    op7_media,
    op8_substring_dedup,
    op9_toxicity,
    op10_bpe,
    op11_sharding,
    op12_spelling,
    op13_alignment,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join.query,
    "op2_url_filter": op2_url_filter.query,
    "op3_exact_dedup": op3_exact_dedup.query,
    "op4_token_files": op4_token_files.query,
    "op5_token_counts": op5_token_counts.query,
    "op6_packing": op6_packing.query,
    "op7_media": op7_media.query,
    "op8_substring_dedup": op8_substring_dedup.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_bpe": op10_bpe.query,
    "op11_sharding": op11_sharding.query,
    "op12_spelling": op12_spelling.query,
    "op13_alignment": op13_alignment.query,
}
ORACLES: dict[str, str] = {"op2_url_filter": op2_url_filter.ORACLE, "op3_exact_dedup": op3_exact_dedup.ORACLE}
