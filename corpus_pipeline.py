"""The corpus pipeline: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage as Parquet
in the cluster's shared folder and reads it back as the next one's documents,
so a lost executor costs part of one stage at most.

Defined results, in all stages: other columns come along as they are, whatever
their names; a null doc_id is smaller than any and counts as a number of its
own; null texts count as empty, and rows without words pass the three stages
that compare words; of rows equal in doc_id and text one stays after exact
dedup, so that no later stage meets a tie; very long texts are judged whole; an
empty table passes through, and packs to no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import op1_jaccard_join, op3_exact_dedup, op6_packing, op8_substring_dedup, op9_toxicity
from gaugeworks.llm.runtime import materialise, release, table
from gaugeworks.llm.wordbpe import default_path

#: Near duplicates: words of a shingle, and the percentage of similarity from which documents link.
NEAR_WORDS, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return op9_toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest doc_id."""
    return op3_exact_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near duplicates, the row with the smallest doc_id; rows that share only a doc_id stay."""
    return op1_jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words and more that an earlier document holds."""
    return op8_substring_dedup.keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that all remaining documents are packed into."""
    return op6_packing.pack_tokens(docs, default_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = materialise(stage(spark, docs, sf_dir))
        release(before)
        docs = before = now
    return STAGES[-1][1](spark, docs, sf_dir)
