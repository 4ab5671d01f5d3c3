"""Raw metric values of all categories, from one wide row a repository to one row a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.config import METRICS, Metric

#: Coverage that was not measured, and categories that can be missing as a whole.
UNMEASURED, OPTIONAL = -1.0, ("C5", "C7")


def raw_values(wide: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """repo_id, metric, value and available of every metric.

    ``wide`` has a column for each metric, flags (counted as 0 and 1) included;
    ``test_file_ratio`` may come as test_files and source_files instead. Where
    ``c5_available`` or ``c7_available`` is false, that category's metrics have
    no value and are unavailable, and so is a coverage of -1. Categories of
    which ``wide`` has no column are left out.
    """
    have = set(wide.columns)
    if {"test_files", "source_files"} <= have:
        wide = wide.withColumn("test_file_ratio", F.coalesce(F.try_divide("test_files", "source_files"), F.lit(0.0)))
        have.add("test_file_ratio")
    known = {m.category for m in metrics if m.name in have}

    def one(m: Metric) -> Column:
        value = F.col(m.name).cast("double") if m.name in have else F.lit(0.0)
        there = F.lit(True)
        if m.category in OPTIONAL and f"{m.category.lower()}_available" in have:
            there = F.coalesce(F.col(f"{m.category.lower()}_available"), F.lit(False))
            value = F.when(there, value)
        if m.name == "coverage_percent":
            there = there & ~value.eqNullSafe(F.lit(UNMEASURED))
        return F.struct(F.lit(m.name).alias("metric"), value.alias("value"), there.alias("available"))

    rows = F.explode(F.array(*[one(m) for m in metrics if m.category in known])).alias("m")
    return wide.select("repo_id", rows).select("repo_id", "m.metric", "m.value", "m.available")
