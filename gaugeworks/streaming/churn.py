"""Churn over sliding windows of a stream of changes: an extension, for histories that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(changes: DataFrame, size: str = "90 days", slide: str = "1 day", late: str = "7 days") -> DataFrame:
    """Changed lines and changes of each repository and window; rows later than ``late`` are left out.

    Works on streams and on tables alike. ``changes`` has repo_id, ts, added and
    deleted; state is bounded by the windows that the watermark keeps open.
    """
    lines = F.col("added") + F.col("deleted")
    grouped = changes.withWatermark("ts", late).groupBy("repo_id", F.window("ts", size, slide).alias("w"))
    return grouped.agg(F.sum(lines).alias("lines"), F.count("*").alias("changes")).select("repo_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "lines", "changes")
