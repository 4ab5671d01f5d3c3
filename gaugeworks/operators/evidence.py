"""Evidence rows (metric, rank, file, value, description) behind scores: the worst few of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.steps import kept

TOP = 5


def ranked(rows: DataFrame, metric: str, order: list[Column | str], file: Column, value: Column, description: Column, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each repository in an order, as evidence for a metric."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    found = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return found.select("repo_id", F.lit(metric).alias("metric"), "rank", file.cast("string").alias("file"), value.cast("double").alias("value"), description.alias("description"))


def coupling_evidence(degrees: DataFrame, top: int = TOP) -> DataFrame:
    """Nodes of the largest afferent and efferent degree."""
    out = None
    for side in ("afferent", "efferent"):
        part = ranked(degrees, f"{side}_coupling_avg", [F.desc(side), "node"], F.col("node"), F.col(side), F.format_string("%d " + ("dependents" if side == "afferent" else "dependencies"), side), top)
        out = part if out is None else out.unionByName(part)
    return out


def dead_export_evidence(dead: DataFrame, top: int = TOP) -> DataFrame:
    """The first dead exports (unit, name)."""
    return ranked(dead, "dead_exports", ["unit", "name"], F.col("unit"), F.lit(1), F.concat(F.col("name").cast("string"), F.lit(" is never imported")), top)


def history_evidence(files: DataFrame, pairs: DataFrame, listed: int = 10, top: int = TOP) -> DataFrame:
    """Evidence of the history metrics: of the ``listed`` most changed files the first by changes (with their
    commits, and with their changes) and by authors, and the most coupled pairs."""
    most = Window.partitionBy("repo_id").orderBy(F.desc("total_changes"), "path")
    hot = kept(files.withColumn("place", F.row_number().over(most)).where(F.col("place") <= listed))
    path = F.col("path")
    return (
        ranked(hot, "churn_rate", ["place"], path, F.col("commits"), F.format_string("%d commits", "commits"), top)
        .unionByName(ranked(hot, "hotspot_concentration", ["place"], path, F.col("total_changes"), F.format_string("hotspot: %d changes", "total_changes"), top))
        .unionByName(ranked(hot, "author_fragmentation", [F.desc("authors"), "place"], path, F.col("authors"), F.format_string("%d distinct authors", "authors"), top))
        .unionByName(ranked(pairs, "temporal_coupling_pct", [F.desc("strength"), "a", "b"], F.col("a"), F.col("strength"), F.format_string("coupled with %s", "b"), top))
    )
