"""Coverage reports as rows and percentages: block profiles, LCOV, and Cobertura XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Report files by priority, with their format.
REPORTS = (("cover.out", "profile"), ("lcov.info", "lcov"), ("coverage.lcov", "lcov"), ("cobertura.xml", "cobertura"), ("coverage.xml", "cobertura"))
_BLOCK = r"^(.+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$"


def profile_blocks(lines: DataFrame) -> DataFrame:
    """Statements and hits of each block: repo_id, file, units, hits from lines (repo_id, value)."""
    v = F.col("value")
    return lines.where(v.rlike(_BLOCK)).select("repo_id", F.regexp_extract(v, _BLOCK, 1).alias("file"), F.regexp_extract(v, _BLOCK, 2).cast("int").alias("units"), F.regexp_extract(v, _BLOCK, 3).cast("long").alias("hits"))


def lcov_blocks(lines: DataFrame) -> DataFrame:
    """One unit for each ``DA`` line, hit unless its count is 0."""
    v = F.col("value")
    return lines.where(v.rlike(r"^DA:\d+,")).select("repo_id", F.lit(None).cast("string").alias("file"), F.lit(1).alias("units"), F.regexp_extract(v, r"^DA:\d+,(\d+)", 1).cast("long").alias("hits"))


def covered_percent(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Covered units in per cent of all; null where there are none."""
    hit = F.sum(F.when(F.col("hits") > 0, F.col("units")).otherwise(0))
    return blocks.groupBy(*keys).agg(F.try_divide(hit * 100.0, F.sum("units").cast("double")).alias("coverage_percent"))


def cobertura_percent(xml: Column) -> Column:
    """The root's line rate in per cent; null if the text has none (``xpath`` would fail on text that is no XML)."""
    return F.regexp_extract(xml, r"<coverage\b[^>]*?\bline-rate\s*=\s*[\"']([^\"']*)", 1).try_cast("double") * 100


def repository_coverage(reports: DataFrame) -> DataFrame:
    """The percentage of the first readable report of each repository: repo_id, rel_path, text in."""
    table = reports.sparkSession.createDataFrame([(n, f, i) for i, (n, f) in enumerate(REPORTS)], "name string, format string, priority int")
    named = reports.withColumn("name", F.substring_index("rel_path", "/", -1)).join(F.broadcast(table), "name")
    lines = named.where("format != 'cobertura'").select("repo_id", "priority", "format", F.explode(F.split("text", r"\r?\n")).alias("value"))
    rows = []
    for kind, parse in (("profile", profile_blocks), ("lcov", lcov_blocks)):
        some = lines.where(F.col("format") == kind).withColumn("repo_id", F.struct("repo_id", "priority"))
        rows.append(covered_percent(parse(some), ["repo_id"]).select("repo_id.repo_id", "repo_id.priority", "coverage_percent"))
    xml = named.where("format = 'cobertura'").select("repo_id", "priority", cobertura_percent(F.col("text")).alias("coverage_percent"))
    every = rows[0].unionByName(rows[1]).unionByName(xml).where("coverage_percent is not null")
    return every.groupBy("repo_id").agg(F.min_by("coverage_percent", "priority").alias("coverage_percent"))
