"""Version history from text: ``hash|email|epoch`` headers followed by added, deleted, path lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import rename_target

HEADER = r"^([0-9a-f]{40,})\|([^|]*)\|(\d+)$"
#: Line numbers that make a part of a log.
PART_LINES = 65536


def carried(lines: DataFrame, state: Column, name: str, part_lines: int = PART_LINES) -> DataFrame:
    """``lines`` (repo_id, line_no, ...) with ``name``: the last ``state`` that isn't null, at or above each line.

    A scan in two passes. A log is cut into parts of ``part_lines`` line numbers, and each part is scanned by
    itself; the last state of each part is then carried over the parts, one row each, and comes in where a part
    has none above a line. So one log of any length is scanned by as many tasks as it has parts.
    """
    rows = lines.withColumns({"_part": F.floor(F.col("line_no") / part_lines), "_state": state})
    inside = F.last("_state", ignorenulls=True).over(Window.partitionBy("repo_id", "_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    # The part's last state is the one with the greatest line number; max_by passes over the rows without one.
    last = rows.groupBy("repo_id", "_part").agg(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("line_no"))).alias("_last"))
    above = F.last("_last", ignorenulls=True).over(Window.partitionBy("repo_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = last.withColumn("_above", above).select("repo_id", "_part", "_above")
    scanned = rows.withColumn("_inside", inside).join(before, ["repo_id", "_part"])
    return scanned.withColumn(name, F.coalesce("_inside", "_above")).drop("_part", "_state", "_inside", "_above")


def parse_history(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Rows repo_id, hash, author, ts, path, added, deleted from lines (repo_id, line_no, value).

    A header holds for the lines below it until a blank one; binary files
    (a dash for a count) are left out, and a commit without files has one row
    with a null path.
    """
    v = F.col("value")
    head = F.when(v.rlike(HEADER), F.struct(F.regexp_extract(v, HEADER, 1).alias("hash"), F.regexp_extract(v, HEADER, 2).alias("author"), F.regexp_extract(v, HEADER, 3).cast("long").alias("epoch"), F.lit(True).alias("open")))
    closed = F.when(F.trim(v) == "", F.struct(F.lit("").alias("hash"), F.lit("").alias("author"), F.lit(0).cast("long").alias("epoch"), F.lit(False).alias("open")))
    part = F.split(v, "\t")
    stat = carried(lines.select("repo_id", "line_no", "value"), F.coalesce(head, closed), "c", part_lines).where("c.open")
    listed = F.coalesce((F.size(part) == 3) & F.get(part, 0).rlike(r"^\d+$") & F.get(part, 1).rlike(r"^\d+$"), F.lit(False))
    rows = stat.withColumn("listed", listed).where(F.col("listed") | v.rlike(HEADER))
    count = lambda k: F.when(F.col("listed"), F.get(part, k).cast("int")).otherwise(0)
    path = F.when(F.col("listed"), rename_target(F.get(part, 2)))
    rows = rows.select("repo_id", "c.hash", "c.author", F.timestamp_seconds("c.epoch").alias("ts"), path.alias("path"), count(0).alias("added"), count(1).alias("deleted"), "listed")
    # A header stands for its commit only where no file does; both are told in one pass, so the log is scanned once.
    some = F.max("listed").over(Window.partitionBy("repo_id", "hash"))
    return rows.withColumn("some", some).where("listed or not some").drop("listed", "some")
