"""Source trees and reports from any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import line_count
from gaugeworks.operators.classify import pruned

BASELINE_SCHEMA = "version string, composite_score double, tier string, categories array<struct<name:string,score:double,weight:double>>"
RESPONSE_SCHEMA = "metric_id string, sample_index int, file_path string, prompt string, response string, duration_seconds double, error string"


def read_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """A source tree: repo_id, path, rel_path, lines, content; pruned folders are left out.

    ``content`` is only read where a later step uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.substring_index("path", f"{tail}/", -1)
    rows = files.select(F.lit(repo_id).alias("repo_id"), "path", rel.alias("rel_path"), "content")
    return rows.where(~pruned(F.col("rel_path"))).withColumn("lines", line_count(F.col("content").cast("string")))


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Captured responses, one JSON document a file."""
    return spark.read.schema(RESPONSE_SCHEMA).option("multiLine", True).json(folder)


def write_responses(responses: DataFrame, folder: str) -> None:
    """Responses as JSON, in a folder for each metric."""
    responses.write.mode("overwrite").partitionBy("metric_id").json(folder)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Category scores of an earlier report, whatever its version: category, score, weight."""
    report = spark.read.schema(BASELINE_SCHEMA).option("multiLine", True).json(path)
    return report.select(F.explode("categories").alias("c")).select(F.col("c.name").alias("category"), F.col("c.score").alias("score"), F.col("c.weight").alias("weight"))
