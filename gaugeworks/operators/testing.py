"""Tests: external dependencies of their files, assertions, and evidence for both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import top_module

# Modules that reach outside a test's process, by language, and parts of Go paths that do.
OUTSIDE = {
    "go": ("net/http", "net", "database/sql", "os/exec", "net/rpc", "net/smtp"),
    "python": ("requests", "urllib", "httpx", "aiohttp", "sqlalchemy", "psycopg2", "pymongo", "redis", "boto3", "socket", "http", "subprocess"),
    "typescript": (
        "axios", "node-fetch", "pg", "mysql2", "mongoose", "prisma", "redis", "ioredis", "http", "https", "net", "fs", "child_process",
        "got", "superagent", "knex", "typeorm", "sequelize",
    ),
}
GO_PARTS = "http|sql|redis|mongo"


def is_external(language: Column, module: Column) -> Column:
    """Whether an import reaches outside the process."""
    go = module.isin(*OUTSIDE["go"]) | (module.contains("github.com") & module.rlike(GO_PARTS))
    python = F.substring_index(module, ".", 1).isin(*OUTSIDE["python"])
    script = ~module.startswith(".") & top_module(module).isin(*OUTSIDE["typescript"])
    return F.when(language == "go", go).when(language == "python", python).otherwise(script)


def external_files(imports: DataFrame) -> DataFrame:
    """Files (repo_id, file) with an import (language, module) that is external."""
    return imports.where(is_external(F.col("language"), F.col("module"))).select("repo_id", "file").distinct()


def with_external(tests: DataFrame, external: DataFrame) -> DataFrame:
    """Tests with their file's flag; files that are not listed have none."""
    flagged = external.select("repo_id", "file").distinct().withColumn("external", F.lit(True))
    return tests.join(flagged, ["repo_id", "file"], "left").withColumn("external", F.coalesce("external", F.lit(False)))


def assertion_density(tests: DataFrame) -> DataFrame:
    """Mean and largest number of assertions of a repository's tests, and the first test (in file and line order) with the largest; none where it is 0."""
    most = F.max("assertions")
    first = F.min(F.struct((-F.col("assertions")).alias("n"), "file", "line", "name"))["name"]
    return tests.groupBy("repo_id").agg(F.avg("assertions").alias("avg"), most.alias("max"), F.when(most > 0, first).otherwise("").alias("max_entity"))


def test_evidence(flagged: DataFrame, top: int = 5) -> DataFrame:
    """The first tests with an external dependency, and those with the fewest assertions: repo_id, metric, rank, file, line, value, description."""
    order = Window.partitionBy("repo_id")
    some = flagged.where("external").withColumn("rank", F.row_number().over(order.orderBy("file", "line", "name"))).where(F.col("rank") <= top)
    few = flagged.withColumn("rank", F.row_number().over(order.orderBy("assertions", "file", "line", "name"))).where(F.col("rank") <= top)
    cols = ["repo_id", "metric", "rank", "file", "line", "value", "description"]
    first = some.withColumns({"metric": F.lit("test_isolation"), "value": F.lit(1.0), "description": F.concat("name", F.lit(" has external dependency"))}).select(cols)
    second = few.withColumns({"metric": F.lit("assertion_density_avg"), "value": F.col("assertions").cast("double"), "description": F.format_string("%s has %d assertions", "name", "assertions")}).select(cols)
    return first.unionByName(second)
