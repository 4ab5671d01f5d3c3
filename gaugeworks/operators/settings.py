"""Settings of many repositories as data: documents to rows, rows laid over each other, scores by them.

A repository may have a scoring file (``file``) and a project document (``project``); a project goes before a
file, and a file before the defaults. Documents are JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.scoring import score_metrics

#: Layers from the first to the last that decides.
LAYERS = {"file": 1, "project": 2}
_POINT = "array<struct<value:double,score:double>>"
_FILE = f"struct<categories:map<string,struct<weight:double,metrics:array<struct<name:string,weight:double,breakpoints:{_POINT}>>>>>"
_PROJECT = "struct<version:int,scoring:struct<weights:map<string,double>,threshold:double>>"


def settings_rows(documents: DataFrame) -> DataFrame:
    """Rows of settings from documents (repo_id, layer, content): repo_id, place, category, metric, weight, breakpoints.

    Rows without a metric weigh a category. Documents that can't be read, of an unknown version, or with a negative
    weight or threshold count as absent; ``settings_errors`` names them.
    """
    read = _read(documents).where("error is null")
    place = F.coalesce(*(F.when(F.col("layer") == k, v) for k, v in LAYERS.items())).alias("place")
    empty = F.lit(None).cast(_POINT).alias("breakpoints")
    weights = read.select("repo_id", place, F.explode("project.scoring.weights").alias("category", "weight")).select("repo_id", "place", "category", F.lit(None).cast("string").alias("metric"), "weight", empty)
    category = read.select("repo_id", place, F.explode("file.categories").alias("category", "c"))
    of_file = category.select("repo_id", "place", "category", F.lit(None).cast("string").alias("metric"), F.col("c.weight").alias("weight"), empty).where("weight is not null")
    metric = category.select("repo_id", "place", "category", F.explode("c.metrics").alias("m")).select("repo_id", "place", "category", F.col("m.name").alias("metric"), F.col("m.weight").alias("weight"), F.col("m.breakpoints").alias("breakpoints"))
    return weights.unionByName(of_file).unionByName(metric)


def _read(documents: DataFrame) -> DataFrame:
    """Documents with their parts and an ``error`` where they can't be used."""
    file, project = (F.when(F.col("layer") == k, F.from_json("content", kind)) for k, kind in (("file", _FILE), ("project", _PROJECT)))
    rows = documents.withColumn("file", file).withColumn("project", project)
    some = F.map_values("project.scoring.weights")
    negative = F.coalesce(F.exists(some, lambda w: w < 0), F.lit(False)) | F.coalesce(F.col("project.scoring.threshold") < 0, F.lit(False))
    error = F.when(~F.col("layer").isin(*LAYERS), "unknown layer").when(F.get_json_object("content", "$").isNull() & (F.trim("content") != ""), "no JSON")
    error = error.when(~F.coalesce(F.col("project.version"), F.lit(0)).isin(0, 1), "unknown version").when(negative, "negative number")
    return rows.withColumn("error", error)


def settings_errors(documents: DataFrame) -> DataFrame:
    """repo_id, layer and error of the documents that are not used."""
    return _read(documents).where("error is not null").select("repo_id", "layer", "error")


def latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each of ``keys`` the value of the deciding layer, nulls saying nothing; of one layer the largest."""
    given = rows.where(F.col(value).isNotNull())
    return given.groupBy(*keys).agg(F.max(F.struct("place", value)).alias("v")).select(*keys, F.col(f"v.{value}").alias(value))


def segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Breakpoints as rows: from above ``low`` up to ``high`` a score runs from ``from_score`` to ``to_score``.

    The first and the last row reach to no end and are level.
    """
    rows = points.select(*keys, F.posexplode("breakpoints").alias("at", "p")).select(*keys, "at", "p.value", "p.score")
    order = Window.partitionBy(*keys).orderBy("at")
    upto = rows.select(*keys, F.lag("value").over(order).alias("low"), F.col("value").alias("high"), F.lag("score").over(order).alias("from_score"), F.col("score").alias("to_score"), F.lead("value").over(order).isNull().alias("last"))
    beyond = upto.where("last").select(*keys, F.col("high").alias("low"), F.lit(None).cast("double").alias("high"), F.col("to_score").alias("from_score"), "to_score")
    return upto.drop("last").unionByName(beyond)


def score_with_settings(raw: DataFrame, config: DataFrame, rows: DataFrame) -> DataFrame:
    """``score_metrics`` of ``raw`` where each repository's ``rows`` of settings are laid over ``config``.

    Weights are met by repository and name. Values of metrics with breakpoints of their own meet the one segment of
    theirs they lie in, by an equi-join with a range; all others keep the score by the defaults. Settings of unknown
    categories and metrics say nothing.
    """
    scored = score_metrics(raw, config)
    of_category = latest(rows.where("metric is null"), ["repo_id", "category"], "weight").withColumnRenamed("weight", "own_category")
    of_metric = latest(rows.where("metric is not null"), ["repo_id", "category", "metric"], "weight").withColumnRenamed("weight", "own_weight")
    points = latest(rows.where("metric is not null and size(breakpoints) > 0"), ["repo_id", "category", "metric"], "breakpoints").withColumnRenamed("breakpoints", "own_points")
    out = scored.join(of_category, ["repo_id", "category"], "left").join(of_metric.join(points, ["repo_id", "category", "metric"], "full"), ["repo_id", "category", "metric"], "left")
    part = segments(points.withColumnRenamed("own_points", "breakpoints"), ["repo_id", "category", "metric"])
    own = out.where("own_points is not null and available").select("repo_id", "category", "metric", "raw_value").join(part, ["repo_id", "category", "metric"])
    inside = (F.col("low").isNull() | (F.col("raw_value") > F.col("low"))) & (F.col("high").isNull() | (F.col("raw_value") <= F.col("high")))
    met = own.where(inside).select("repo_id", "category", "metric", _along().alias("own_score"))
    joined = out.join(met, ["repo_id", "category", "metric"], "left")
    replaced = {"category_weight": F.coalesce("own_category", "category_weight"), "weight": F.coalesce("own_weight", "weight"), "breakpoints": F.coalesce("own_points", "breakpoints"), "score": F.coalesce("own_score", "score")}
    return joined.withColumns(replaced).select(*scored.columns)


def _along() -> Column:
    """The score on a segment."""
    share = (F.col("raw_value") - F.col("low")) / (F.col("high") - F.col("low"))
    return F.when(F.col("low").isNull() | F.col("high").isNull(), F.col("to_score")).otherwise(F.col("from_score") + share * (F.col("to_score") - F.col("from_score")))
