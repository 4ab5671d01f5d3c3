"""From raw metric values to metric, category and composite scores, tiers, and what-if rankings.

``raw`` tables have repo_id, metric, value and available (and may have
evidence); the configuration is a table of a few dozen rows, broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.config import TIERS
from gaugeworks.functions.scalars import interpolate

#: Fixed values of the ranking: the score that ends it, the number ranked, effort limits and hard metrics.
GOOD_SCORE, RANKED, HIGH_GAP, MEDIUM_GAP = 9.0, 5, 2.5, 1.0
HARD_METRICS = ("complexity_avg", "duplication_rate")


def score_metrics(raw: DataFrame, config: DataFrame) -> DataFrame:
    """One row for each repository's category and configured metric; a missing value counts as 0.

    Only categories of which the repository has some metric are scored. A
    metric marked as unavailable keeps a score of 0 and no weight later on.
    """
    extra = ["evidence"] if "evidence" in raw.columns else []
    named = raw.join(F.broadcast(config.select("metric", "category")), "metric")
    pair = F.struct("metric", F.struct("value", "available", *extra).alias("got"))
    # A category has a few metrics, each once a repository; so one pass over the values is enough.
    present = named.groupBy("repo_id", "category").agg(F.map_from_entries(F.collect_list(pair)).alias("m"))
    joined = present.join(F.broadcast(config), "category").withColumn("got", F.try_element_at("m", F.col("metric")))
    joined = joined.select("repo_id", "category", "category_weight", "metric", "weight", "breakpoints", "got.*")
    value = F.coalesce("value", F.lit(0.0))
    available = F.coalesce("available", F.lit(True))
    score = F.when(available, interpolate(value, F.col("breakpoints"))).otherwise(F.lit(0.0))
    return joined.select("repo_id", "category", "category_weight", "metric", "weight", "breakpoints", value.alias("raw_value"), available.alias("available"), score.alias("score"), *extra)


def category_scores(sub: DataFrame) -> DataFrame:
    """Weighted means over available metrics; null where none is available."""
    w = F.when(F.col("available"), F.col("weight"))
    return sub.groupBy("repo_id", "category").agg(F.first("category_weight").alias("weight"), F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("score"))


def tier(score: Column, tiers: tuple[tuple[str, float], ...] = TIERS) -> Column:
    """The first tier whose least score is reached, else the last."""
    out = F.lit(tiers[-1][0])
    for name, least in reversed(tiers):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def composite_scores(categories: DataFrame, tiers: tuple[tuple[str, float], ...] = TIERS) -> DataFrame:
    """Weighted mean over scored categories (0 without any) and the tier it reaches."""
    w = F.when(F.col("score").isNotNull(), F.col("weight"))
    mean = F.coalesce(F.try_divide(F.sum(w * F.col("score")), F.sum(w)), F.lit(0.0))
    return categories.groupBy("repo_id").agg(mean.alias("composite")).withColumn("tier", tier(F.col("composite"), tiers))


def target_point(breakpoints: Column, score: Column) -> Column:
    """The breakpoint with the smallest score above the current one, the first of equals."""
    ranked = F.transform(breakpoints, lambda b, i: F.struct(b["score"].alias("score"), i.alias("at"), b["value"].alias("value")))
    return F.array_min(F.filter(ranked, lambda b: b["score"] > score))


def effort(gap: Column, metric: Column) -> Column:
    """Low, Medium or High by the score gap, one step more for metrics that are hard to move."""
    level = F.when(gap >= HIGH_GAP, 2).when(gap >= MEDIUM_GAP, 1).otherwise(0)
    level = F.when(metric.isin(*HARD_METRICS), F.least(F.lit(2), level + 1)).otherwise(level)
    return F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), level + 1)


def recommend(sub: DataFrame, top: int = RANKED) -> DataFrame:
    """The improvements with the largest effect on a repository's composite, ranked.

    Replacing one metric's score s by t moves the composite by the category's
    share of the composite weight, times the metric's share of the category's,
    times t - s; so the what-if needs no second pass over the metrics.
    """
    of_category, of_repo = Window.partitionBy("repo_id", "category"), Window.partitionBy("repo_id")
    own = F.sum(F.when(F.col("available"), F.col("weight"))).over(of_category)
    first = F.row_number().over(of_category.orderBy("metric")) == 1
    shares = sub.withColumn("own_weight", own).withColumn("first", first)
    shares = shares.withColumn("all_weight", F.sum(F.when(F.col("first") & (F.col("own_weight") > 0), F.col("category_weight"))).over(of_repo))
    open_metrics = shares.where(F.col("available") & (F.col("score") < GOOD_SCORE))
    target = target_point(F.col("breakpoints"), F.col("score"))
    found = open_metrics.withColumn("target", target).where("target is not null")
    gap = F.col("target.score") - F.col("score")
    impact = F.coalesce(F.try_divide(F.col("category_weight"), F.col("all_weight")) * F.try_divide(F.col("weight"), F.col("own_weight")) * gap, F.lit(0.0))
    ranked = found.select("repo_id", "category", "metric", F.col("raw_value").alias("current_value"), F.col("score").alias("current_score"), F.col("target.value").alias("target_value"), F.col("target.score").alias("target_score"), impact.alias("score_improvement"), effort(gap, F.col("metric")).alias("effort"))
    order = Window.partitionBy("repo_id").orderBy(F.desc(F.round("score_improvement", 9)), "category", "metric")
    return ranked.where("score_improvement > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def with_texts(recommendations: DataFrame, texts: DataFrame) -> DataFrame:
    """Summary and action for each recommendation, from a small template table (metric, title, action)."""
    out = recommendations.join(F.broadcast(texts), "metric", "left")
    title = F.coalesce("title", F.initcap(F.replace(F.col("metric"), F.lit("_"), F.lit(" "))))
    summary = F.format_string("%s: %.1f to %.1f", title, "current_value", "target_value")
    action = F.coalesce("action", F.format_string("Move %s from %.1f to %.1f", F.col("metric"), F.col("current_value"), F.col("target_value")))
    return out.withColumn("summary", summary).withColumn("action", action).drop("title")
