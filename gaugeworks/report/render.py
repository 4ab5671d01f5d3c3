"""Report columns and documents over scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import badge_text
from gaugeworks.sources.history import carried

VERSION = "3"
#: Badge colours of tiers.
TIER_COLOURS = {"Agent-Ready": "green", "Agent-Assisted": "yellow", "Agent-Limited": "orange", "Agent-Hostile": "red"}


def badge(tier: Column, composite: Column, label: str = "agent-readiness") -> Column:
    """A badge address for a tier and score."""
    colour = F.lit("lightgrey")
    for name, c in TIER_COLOURS.items():
        colour = F.when(tier == name, c).otherwise(colour)
    message = F.concat(tier, F.lit(" "), F.format_string("%.1f", composite), F.lit("/10"))
    return F.concat(F.lit("https://img.shields.io/badge/"), badge_text(F.lit(label)), F.lit("-"), badge_text(message), F.lit("-"), colour)


def light(value: Column, green: float, yellow: float, falling: bool = True) -> Column:
    """A traffic light: lower is better, or higher if not ``falling``."""
    if falling:
        return F.when(value <= green, "green").when(value <= yellow, "yellow").otherwise("red")
    return F.when(value < yellow, "red").when(value < green, "yellow").otherwise("green")


def metric_text(metric: Column, value: Column) -> Column:
    """A value as its kind of metric is shown."""
    share = metric.rlike("_(rate|pct|percent|coverage|density|consistency|concentration)$")
    flag = metric.endswith("_present") | (metric == "type_strictness")
    whole = metric.isin("max_dir_depth", "circular_deps", "dead_exports", "readme_word_count")
    yes = F.when(value >= 1, "yes").otherwise("no")
    return F.when(flag, yes).when(whole, F.format_string("%d", F.round(value).cast("long"))).when(share, F.format_string("%.1f%%", value)).otherwise(F.format_string("%.2f", value))


def trend(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current category scores next to an earlier report's (of the same repository where it names one), 0 where it has none."""
    keys = [k for k in ("repo_id", "category") if k in baseline.columns]
    old = baseline.select(*keys, F.col("score").alias("before"))
    return current.join(old, keys, "left").select("repo_id", "category", "score", F.coalesce("before", F.lit(0.0)).alias("before"), (F.col("score") - F.coalesce("before", F.lit(0.0))).alias("change"))


def series_trend(reports: DataFrame, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Each report's category scores next to those of the latest earlier report of its repository: repo_id, at
    (seconds), category, score, before_at, before and change.

    A category that the earlier report lacks counts as 0 there; a repository's first report has nulls. Reports may
    come in any order; two with the same time see the one before both. Earlier times are found by a scan in
    time buckets, carried from bucket to bucket, so a repository of any number of reports is scanned in parts.
    """
    heads = reports.select("repo_id", "at").distinct()
    # A time is asked for just before it is given, so equal times don't see each other.
    events = heads.select("repo_id", (2 * F.col("at")).alias("line_no"), F.lit(None).cast("long").alias("given")).unionByName(heads.select("repo_id", (2 * F.col("at") + 1).alias("line_no"), F.col("at").cast("long").alias("given")))
    found = carried(events, F.col("given"), "before_at", 2 * bucket_seconds).where("given is null").select("repo_id", F.floor(F.col("line_no") / 2).alias("at"), "before_at")
    old = reports.select("repo_id", F.col("at").alias("before_at"), "category", F.col("score").alias("old"))
    joined = reports.join(found, ["repo_id", "at"]).join(old, ["repo_id", "before_at", "category"], "left")
    before = F.when(F.col("before_at").isNotNull(), F.coalesce("old", F.lit(0.0)))
    return joined.select("repo_id", "at", "category", "score", "before_at", before.alias("before"), (F.col("score") - before).alias("change"))


# Up to the first a metric is green, up to the second yellow; or red below the first, yellow below the second.
FALLING_LIGHTS = {
    "complexity_avg": (10, 20), "func_length_avg": (30, 60), "file_size_avg": (300, 500), "duplication_rate": (5, 15),
    "magic_number_ratio": (5, 15),
    "max_dir_depth": (4, 7), "module_fanout_avg": (5, 10), "circular_deps": (0, 2), "dead_exports": (5, 20),
    "churn_rate": (100, 300), "temporal_coupling_pct": (10, 30), "author_fragmentation": (2, 4), "hotspot_concentration": (50, 75),
    "assertion_density_avg": (999, 999),
}
RISING_LIGHTS = {
    "type_annotation_coverage": (50, 80), "naming_consistency": (70, 90), "null_safety": (30, 60),
    "comment_density": (5, 15), "api_doc_coverage": (30, 60),
    "commit_stability": (3, 7),
    "test_to_code_ratio": (0.2, 0.5), "coverage_percent": (40, 70), "test_isolation": (50, 80),
    "task_execution_consistency": (4, 7), "code_behavior_comprehension": (4, 7), "cross_file_navigation": (4, 7),
    "identifier_interpretability": (4, 7), "documentation_accuracy_detection": (4, 7),
}


def _limits(of: dict[str, tuple[float, float]]) -> Column:
    """The limits of a row's metric, null where there are none."""
    pairs = [x for name, two in of.items() for x in (F.lit(name), F.array(*(F.lit(float(v)) for v in two)))]
    return F.try_element_at(F.create_map(*pairs), F.col("metric"))


def metric_lights(sub: DataFrame, green: float = 8.0, yellow: float = 6.0) -> DataFrame:
    """Scored metrics with a traffic light: by the limits of the metric's value, for metrics without limits by the
    score; grey where they are unavailable."""
    value, low, high = F.col("raw_value"), _limits(FALLING_LIGHTS), _limits(RISING_LIGHTS)
    falling = F.when(value <= low[0], "green").when(value <= low[1], "yellow").otherwise("red")
    rising = F.when(value < high[0], "red").when(value < high[1], "yellow").otherwise("green")
    own = F.when(low.isNotNull(), falling).when(high.isNotNull(), rising).otherwise(light(F.col("score"), green, yellow, falling=False))
    return sub.withColumn("light", F.when(F.col("available"), own).otherwise("grey"))


def in_category_order(categories: DataFrame) -> DataFrame:
    """Category results with their place in a repository's report."""
    return categories.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("category")))


def breakpoint_band(value: Column, breakpoints: Column) -> Column:
    """The place (from 1) of the first breakpoint at or above the value, else of the last."""
    at = F.array_position(F.transform(breakpoints, lambda b: b["value"] >= value), True)
    return F.when(at > 0, at).otherwise(F.size(breakpoints)).cast("int")


def json_reports(scored: DataFrame, categories: DataFrame, sub: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One JSON document for each repository; unavailable categories have score -1 there."""
    metric = F.struct("metric", "raw_value", "score", "weight", "available")
    subs = sub.groupBy("repo_id", "category").agg(F.array_sort(F.collect_list(metric)).alias("sub_scores"))
    known = categories.join(subs, ["repo_id", "category"], "left")
    category = F.struct(F.col("category").alias("name"), F.coalesce("score", F.lit(-1.0)).alias("score"), "weight", F.col("score").isNotNull().alias("available"), "sub_scores")
    cats = known.groupBy("repo_id").agg(F.array_sort(F.collect_list(category)).alias("categories"))
    advice = recommendations.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "metric", "current_value", "target_value", "score_improvement", "effort"))).alias("recommendations"))
    none = F.from_json(F.lit("[]"), advice.schema["recommendations"].dataType)
    whole = scored.join(cats, "repo_id", "left").join(advice, "repo_id", "left")
    document = F.struct(F.lit(VERSION).alias("version"), F.col("composite").alias("composite_score"), "tier", "categories", F.coalesce("recommendations", none).alias("recommendations"))
    return whole.select("repo_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


def gate(scored: DataFrame, threshold: float) -> DataFrame:
    """Repositories below the threshold; an empty result passes."""
    return scored.where(F.col("composite") < threshold)
