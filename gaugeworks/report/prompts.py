"""Report rows that tell what to do: targets, breakpoint traces, prompts, bullets, replies, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import rounded
from gaugeworks.operators.scoring import GOOD_SCORE

# The best score, and commands that build and test a project of a language.
BEST = 10.0
BUILD = {"go": "go build ./...\ngo test ./...", "python": "python -m pytest", "typescript": "npm test"}
TEST = {"go": "go test ./...", "python": "python -m pytest", "typescript": "npm test"}
CATEGORY_NAMES = {
    "C1": "Code health", "C2": "Explicit semantics", "C3": "Architecture", "C4": "Documentation",
    "C5": "Change history", "C6": "Tests", "C7": "Agent evaluation",
}


def next_target(breakpoints: Column, score: Column) -> Column:
    """(value, score) of the next breakpoint worth reaching.

    Where scores rise with values: the first breakpoint above the score, else the
    last one; where they fall: the last above it, else the first one.
    """
    first, last = F.try_element_at(breakpoints, F.lit(1)), F.try_element_at(breakpoints, F.lit(-1))
    above = F.filter(breakpoints, lambda b: b["score"] > score)
    rising = F.coalesce(F.try_element_at(above, F.lit(1)), last)
    falling = F.coalesce(F.try_element_at(above, F.lit(-1)), first)
    point = lambda value, s: F.struct(value.alias("value"), s.alias("score"))
    return (
        F.when(F.size(breakpoints) == 0, point(F.lit(0.0), score))
        .when(score >= BEST, point(last["value"], F.lit(BEST)))
        .when(first["score"] < last["score"], rising)
        .otherwise(falling)
    )


def number_text(value: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def trace_rows(sub: DataFrame) -> DataFrame:
    """One row for each breakpoint of a scored metric: its range, its score, and whether the value lies there."""
    points = sub.select("repo_id", "metric", "raw_value", "breakpoints", F.posexplode("breakpoints").alias("at", "point"))
    before = F.try_element_at("breakpoints", F.when(F.col("at") > 0, F.col("at")))["value"]
    value, last = F.col("point.value"), F.col("at") == F.size("breakpoints") - 1
    text = F.when(F.col("at") == 0, F.concat(F.lit("<= "), number_text(value))).when(last, F.concat(F.lit(">= "), number_text(value))).otherwise(F.concat(number_text(before), F.lit(" - "), number_text(value)))
    at_or_above = F.array_position(F.transform("breakpoints", lambda b: b["value"] >= F.col("raw_value")), True)
    band = F.when(at_or_above > 0, at_or_above - 1).otherwise(F.size("breakpoints") - 1)
    return points.select("repo_id", "metric", F.col("at").alias("row"), text.alias("range"), F.col("point.score").alias("score"), (F.col("at") == band).alias("current"))


def shown(sub: DataFrame) -> DataFrame:
    """Metrics that count: those without weight are not shown."""
    return sub.where("weight != 0")


def by_language(language: Column, texts: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, text in texts.items():
        out = F.when(F.lower(language) == name, F.lit(text)).otherwise(out)
    return out


def prompts(sub: DataFrame) -> DataFrame:
    """A prompt for each available metric below a good score: context, build and test, task, verification.

    ``sub`` has repo_id, language, metric, raw_value, score, available and breakpoints.
    """
    wanted = sub.where(F.col("available") & (F.col("score") < GOOD_SCORE)).withColumn("target", next_target(F.col("breakpoints"), F.col("score")))
    name = F.replace(F.col("metric"), F.lit("_"), F.lit(" "))
    context = F.concat(F.lit("## Context\nThe "), name, F.lit(" of "), F.col("repo_id"), F.lit(" is "), number_text(rounded(F.col("raw_value"), 2)), F.format_string(" (score %.1f of 10).", rounded(F.col("score"), 1)))
    build = F.concat(F.lit("## Build and test\n"), by_language(F.col("language"), BUILD, "# commands of your project"))
    task = F.concat(F.lit("## Task\nBring it to "), number_text(F.col("target.value")), F.format_string(" (score %.1f).", F.col("target.score")))
    check = F.concat(F.lit("## Verification\n"), by_language(F.col("language"), TEST, "# your tests"))
    return wanted.select("repo_id", "metric", F.concat_ws("\n\n", context, build, task, check).alias("prompt"))


def improvement_bullets(html: Column) -> Column:
    """The list items under the heading ``How to Improve`` as lines of bullets; empty without them."""
    after = F.when(html.contains("<h4>How to Improve</h4>"), F.substring_index(F.regexp_extract(html, r"(?s)<h4>How to Improve</h4>(.*)", 1), "<h4>", 1))
    items = F.transform(F.regexp_extract_all(after, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return F.coalesce(F.array_join(F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit(""))


def cycle_text(nodes: Column) -> Column:
    """A cycle's nodes joined by arrows, back to the first."""
    return F.when(F.size(nodes) == 0, "").otherwise(F.array_join(F.concat(nodes, F.slice(nodes, 1, 1)), " -> "))


def reply_score(reply: Column) -> Column:
    """(score, reason, error) of an evaluator's JSON reply; scores outside 1 to 10 and replies that do not parse are errors."""
    got = F.from_json(reply, "structured_output struct<score:int,reason:string>")["structured_output"]
    score = F.coalesce(got["score"], F.lit(0))
    parsed = F.try_parse_json(reply).isNotNull()
    error = F.when(~parsed, "unreadable reply").when(~score.between(1, 10), "score out of range")
    return F.struct(F.when(error.isNull(), score).alias("score"), F.when(error.isNull(), F.coalesce(got["reason"], F.lit(""))).alias("reason"), error.alias("error"))


def metric_names(sub: DataFrame) -> DataFrame:
    """Metrics with the names that reports show, and an impact by their share of the composite."""
    impact = F.col("weight") * F.col("category_weight")
    category = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv]), F.col("category"))
    title = F.initcap(F.replace(F.regexp_replace("metric", "_(avg|pct)$", ""), F.lit("_"), F.lit(" ")))
    return sub.withColumns({"category_name": category, "title": title, "impact": F.when(impact >= 0.04, "high").when(impact >= 0.02, "medium").otherwise("low")})


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def html_reports(scored: DataFrame, sub: DataFrame) -> DataFrame:
    """One self-contained HTML page a repository: composite, tier, and a table of its metrics that count."""
    named = metric_names(shown(sub))
    cell = lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))
    number = F.when(F.col("available"), F.format_string("%.1f", "score")).otherwise("n/a")
    row = F.concat(F.lit("<tr>"), cell(F.col("category_name")), cell(F.col("title")), cell(number), F.lit("</tr>"))
    tables = named.select("repo_id", "category", "metric", row.alias("row")).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("category", "metric", "row"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), escaped(F.col("repo_id")), F.lit("</title></head><body><h1>"), escaped(F.col("repo_id")),
        F.format_string("</h1><p>%.1f of 10, %s</p><table>", "composite", "tier"), body, F.lit("</table></body></html>"),
    )
    return scored.join(tables, "repo_id").select("repo_id", page.alias("html"))
