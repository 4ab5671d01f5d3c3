"""Change-history queries, and the flagship that scores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import ScoringConfig
from gaugeworks.operators import scoring, temporal
from gaugeworks.plans.adapters import AS_OF, BRANDS_SQL, CHANGES_SQL, by_brand, by_part, changes, commits, history, table
from gaugeworks.report import render
from gaugeworks.sources.history import parse_history

#: Orders spread over all brands, so the strength that splits pairs lies far lower than in a code history.
STRONG = 16.0
_SINCE = "ts >= TIMESTAMP '2001-05-03'"


def churn(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.churn_rate(commits(spark, sf), changes(spark, sf), AS_OF).select("repo_id", "commits", F.round("churn_rate", 6).alias("churn_rate"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.coupled_pairs(changes(spark, sf, by_brand=True)).select("repo_id", "a", "b", "shared", F.round("strength", 6).alias("strength"))


def bulk_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of part types that customers order together; a customer is a commit, and those of more than 50 types are bulk."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("hash"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("hash"), F.col("c_mktsegment").alias("repo_id"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", F.substring("p_name", 1, 1)).alias("path"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(customer, "hash").join(part, "l_partkey")
    got = temporal.coupled_pairs(rows)
    return got.select("repo_id", "a", "b", "shared", F.round("strength", 6).alias("strength"))


def coupling(spark: SparkSession, sf: str) -> DataFrame:
    got = temporal.coupling(temporal.coupled_pairs(changes(spark, sf, by_brand=True)), STRONG)
    return got.select("repo_id", "pairs", "strong_pairs", F.round("temporal_coupling_pct", 6).alias("temporal_coupling_pct"))


def fragmentation(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.author_fragmentation(changes(spark, sf), AS_OF).select("repo_id", "files", F.round("author_fragmentation", 6).alias("author_fragmentation"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.change_gaps(changes(spark, sf)).groupBy("repo_id").agg(F.count("*").alias("gaps"), F.round(F.avg("gap_days"), 6).alias("mean_gap"), F.max("gap_days").alias("longest_gap"))


def stability(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.commit_stability(changes(spark, sf)).select("repo_id", F.round("commit_stability", 6).alias("commit_stability"))


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.hotspot_concentration(temporal.file_changes(changes(spark, sf))).select("repo_id", F.round("hotspot_concentration", 6).alias("hotspot_concentration"))


def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.top_hotspots(temporal.file_changes(changes(spark, sf)))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The orders printed as a history's text, and read back by the parser."""
    o = table(spark, sf, "orders")
    line = table(spark, sf, "lineitem")
    key = F.concat(F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")))
    header = o.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.concat_ws("|", key, F.concat(F.col("o_custkey").cast("string"), F.lit("@x")), F.unix_timestamp("o_orderdate").cast("string")).alias("value"))
    stats = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat_ws("\t", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit("src/{old => "), F.col("l_partkey").cast("string"), F.lit("}/f.go"))).alias("value"))
    text = header.unionByName(stats).select(F.concat(F.lit("r"), F.col("k") % 64).alias("repo_id"), (F.col("k") * 1000 + F.col("n")).alias("line_no"), "value")
    return parse_history(text).groupBy("repo_id").agg(F.count("path").alias("changes"), F.count_distinct("hash").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct("path").alias("paths"))


def _sub(spark: SparkSession, sf: str) -> DataFrame:
    """Scored history metrics; coupling is measured between brands, the rest between parts."""
    config = ScoringConfig().frame(spark)
    lines, parts = history(spark, sf)
    got = temporal.history_metrics(commits(spark, sf), by_part(lines), AS_OF, STRONG, coupled=by_brand(lines), parts=parts)
    return scoring.score_metrics(got, config)


def sub_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _sub(spark, sf).select("repo_id", "category", "metric", F.round("raw_value", 6).alias("raw_value"), F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories with their composite, tier and badge."""
    got = scoring.composite_scores(scoring.category_scores(_sub(spark, sf)))
    return got.select("repo_id", F.round("composite", 6).alias("composite"), "tier", render.badge(F.col("tier"), F.col("composite")).alias("badge"))


def advice(spark: SparkSession, sf: str) -> DataFrame:
    got = scoring.recommend(_sub(spark, sf))
    return got.select("repo_id", "rank", "metric", F.round("current_score", 6).alias("current_score"), "target_value", "target_score", F.round("score_improvement", 6).alias("score_improvement"), "effort")


CHURN_SQL = f"""
WITH ch AS ({CHANGES_SQL}),
n AS (SELECT o_orderpriority AS repo_id, count(DISTINCT o_orderkey) AS commits FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-03' GROUP BY 1),
l AS (SELECT repo_id, sum(added + deleted) AS lines FROM ch WHERE {_SINCE} GROUP BY 1)
SELECT repo_id, commits, round(coalesce(lines / commits, 0.0), 6) AS churn_rate FROM n LEFT JOIN l USING (repo_id)
"""
_PAIRS = f"""
f AS (SELECT DISTINCT repo_id, hash, path FROM ({BRANDS_SQL})),
s AS (SELECT * FROM f WHERE (repo_id, hash) IN (SELECT repo_id, hash FROM f GROUP BY 1, 2 HAVING count(*) <= 50)),
e AS (SELECT repo_id, path, count(*) AS c FROM s GROUP BY 1, 2 HAVING count(*) >= 5),
t AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS shared FROM s x JOIN s y ON x.repo_id = y.repo_id AND x.hash = y.hash AND x.path < y.path GROUP BY 1, 2, 3),
p AS (SELECT t.*, 100.0 * shared / least(e1.c, e2.c) AS strength FROM t JOIN e e1 ON e1.repo_id = t.repo_id AND e1.path = a JOIN e e2 ON e2.repo_id = t.repo_id AND e2.path = b)
"""
PAIRS_SQL = f"WITH {_PAIRS} SELECT repo_id, a, b, shared, round(strength, 6) AS strength FROM p"
COUPLING_SQL = f"""
WITH {_PAIRS} SELECT repo_id, count(*) AS pairs, count(*) FILTER (strength > 16) AS strong_pairs,
round(100.0 * count(*) FILTER (strength > 16) / count(*), 6) AS temporal_coupling_pct FROM p GROUP BY 1
"""
FRAGMENTATION_SQL = f"""
WITH f AS (SELECT repo_id, path, count(DISTINCT author) AS authors FROM ({CHANGES_SQL}) WHERE {_SINCE} GROUP BY 1, 2)
SELECT repo_id, count(*) AS files, round(avg(authors), 6) AS author_fragmentation FROM f GROUP BY 1
"""
_GAPS = f"""
g AS (SELECT repo_id, date_diff('second', lag(ts) OVER (PARTITION BY repo_id, path ORDER BY ts, hash), ts) / 86400.0 AS gap FROM ({CHANGES_SQL}))
"""
GAPS_SQL = f"WITH {_GAPS} SELECT repo_id, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap, max(gap) AS longest_gap FROM g WHERE gap IS NOT NULL GROUP BY 1"
_STABLE = f"""
{_GAPS}, l AS (SELECT repo_id, list_sort(list(gap)) AS gs FROM g WHERE gap IS NOT NULL GROUP BY 1),
stable AS (SELECT repo_id, coalesce(gs[len(gs) // 2 + 1], 30.0) AS commit_stability FROM (SELECT DISTINCT o_orderpriority AS repo_id FROM orders) LEFT JOIN l USING (repo_id))
"""
STABILITY_SQL = f"WITH {_STABLE} SELECT repo_id, round(commit_stability, 6) AS commit_stability FROM stable"
_FILES = f"""
fc AS (SELECT repo_id, path, sum(added + deleted) AS total_changes, count(DISTINCT hash) AS commits, count(DISTINCT author) AS authors FROM ({CHANGES_SQL}) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY total_changes DESC, path) AS rank, count(*) OVER (PARTITION BY repo_id) AS files FROM fc)
"""
HOTSPOTS_SQL = f"""
WITH {_FILES} SELECT repo_id, round(100.0 * sum(CASE WHEN rank <= greatest(1, files // 10) THEN total_changes ELSE 0 END) / sum(total_changes), 6) AS hotspot_concentration FROM fr GROUP BY 1
"""
TOP_FILES_SQL = f"WITH {_FILES} SELECT repo_id, path, CAST(total_changes AS BIGINT) AS total_changes, commits, authors, rank FROM fr WHERE rank <= 10"
PARSED_SQL = """
SELECT 'r' || (o_orderkey % 64) AS repo_id, count(l_orderkey) AS changes, count(DISTINCT o_orderkey) AS commits,
CAST(sum(coalesce(CAST(l_quantity AS INT), 0)) AS BIGINT) AS added, CAST(sum(coalesce(l_linenumber, 0)) AS BIGINT) AS deleted, count(DISTINCT l_partkey) AS paths
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
"""
_C5 = {m.name: m for m in ScoringConfig().metrics if m.category == "C5"}


def _interpolated(name: str, column: str) -> str:
    """A metric's score as a CASE over its breakpoints."""
    b = _C5[name].breakpoints
    out = f"CASE WHEN {column} <= {b[0][0]} THEN {b[0][1]}"
    for (v0, s0), (v1, s1) in zip(b, b[1:], strict=False):
        out += f" WHEN {column} <= {v1} THEN {s0} + ({column} - {v0}) / ({v1} - {v0}) * ({s1} - {s0})"
    return f"{out} ELSE {b[-1][1]} END"


_VALUES = f"""
{_PAIRS}, {_STABLE}, {_FILES}, ch AS ({CHANGES_SQL}),
m AS (
  SELECT repo_id, 'churn_rate' AS metric, coalesce(lines / commits, 0.0) AS v FROM (SELECT o_orderpriority AS repo_id, count(DISTINCT o_orderkey) AS commits FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-03' GROUP BY 1) LEFT JOIN (SELECT repo_id, sum(added + deleted) AS lines FROM ch WHERE {_SINCE} GROUP BY 1) USING (repo_id)
  UNION ALL SELECT repo_id, 'temporal_coupling_pct', 100.0 * count(*) FILTER (strength > 16) / count(*) FROM p GROUP BY 1
  UNION ALL SELECT repo_id, 'author_fragmentation', avg(authors) FROM (SELECT repo_id, path, count(DISTINCT author) AS authors FROM ch WHERE {_SINCE} GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT repo_id, 'commit_stability', commit_stability FROM stable
  UNION ALL SELECT repo_id, 'hotspot_concentration', 100.0 * sum(CASE WHEN rank <= greatest(1, files // 10) THEN total_changes ELSE 0 END) / sum(total_changes) FROM fr GROUP BY 1),
c(metric, weight) AS (VALUES {", ".join(f"('{m.name}', {m.weight})" for m in _C5.values())}),
sub AS (
  SELECT r.repo_id, 'C5' AS category, c.metric, weight, coalesce(v, 0.0) AS raw_value,
    CASE c.metric {" ".join(f"WHEN '{n}' THEN {_interpolated(n, 'coalesce(v, 0.0)')}" for n in _C5)} END AS score
  FROM (SELECT DISTINCT repo_id FROM m) r CROSS JOIN c LEFT JOIN m ON m.repo_id = r.repo_id AND m.metric = c.metric)
"""
SUB_SQL = f"WITH {_VALUES} SELECT repo_id, category, metric, round(raw_value, 6) AS raw_value, round(score, 6) AS score FROM sub"
FLAGSHIP_SQL = f"""
WITH {_VALUES},
comp AS (SELECT repo_id, sum(weight * score) / sum(weight) AS composite FROM sub GROUP BY 1),
tiered AS (SELECT *, CASE WHEN composite >= 8 THEN 'Agent-Ready' WHEN composite >= 6 THEN 'Agent-Assisted' WHEN composite >= 4 THEN 'Agent-Limited' ELSE 'Agent-Hostile' END AS tier FROM comp)
SELECT repo_id, round(composite, 6) AS composite, tier,
  'https://img.shields.io/badge/agent--readiness-' || replace(tier, '-', '--') || '%20' || printf('%.1f', composite) || '%2F10-' ||
  CASE tier WHEN 'Agent-Ready' THEN 'green' WHEN 'Agent-Assisted' THEN 'yellow' WHEN 'Agent-Limited' THEN 'orange' ELSE 'red' END AS badge
FROM tiered
"""
_POINTS = ", ".join(f"('{m.name}', {i}, {v}, {s})" for m in _C5.values() for i, (v, s) in enumerate(m.breakpoints))
ADVICE_SQL = f"""
WITH {_VALUES},
bp(metric, i, target_value, target_score) AS (VALUES {_POINTS}),
o AS (SELECT *, sum(weight) OVER (PARTITION BY repo_id) AS w FROM sub),
x AS (SELECT o.*, target_value, target_score, row_number() OVER (PARTITION BY repo_id, o.metric ORDER BY target_score, i) AS k FROM o JOIN bp ON bp.metric = o.metric AND target_score > score WHERE score < 9),
y AS (SELECT *, weight / w * (target_score - score) AS gain FROM x WHERE k = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(gain, 9) DESC, metric) AS rank FROM y WHERE gain > 0)
SELECT repo_id, rank, metric, round(score, 6) AS current_score, CAST(target_value AS DOUBLE) AS target_value, CAST(target_score AS DOUBLE) AS target_score, round(gain, 6) AS score_improvement,
  CASE WHEN target_score - score >= 2.5 THEN 'High' WHEN target_score - score >= 1 THEN 'Medium' ELSE 'Low' END AS effort
FROM z WHERE rank <= 5
"""

_BULK = """
f AS (SELECT DISTINCT c_mktsegment AS repo_id, o_custkey AS hash, p_brand || '/' || p_name[1] AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
"""
BULK_SQL = f"WITH {_BULK} {_PAIRS[_PAIRS.index('s AS ('):]} SELECT repo_id, a, b, shared, round(strength, 6) AS strength FROM p"

QUERIES = {
    "flt17_bulk_commits": (bulk_pairs, BULK_SQL),
    "agg15_churn_rate": (churn, CHURN_SQL),
    "jn10_coupled_pairs": (pairs, PAIRS_SQL),
    "agg16_temporal_coupling": (coupling, COUPLING_SQL),
    "agg17_author_fragmentation": (fragmentation, FRAGMENTATION_SQL),
    "win1_change_gaps": (gaps, GAPS_SQL),
    "win2_commit_stability": (stability, STABILITY_SQL),
    "agg18_hotspot_concentration": (hotspots, HOTSPOTS_SQL),
    "top7_hotspots": (top_files, TOP_FILES_SQL),
    "src11_history_text": (parsed, PARSED_SQL),
    "sco2_sub_scores": (sub_scores, SUB_SQL),
    "agg23_composite": (flagship, FLAGSHIP_SQL),
    "sco7_recommendations": (advice, ADVICE_SQL),
}
