"""Queries from raw values of all seven categories to scores, targets, prompts and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import METRICS, TIERS, ScoringConfig
from gaugeworks.operators import evidence, graph, raw_values, scoring, settings, temporal
from gaugeworks.plans.adapters import BRANDS_SQL, CHANGES_SQL, EDGES_SQL, changes, import_edges
from gaugeworks.plans.facts import facts, plain
from gaugeworks.report import prompts, render

#: One wide row a supplier, as a repository: every metric of the seven categories from its order lines.
WIDE = """
SELECT 's' || CAST(l_suppkey AS STRING) AS repo_id, CASE l_suppkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'Python' WHEN 2 THEN 'typescript' ELSE 'rust' END AS language,
CAST(avg(l_quantity) AS DOUBLE) AS complexity_avg, CAST(avg(l_quantity * 2) AS DOUBLE) AS func_length_avg, CAST(max(l_quantity) * 9 AS DOUBLE) AS file_size_avg,
CAST(count(DISTINCT l_partkey) / 20.0 AS DOUBLE) AS afferent_coupling_avg, CAST(count(*) / 40.0 AS DOUBLE) AS efferent_coupling_avg, CAST(avg(l_discount) * 97 AS DOUBLE) AS duplication_rate,
CAST(100.0 * count_if(l_returnflag = 'N') / count(*) AS DOUBLE) AS type_annotation_coverage, CAST(100.0 * count_if(l_linestatus = 'O') / count(*) AS DOUBLE) AS naming_consistency,
CAST(avg(l_tax) * 997 AS DOUBLE) AS magic_number_ratio, max(l_quantity) > 49 AS type_strictness, CAST(100.0 * count_if(l_linenumber > 2) / count(*) AS DOUBLE) AS null_safety,
max(l_linenumber) AS max_dir_depth, CAST(avg(l_linenumber) AS DOUBLE) AS module_fanout_avg, count_if(l_quantity = 50) AS circular_deps, CAST(avg(l_linenumber) / 2 AS DOUBLE) AS import_complexity_avg, count_if(l_quantity > 46) AS dead_exports,
count(*) AS readme_word_count, CAST(avg(l_quantity) / 2 AS DOUBLE) AS comment_density, CAST(100.0 * count_if(l_discount > 0.04) / count(*) AS DOUBLE) AS api_doc_coverage,
l_suppkey % 2 = 0 AS changelog_present, l_suppkey % 3 = 0 AS examples_present, l_suppkey % 5 = 0 AS contributing_present, l_suppkey % 7 = 0 AS diagrams_present,
l_suppkey % 6 <> 0 AS c5_available, CAST(avg(l_quantity) * 11 AS DOUBLE) AS churn_rate, CAST(avg(l_tax) * 317 AS DOUBLE) AS temporal_coupling_pct, CAST(avg(l_linenumber) AS DOUBLE) AS author_fragmentation, CAST(avg(l_discount) * 97 AS DOUBLE) AS commit_stability, CAST(max(l_tax) * 1000 AS DOUBLE) AS hotspot_concentration,
CAST(avg(l_tax) * 11 AS DOUBLE) AS test_to_code_ratio, CASE WHEN l_suppkey % 4 = 3 THEN -1.0 ELSE CAST(avg(l_quantity) * 2 AS DOUBLE) END AS coverage_percent, CAST(100.0 * count_if(l_tax > 0.02) / count(*) AS DOUBLE) AS test_isolation, CAST(avg(l_linenumber) AS DOUBLE) AS assertion_density_avg,
count_if(l_linenumber = 1) AS test_files, count_if(l_linenumber > 1) AS source_files,
l_suppkey % 8 <> 0 AS c7_available, 1 + l_suppkey % 10 AS task_execution_consistency, 1 + l_suppkey % 9 AS code_behavior_comprehension, 10 - l_suppkey % 7 AS cross_file_navigation, 1 + l_suppkey % 3 AS identifier_interpretability, 4 + l_suppkey % 5 AS documentation_accuracy_detection
FROM {lineitem} GROUP BY l_suppkey"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return raw_values.raw_values(facts(spark, sf, WIDE))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).withColumn("value", F.round("value", 9))


def _sub(spark: SparkSession, sf: str, config: ScoringConfig | None = None) -> DataFrame:
    return scoring.score_metrics(_raw(spark, sf), (config or ScoringConfig()).frame(spark))


def _composite(spark: SparkSession, sf: str, config: ScoringConfig | None = None) -> DataFrame:
    return scoring.composite_scores(scoring.category_scores(_sub(spark, sf, config)))


def composite(spark: SparkSession, sf: str) -> DataFrame:
    return _composite(spark, sf).withColumn("composite", F.round("composite", 6))


def overlaid(spark: SparkSession, sf: str) -> DataFrame:
    """Composites with other category weights."""
    return _composite(spark, sf, ScoringConfig().with_weights({"C1": 0.05, "C6": 0.5, "X": 9})).withColumn("composite", F.round("composite", 6))


_DOCUMENTS = """
SELECT 's' || CAST(s_suppkey AS STRING) AS repo_id, 'file' AS layer,
'{"categories":{"C1":{"weight":0.4,"metrics":[{"name":"complexity_avg","weight":0.5,"breakpoints":[{"value":5,"score":10},{"value":' || CAST(20 + s_nationkey AS STRING) || ',"score":4},{"value":60,"score":1}]},{"name":"file_size_avg","weight":0.05}]},"C6":{"metrics":[{"name":"coverage_percent","breakpoints":[{"value":0,"score":1},{"value":100,"score":10}]}]}}}' AS content
FROM {supplier} WHERE s_acctbal > 4000
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'project', CASE WHEN s_nationkey = 3 THEN '{"version":1,"scoring":{"weights":{"C1":-1}}}' WHEN s_nationkey = 5 THEN 'no document' ELSE '{"version":1,"scoring":{"weights":{"C1":0.05,"C6":0.5,"X":9}}}' END
FROM {supplier} WHERE s_nationkey % 2 = 0 OR s_nationkey IN (3, 5)"""


def by_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Composites where each repository is scored by its own documents over the defaults."""
    documents = facts(spark, sf, _DOCUMENTS)
    sub = settings.score_with_settings(_raw(spark, sf), ScoringConfig().frame(spark), settings.settings_rows(documents))
    got = scoring.composite_scores(scoring.category_scores(sub))
    return got.withColumn("composite", F.round("composite", 6))


def bad_settings(spark: SparkSession, sf: str) -> DataFrame:
    return settings.settings_errors(facts(spark, sf, _DOCUMENTS))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """Category scores in the order of categories."""
    return render.in_category_order(scoring.category_scores(_sub(spark, sf))).withColumn("score", F.round("score", 6)).select("repo_id", "category", "weight", "score", "place")


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return render.gate(_composite(spark, sf), 6.0).select("repo_id", F.round("composite", 6).alias("composite"), "tier")


def targets(spark: SparkSession, sf: str) -> DataFrame:
    got = _sub(spark, sf).select("repo_id", "metric", "score", prompts.next_target(F.col("breakpoints"), F.col("score")).alias("t"))
    return got.select("repo_id", "metric", F.round("score", 6).alias("score"), F.col("t.value").alias("target_value"), F.col("t.score").alias("target_score"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.trace_rows(_sub(spark, sf))


def lights(spark: SparkSession, sf: str) -> DataFrame:
    return render.metric_lights(_sub(spark, sf)).select("repo_id", "metric", "light")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    language = facts(spark, sf, WIDE).select("repo_id", "language")
    return prompts.prompts(_sub(spark, sf).withColumn("score", F.round("score", 6)).join(language, "repo_id"))


def named(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.metric_names(prompts.shown(_sub(spark, sf))).groupBy("metric", "title", "category_name", "impact").agg(F.count("*").alias("repositories"))


def advised(spark: SparkSession, sf: str) -> DataFrame:
    template = spark.createDataFrame([("churn_rate", "Churn", "Split large changes"), ("dead_exports", "Dead exports", None)], "metric string, title string, action string")
    got = scoring.with_texts(scoring.recommend(_sub(spark, sf)), template)
    return got.select("repo_id", "rank", "metric", "action")


def json_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports as JSON, read back by path."""
    sub = _sub(spark, sf)
    cats = scoring.category_scores(sub)
    got = render.json_reports(scoring.composite_scores(cats), cats, sub, scoring.recommend(sub))
    value = lambda path: F.get_json_object("report", path)
    return got.select("repo_id", value("$.version").alias("version"), F.round(value("$.composite_score").cast("double"), 6).alias("composite"), value("$.tier").alias("tier"), F.json_array_length(value("$.categories")).cast("long").alias("categories"), F.json_array_length(value("$.recommendations")).cast("long").alias("recommendations"))


def html(spark: SparkSession, sf: str) -> DataFrame:
    sub = _sub(spark, sf)
    page = prompts.html_reports(scoring.composite_scores(scoring.category_scores(sub)), sub)
    return page.select("repo_id", F.regexp_count("html", F.lit("<tr>")).cast("long").alias("rows"), F.regexp_count("html", F.lit("<td>n/a</td>")).cast("long").alias("unavailable"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("heading"))


_HTML = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<h4>Why</h4><li>no</li>' ELSE '<h4>Why</h4><ul><li>no</li></ul><h4>How to Improve</h4><ul><li> <b>' || lang || '</b> first </li><li></li><li>' || source || '</li></ul>' || CASE WHEN doc_id % 2 = 0 THEN '<h4>More</h4><li>later</li>' ELSE '' END END AS html FROM {documents}"""


def bullets(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, _HTML).select("doc_id", prompts.improvement_bullets(F.col("html")).alias("bullets"))


def cycle_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of nations that import each other, as cycles of two."""
    e = import_edges(spark, sf)
    back = e.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["repo_id", "src", "dst"]).select("repo_id", prompts.cycle_text(F.array("src", "dst")).alias("cycle"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cyclic_components(import_edges(spark, sf))


def cycle_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The first cyclic components of each repository, by their smallest node."""
    found = graph.cyclic_components(import_edges(spark, sf)).groupBy("repo_id", "component").agg(F.count("*").alias("size"))
    return evidence.ranked(found, "circular_deps", ["component"], F.col("component"), F.col("size"), F.format_string("%d nodes on cycles", "size"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    got = evidence.history_evidence(temporal.file_changes(changes(spark, sf)), temporal.coupled_pairs(changes(spark, sf, by_brand=True)))
    return got.withColumn("value", F.round("value", 6))


def _scored_sql(config: ScoringConfig = ScoringConfig()) -> str:
    """CTEs w (wide), raw, sub, cat and comp over all metrics."""
    flag = {"C5": "c5_available", "C7": "c7_available"}
    rows = []
    for m in METRICS:
        value = "coalesce(test_files / nullif(source_files, 0), 0.0)" if m.name == "test_file_ratio" else f"CAST({m.name} AS DOUBLE)"
        there = f"coalesce({flag[m.category]}, false)" if m.category in flag else ("coverage_percent <> -1" if m.name == "coverage_percent" else "true")
        if m.category in flag:
            value = f"CASE WHEN {there} THEN {value} END"
        first, *rest = m.breakpoints
        case = f"CASE WHEN v <= {first[0]} THEN {first[1]}" + "".join(f" WHEN v <= {v1} THEN {s0} + (v - {v0}) / ({v1} - {v0}) * ({s1} - {s0})" for (v0, s0), (v1, s1) in zip(m.breakpoints, rest, strict=False)) + f" ELSE {m.breakpoints[-1][1]} END"
        rows.append((m, value, there, case))
    raw_rows = " UNION ALL ".join(f"SELECT repo_id, language, '{m.name}' AS metric, {value} AS value, {there} AS available FROM w" for m, value, there, _ in rows)
    points = ", ".join(f"('{m.category}', {config.categories[m.category]}, '{m.name}', {m.weight}, [{', '.join(f'{v}::DOUBLE' for v, _ in m.breakpoints)}], [{', '.join(f'{s}::DOUBLE' for _, s in m.breakpoints)}])" for m, *_ in rows)
    score = "CASE metric " + " ".join(f"WHEN '{m.name}' THEN {case}" for m, _, _, case in rows) + " END"
    return f"""
w AS ({plain(WIDE)}), raw AS ({raw_rows}), c(category, category_weight, metric, weight, bv, bs) AS (VALUES {points}),
sub AS (SELECT repo_id, language, category, category_weight, metric, weight, v AS raw_value, available, bv, bs, CASE WHEN available THEN {score} ELSE 0.0 END AS score FROM (SELECT *, coalesce(value, 0.0) AS v FROM raw) JOIN c USING (metric)),
cat AS (SELECT repo_id, category, CAST(any_value(category_weight) AS DOUBLE) AS weight, sum(weight * score) FILTER (available) / sum(weight) FILTER (available) AS score FROM sub GROUP BY 1, 2),
comp AS (SELECT repo_id, coalesce(sum(weight * score) FILTER (score IS NOT NULL) / sum(weight) FILTER (score IS NOT NULL), 0.0) AS composite FROM cat GROUP BY 1),
tiered AS (SELECT *, CASE {" ".join(f"WHEN composite >= {s} THEN '{n}'" for n, s in TIERS)} ELSE '{TIERS[-1][0]}' END AS tier FROM comp)
"""


_S = _scored_sql()
_TARGET = "CASE WHEN score >= 10 THEN {b}[-1] WHEN bs[1] < bs[-1] THEN coalesce({b}[list_position(list_transform(bs, lambda s: s > score), true)], {b}[-1]) ELSE coalesce({b}[len(list_filter(bs, lambda s: s > score))], {b}[1]) END"
_TV, _TS = _TARGET.format(b="bv"), "CASE WHEN score >= 10 THEN 10.0 ELSE " + _TARGET.format(b="bs") + " END"
_BAND = "coalesce(list_position(list_transform(bv, lambda x: x >= raw_value), true), len(bv))"
_LIGHTS = """CASE
  WHEN metric IN ('complexity_avg') THEN CASE WHEN raw_value > 20 THEN 'red' WHEN raw_value > 10 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('func_length_avg') THEN CASE WHEN raw_value > 60 THEN 'red' WHEN raw_value > 30 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('file_size_avg') THEN CASE WHEN raw_value > 500 THEN 'red' WHEN raw_value > 300 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('duplication_rate', 'magic_number_ratio') THEN CASE WHEN raw_value > 15 THEN 'red' WHEN raw_value > 5 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('max_dir_depth') THEN CASE WHEN raw_value > 7 THEN 'red' WHEN raw_value > 4 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('module_fanout_avg') THEN CASE WHEN raw_value > 10 THEN 'red' WHEN raw_value > 5 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('circular_deps') THEN CASE WHEN raw_value > 2 THEN 'red' WHEN raw_value > 0 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('dead_exports') THEN CASE WHEN raw_value > 20 THEN 'red' WHEN raw_value > 5 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('churn_rate') THEN CASE WHEN raw_value > 300 THEN 'red' WHEN raw_value > 100 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('temporal_coupling_pct') THEN CASE WHEN raw_value > 30 THEN 'red' WHEN raw_value > 10 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('author_fragmentation') THEN CASE WHEN raw_value > 4 THEN 'red' WHEN raw_value > 2 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('hotspot_concentration') THEN CASE WHEN raw_value > 75 THEN 'red' WHEN raw_value > 50 THEN 'yellow' ELSE 'green' END
  WHEN metric IN ('assertion_density_avg') THEN CASE WHEN raw_value > 999 THEN 'red' ELSE 'green' END
  WHEN metric IN ('type_annotation_coverage', 'test_isolation') THEN CASE WHEN raw_value >= 80 THEN 'green' WHEN raw_value >= 50 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('naming_consistency') THEN CASE WHEN raw_value >= 90 THEN 'green' WHEN raw_value >= 70 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('null_safety', 'api_doc_coverage') THEN CASE WHEN raw_value >= 60 THEN 'green' WHEN raw_value >= 30 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('comment_density') THEN CASE WHEN raw_value >= 15 THEN 'green' WHEN raw_value >= 5 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('commit_stability') THEN CASE WHEN raw_value >= 7 THEN 'green' WHEN raw_value >= 3 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('test_to_code_ratio') THEN CASE WHEN raw_value >= 0.5 THEN 'green' WHEN raw_value >= 0.2 THEN 'yellow' ELSE 'red' END
  WHEN metric IN ('coverage_percent') THEN CASE WHEN raw_value >= 70 THEN 'green' WHEN raw_value >= 40 THEN 'yellow' ELSE 'red' END
  WHEN category = 'C7' THEN CASE WHEN raw_value * 10 >= 70 THEN 'green' WHEN raw_value * 10 >= 40 THEN 'yellow' ELSE 'red' END
  ELSE CASE WHEN score >= 8 THEN 'green' WHEN score >= 6 THEN 'yellow' ELSE 'red' END END"""
_NUM = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_TITLE = "array_to_string(list_transform(string_split(regexp_replace(metric, '_(avg|pct)$', ''), '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
_CATEGORY = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.CATEGORY_NAMES.items()) + " END"
_RANKED = """
x AS (SELECT s.*, list_filter(list_transform(range(1, len(bs) + 1), lambda i: {'s': bs[i], 'i': i, 'v': bv[i]}), lambda p: p.s > s.score) AS up FROM sub s WHERE available AND score < 9),
t AS (SELECT *, list_min(up) AS best FROM x WHERE len(up) > 0),
o AS (SELECT repo_id, category, sum(weight) AS own FROM sub WHERE available GROUP BY 1, 2), a AS (SELECT repo_id, sum(weight) AS every FROM cat WHERE score IS NOT NULL GROUP BY 1),
g AS (SELECT t.*, category_weight / every * weight / own * (best.s - score) AS gain FROM t JOIN o USING (repo_id, category) JOIN a USING (repo_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(gain, 9) DESC, category, metric) AS rank FROM g WHERE gain > 0)
"""
_COMMANDS = "CASE lower(language) WHEN 'go' THEN '{}' WHEN 'python' THEN '{}' WHEN 'typescript' THEN '{}' ELSE '{}' END"
_REACH = f"""
e AS ({EDGES_SQL}), r AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, r.src, e.dst FROM r JOIN e ON r.repo_id = e.repo_id AND r.dst = e.src),
m AS (SELECT a.repo_id, a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2)
"""
QUERIES = {
    "sco4_raw_values": (raw, f"WITH {_S} SELECT repo_id, metric, round(value, 9) AS value, available FROM raw"),
    "sco4_composite": (composite, f"WITH {_S} SELECT repo_id, round(composite, 6) AS composite, tier FROM tiered"),
    "src19_settings": (by_settings, f"""
WITH {_S},
o AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS repo_id, s_acctbal > 4000 AS f, s_nationkey AS n FROM supplier),
own AS (SELECT repo_id, category, available,
  CASE WHEN n % 2 = 0 AND category = 'C1' THEN 0.05 WHEN n % 2 = 0 AND category = 'C6' THEN 0.5 WHEN f AND category = 'C1' THEN 0.4 ELSE category_weight END AS cw,
  CASE WHEN f AND metric = 'complexity_avg' THEN 0.5 WHEN f AND metric = 'file_size_avg' THEN 0.05 ELSE weight END AS w,
  CASE WHEN NOT available THEN 0.0
    WHEN f AND metric = 'complexity_avg' THEN CASE WHEN raw_value <= 5 THEN 10.0 WHEN raw_value <= 20 + n THEN 10 - 6 * (raw_value - 5) / (15 + n) WHEN raw_value <= 60 THEN 4 - 3 * (raw_value - 20 - n) / (40 - n) ELSE 1.0 END
    WHEN f AND metric = 'coverage_percent' THEN CASE WHEN raw_value <= 0 THEN 1.0 WHEN raw_value <= 100 THEN 1 + 9 * raw_value / 100 ELSE 10.0 END ELSE score END AS s
  FROM sub JOIN o USING (repo_id)),
k AS (SELECT repo_id, category, CAST(any_value(cw) AS DOUBLE) AS cw, sum(CAST(w AS DOUBLE) * s) FILTER (available) / sum(CAST(w AS DOUBLE)) FILTER (available) AS s FROM own GROUP BY 1, 2),
c2 AS (SELECT repo_id, coalesce(sum(cw * s) FILTER (s IS NOT NULL) / sum(cw) FILTER (s IS NOT NULL), 0.0) AS composite FROM k GROUP BY 1)
SELECT repo_id, round(composite, 6) AS composite, CASE {" ".join(f"WHEN composite >= {s} THEN '{n}'" for n, s in TIERS)} END AS tier FROM c2"""),
    "src18_bad_settings": (bad_settings, "SELECT 's' || CAST(s_suppkey AS VARCHAR) AS repo_id, 'project' AS layer, CASE s_nationkey WHEN 3 THEN 'negative number' ELSE 'no JSON' END AS error FROM supplier WHERE s_nationkey IN (3, 5)"),
    "sco11_overlaid": (overlaid, f"WITH {_scored_sql(ScoringConfig().with_weights({'C1': 0.05, 'C6': 0.5}))} SELECT repo_id, round(composite, 6) AS composite, tier FROM tiered"),
    "top12_categories": (categories, f"WITH {_S} SELECT repo_id, category, weight, round(score, 6) AS score, row_number() OVER (PARTITION BY repo_id ORDER BY category) AS place FROM cat"),
    "snk15_gate": (gated, f"WITH {_S} SELECT repo_id, round(composite, 6) AS composite, tier FROM tiered WHERE composite < 6"),
    "sco9_targets": (targets, f"WITH {_S} SELECT repo_id, metric, round(score, 6) AS score, {_TV} AS target_value, {_TS} AS target_score FROM sub"),
    "snk8_traces": (traces, f"""
WITH {_S}, i AS (SELECT *, unnest(range(1, len(bv) + 1)) AS i FROM sub)
SELECT repo_id, metric, CAST(i - 1 AS INT) AS row, CASE WHEN i = 1 THEN '<= ' || {_NUM.format("bv[i]")} WHEN i = len(bv) THEN '>= ' || {_NUM.format("bv[i]")} ELSE {_NUM.format("bv[i - 1]")} || ' - ' || {_NUM.format("bv[i]")} END AS range, bs[i] AS score, i = {_BAND} AS current FROM i"""),
    "snk5_lights": (lights, f"WITH {_S} SELECT repo_id, metric, CASE WHEN available THEN {_LIGHTS} ELSE 'grey' END AS light FROM sub"),
    "snk10_prompts": (texts, f"""
WITH {_S}, n AS (SELECT * REPLACE (round(score, 6) AS score) FROM sub WHERE available), p AS (SELECT *, {_TV} AS tv, {_TS} AS ts FROM n WHERE score < 9)
SELECT repo_id, metric, '## Context' || chr(10) || 'The ' || replace(metric, '_', ' ') || ' of ' || repo_id || ' is ' || {_NUM.format("floor(raw_value * 100.0::DOUBLE + 0.5) / 100")} || ' (score ' || printf('%.1f', floor(score * 10 + 0.5) / 10) || ' of 10).' || chr(10) || chr(10)
|| '## Build and test' || chr(10) || {_COMMANDS.format("go build ./...' || chr(10) || 'go test ./...", "python -m pytest", "npm test", "# commands of your project")} || chr(10) || chr(10)
|| '## Task' || chr(10) || 'Bring it to ' || {_NUM.format("tv")} || ' (score ' || printf('%.1f', ts) || ').' || chr(10) || chr(10) || '## Verification' || chr(10) || {_COMMANDS.format("go test ./...", "python -m pytest", "npm test", "# your tests")} AS prompt FROM p"""),
    "snk13_names": (named, f"WITH {_S} SELECT metric, {_TITLE} AS title, {_CATEGORY} AS category_name, CASE WHEN weight * category_weight >= 0.04 THEN 'high' WHEN weight * category_weight >= 0.02 THEN 'medium' ELSE 'low' END AS impact, count(*) AS repositories FROM sub WHERE weight <> 0 GROUP BY ALL"),
    "sco10_advice": (advised, f"WITH {_S}, {_RANKED} SELECT repo_id, rank, metric, CASE metric WHEN 'churn_rate' THEN 'Split large changes' ELSE 'Move ' || metric || ' from ' || printf('%.1f', floor(raw_value * 10 + 0.5) / 10) || ' to ' || printf('%.1f', best.v) END AS action FROM k WHERE rank <= 5"),
    "snk1_json_reports": (json_reports, f"WITH {_S}, {_RANKED}, n AS (SELECT repo_id, count(*) AS recommendations FROM k WHERE rank <= 5 GROUP BY 1) SELECT repo_id, '3' AS version, round(composite, 6) AS composite, tier, 7::BIGINT AS categories, coalesce(recommendations, 0) AS recommendations FROM tiered LEFT JOIN n USING (repo_id)"),
    "snk6_html_reports": (html, f"WITH {_S} SELECT repo_id, count(*) AS rows, count(*) FILTER (NOT available) AS unavailable, repo_id AS heading FROM sub WHERE weight <> 0 GROUP BY 1"),
    "snk11_bullets": (bullets, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '- ' || lang || ' first' || chr(10) || '- ' || source || chr(10) END AS bullets FROM documents"),
    "f17_cycle_texts": (cycle_texts, f"WITH e AS ({EDGES_SQL}) SELECT a.repo_id, a.src || ' -> ' || a.dst || ' -> ' || a.src AS cycle FROM e a JOIN e b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"),
    "gr2_components": (components, f"WITH RECURSIVE {_REACH} SELECT repo_id, node, component FROM m"),
    "top5_cycles": (cycle_evidence, f"WITH RECURSIVE {_REACH}, s AS (SELECT repo_id, component, count(*) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY component) AS rank FROM m GROUP BY 1, 2) SELECT repo_id, 'circular_deps' AS metric, rank, component AS file, n::DOUBLE AS value, n || ' nodes on cycles' AS description FROM s WHERE rank <= 5"),
    "top8_history_evidence": (history, f"""
WITH f AS (SELECT repo_id, path, sum(added + deleted) AS t, count(DISTINCT hash) AS c, count(DISTINCT author) AS a FROM ({CHANGES_SQL}) GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY t DESC, path) AS k FROM f QUALIFY k <= 10), u AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY a DESC, k) AS q FROM h),
d AS (SELECT DISTINCT repo_id, hash, path FROM ({BRANDS_SQL})), z AS (SELECT * FROM d WHERE (repo_id, hash) IN (SELECT repo_id, hash FROM d GROUP BY 1, 2 HAVING count(*) <= 50)),
n AS (SELECT repo_id, path, count(*) AS c FROM z GROUP BY 1, 2 HAVING count(*) >= 5), p AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS s FROM z x JOIN z y ON x.repo_id = y.repo_id AND x.hash = y.hash AND x.path < y.path GROUP BY 1, 2, 3),
g AS (SELECT p.*, 100.0 * s / least(m.c, o.c) AS g FROM p JOIN n m ON m.repo_id = p.repo_id AND m.path = p.a JOIN n o ON o.repo_id = p.repo_id AND o.path = p.b),
v AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY g DESC, a, b) AS rank FROM g QUALIFY rank <= 5)
SELECT repo_id, 'churn_rate' AS metric, k AS rank, path AS file, c::DOUBLE AS value, c || ' commits' AS description FROM h WHERE k <= 5
UNION ALL SELECT repo_id, 'hotspot_concentration', k, path, t::DOUBLE, 'hotspot: ' || CAST(t AS BIGINT) || ' changes' FROM h WHERE k <= 5
UNION ALL SELECT repo_id, 'author_fragmentation', q, path, a::DOUBLE, a || ' distinct authors' FROM u WHERE q <= 5
UNION ALL SELECT repo_id, 'temporal_coupling_pct', rank, a, round(g, 6), 'coupled with ' || b FROM v"""),
}
