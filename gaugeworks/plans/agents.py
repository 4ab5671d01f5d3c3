"""Queries on agent evaluation: rubrics over captured responses, sample selection, costs, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import agent_eval
from gaugeworks.plans.facts import FILES, REPLIES, RESPONSES, facts, plain, words_sql
from gaugeworks.report import prompts


def scores(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    return facts(spark, sf, RESPONSES).select("conv_id", "turn", agent_eval.response_score(F.col("response"), agent_eval.RUBRICS[metric]).alias("score"))


def checklist(spark: SparkSession, sf: str) -> DataFrame:
    """How often each indicator of the rubric for identifiers is matched, and what it adds."""
    hits = facts(spark, sf, RESPONSES).select(F.explode(agent_eval.matches(F.col("response"), agent_eval.IDENTIFIERS)).alias("m"))
    return hits.groupBy(F.col("m.name").alias("name")).agg(F.count_if("m.matched").alias("matched"), F.sum("m.delta").alias("delta"))


def overall(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted mean of a conversation's scores by the four rubrics; scores below 3 count as none."""
    weight = {"code_behavior_comprehension": 0.25, "cross_file_navigation": 0.25, "identifier_interpretability": 0.15, "documentation_accuracy_detection": 0.15}
    rows = facts(spark, sf, RESPONSES)
    each = F.array(*[F.struct(agent_eval.response_score(F.col("response"), agent_eval.RUBRICS[m]).alias("score"), F.lit(w).alias("weight")) for m, w in weight.items()])
    long = rows.select("conv_id", F.explode(each).alias("m")).select("conv_id", F.when(F.col("m.score") < 3, 0).otherwise(F.col("m.score")).alias("score"), "m.weight")
    return agent_eval.overall_score(long, ["conv_id"]).withColumn("overall", F.round("overall", 6))


def array_scores(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[\"' || event_type || '\"]' WHEN 1 THEN 'see [' || event_type WHEN 2 THEN '' WHEN 3 THEN '  ' ELSE event_type END AS response FROM {events}"
    return facts(spark, sf, text).select("event_id", agent_eval.array_score(F.col("response")).cast("int").alias("score"))


def samples(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    pick = {"size": agent_eval.size_samples, "complexity": agent_eval.complexity_samples, "imports": agent_eval.import_samples, "comments": agent_eval.comment_samples}[kind]
    return pick(facts(spark, sf, FILES)).withColumn("selection_score", F.round("selection_score", 6))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return agent_eval.name_samples(facts(spark, sf, FILES))


def name_lines(spark: SparkSession, sf: str) -> DataFrame:
    got = agent_eval.public_names(facts(spark, sf, FILES))
    return got.groupBy("repo_id", "file_path", "name").agg(F.min("line").alias("first_line"), F.count("*").alias("places"))


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, FILES).select("file_path", agent_eval.control_words(F.col("content")).cast("long").alias("keywords"), scalars.comment_estimate(F.col("content")).cast("long").alias("comments"))


def costs(spark: SparkSession, sf: str) -> DataFrame:
    """Captured judgements: events as judgements of their type, users as repositories."""
    text = "SELECT user_id AS repo_id, event_type AS kind, CAST(event_id % 10 + 1 AS INT) AS score, CAST(floor(value * 10) AS BIGINT) AS tokens FROM {events}"
    got = agent_eval.judgement_costs(facts(spark, sf, text))
    return got.select("repo_id", "kind", F.round("score", 6).alias("score"), "tokens", F.round("cost_usd", 9).alias("cost_usd"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, REPLIES).select("event_id", prompts.reply_score(F.col("reply")).alias("r")).select("event_id", "r.score", "r.reason", "r.error")


def small_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Literals without their quotes, packages of imports, pairs in order."""
    text = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN '''' || event_type || '"' WHEN 2 THEN '`' || event_type || '`' ELSE event_type END AS literal,
    CASE event_id % 3 WHEN 0 THEN '@x/' || event_type || '/y' WHEN 1 THEN event_type || '/a/b' ELSE event_type END AS spec, user_id % 7 AS a, event_id % 7 AS b FROM {events}"""
    low, high = scalars.pair_key(F.col("a"), F.col("b"))
    return facts(spark, sf, text).select("event_id", scalars.strip_quotes(F.col("literal")).alias("literal"), scalars.top_module(F.col("spec")).alias("package"), low.alias("low"), high.alias("high"))


def rubric_sql(metric: str, text: str = "lower(response)") -> str:
    """A rubric's score in DuckDB, over a lower-cased text."""
    r = agent_eval.RUBRICS[metric]
    out = str(r.base)
    for name, words in r.groups.items():
        out += f" + CASE WHEN {words_sql(text, words)} THEN {r.deltas.get(name, 1)} ELSE 0 END"
    for word in r.negatives:
        out += f" - CASE WHEN {words_sql(text, [word])} THEN 1 ELSE 0 END"
    if metric == "cross_file_navigation":
        out += f" + CASE WHEN length({text}) - length(replace({text}, '/', '')) > 6 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')) > 200 THEN 1 ELSE 0 END"
    if metric == "documentation_accuracy_detection":
        said = words_sql(text, ["all documentation appears accurate", "no mismatches found", "documentation is accurate"])
        out += f" + CASE WHEN {said} OR (contains({text}, 'mismatch') AND contains({text}, 'line')) THEN 1 ELSE 0 END"
    return f"CAST(least(10, greatest(1, {out})) AS INT)"


_R, _F = plain(RESPONSES), plain(FILES)
_WORDS = "len(regexp_extract_all(content, '\\b(if|for|switch|case|while|try|catch|else)\\b'))"
_NOTES = "(len(regexp_extract_all(content, '(?m)^[ \\t]*(//|#)')) + 3 * least(len(string_split(content, '/*')) - 1, len(string_split(content, '*/')) - 1))"
_FUNCS = "len(regexp_extract_all(content, '(?m)^func\\s+'))"
_IMPORTS = """CASE language WHEN 'go' THEN len(regexp_extract_all(content, '(?m)^\\s*(?:import\\s+|"[^"]+"\\s*$|\\t"[^"]+")')) WHEN 'python' THEN len(regexp_extract_all(content, '(?m)^(?:import|from)\\s+\\w+')) WHEN 'typescript' THEN len(regexp_extract_all(content, '(?m)^import\\s+.+from\\s+[''"]')) ELSE len(regexp_extract_all(content, '(?m)^(?:import|from|require|include)\\s+')) END"""
_PUBLIC = """
f AS (SELECT * FROM (%s) WHERE class = 'source'),
v AS (SELECT repo_id, file_path, language, unnest(string_split(content, chr(10))) AS v, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f),
n AS (SELECT repo_id, file_path, line, CASE language WHEN 'go' THEN coalesce(nullif(regexp_extract(v, '^func\\s+([A-Z][a-zA-Z0-9_]*)\\s*\\(', 1), ''), nullif(regexp_extract(v, '^type\\s+([A-Z][a-zA-Z0-9_]*)\\s+', 1), ''), nullif(regexp_extract(v, '^(?:var|const)\\s+([A-Z][a-zA-Z0-9_]*)', 1), ''))
  WHEN 'python' THEN nullif(regexp_extract(v, '^(?:def|class)\\s+([a-zA-Z][a-zA-Z0-9_]*)', 1), '') WHEN 'typescript' THEN nullif(regexp_extract(v, '^export\\s+(?:function|class|const|let|var|interface|type)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), '') END AS name FROM v),
p AS (SELECT * FROM n WHERE length(name) >= 4 AND NOT regexp_matches(lower(name), '^(test|example|mock)'))
""" % _F


def _pick(score: str, where: str, count: int) -> str:
    return f"WITH s AS (SELECT repo_id, file_path, round({score}, 6) AS selection_score, row_number() OVER (PARTITION BY repo_id ORDER BY {score} DESC, file_path) AS rank FROM ({_F}) WHERE class = 'source' AND {where}) SELECT * FROM s WHERE rank <= {count}"


_SIZE = f"(1 - abs(lines - 100) / 100.0 + 1 - abs({_FUNCS} - 5) / 5.0) / 2"
QUERIES = {
    **{f"c7_{i}_{m}": (lambda spark, sf, m=m: scores(spark, sf, m), f"SELECT conv_id, turn, {rubric_sql(m)} AS score FROM ({_R})") for i, m in ((3, "code_behavior_comprehension"), (4, "cross_file_navigation"), (5, "identifier_interpretability"), (6, "documentation_accuracy_detection"))},
    "f12_checklist": (checklist, "WITH r AS (SELECT lower(response) AS t FROM (" + _R + ")) " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({words_sql('t', w)}) AS matched, {agent_eval.IDENTIFIERS.deltas.get(n, 1)} * count(*) FILTER ({words_sql('t', w)}) AS delta FROM r" for n, w in agent_eval.IDENTIFIERS.groups.items())),
    "agg27_overall": (overall, f"""
WITH r AS (SELECT conv_id, unnest([{", ".join(rubric_sql(m) for m in agent_eval.RUBRICS)}]) AS v, unnest([0.25, 0.25, 0.15, 0.15]) AS w FROM ({_R}))
SELECT conv_id, round(coalesce(CAST(sum(w * v) FILTER (v >= 3) AS DOUBLE) / CAST(sum(w) FILTER (v >= 3) AS DOUBLE), 0.0), 6) AS overall FROM r GROUP BY 1"""),
    "c7_2_array_scores": (array_scores, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 4 THEN 4 ELSE 1 END AS score FROM events"),
    "c7_1_size_samples": (lambda spark, sf: samples(spark, sf, "size"), f"""
WITH f AS ({_F}), c AS (SELECT repo_id, file_path, {_SIZE} AS s FROM f WHERE class = 'source' AND lines BETWEEN 50 AND 200 AND {_FUNCS} BETWEEN 3 AND 10),
o AS (SELECT repo_id, file_path, lines::DOUBLE AS s FROM f WHERE class <> 'source' AND lines > 20 AND repo_id NOT IN (SELECT repo_id FROM c)),
r AS (SELECT repo_id, file_path, round(s, 6) AS selection_score, row_number() OVER (PARTITION BY repo_id ORDER BY s DESC, file_path) AS rank FROM (SELECT * FROM c UNION ALL SELECT * FROM o))
SELECT * FROM r WHERE rank = 1"""),
    "c7_3_samples": (lambda spark, sf: samples(spark, sf, "complexity"), _pick(f"{_WORDS} / sqrt(lines)", f"lines >= 30 AND {_WORDS} >= 5", 3)),
    "c7_4_samples": (lambda spark, sf: samples(spark, sf, "imports"), _pick(f"({_IMPORTS})::DOUBLE", f"{_IMPORTS} >= 3", 2)),
    "c7_5_samples": (names, f"""
WITH {_PUBLIC}, o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY file_path, line) = 1),
k AS (SELECT *, (length(name) * CASE WHEN contains(name, '_') THEN len(list_filter(string_split(name, '_'), lambda x: x <> '')) ELSE len(regexp_extract_all(substr(name, 2), '[A-Z]')) + 1 END)::DOUBLE AS selection_score FROM o)
SELECT repo_id, file_path, CAST(line AS INT) AS line, name, selection_score, row_number() OVER (PARTITION BY repo_id ORDER BY selection_score DESC, file_path, line, name) AS rank FROM k QUALIFY rank <= 5"""),
    "c7_6_samples": (lambda spark, sf: samples(spark, sf, "comments"), _pick(f"{_NOTES} / lines", f"lines >= 20 AND {_NOTES} / lines >= 0.05", 3)),
    "f14_public_names": (name_lines, f"WITH {_PUBLIC} SELECT repo_id, file_path, name, CAST(min(line) AS INT) AS first_line, count(*) AS places FROM p GROUP BY 1, 2, 3"),
    "f13_keyword_counts": (keyword_counts, f"SELECT file_path, {_WORDS} AS keywords, {_NOTES} AS comments FROM ({_F})"),
    "c7_10_judgement_costs": (costs, "WITH j AS (SELECT user_id AS repo_id, event_type AS kind, event_id % 10 + 1 AS score, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events) SELECT repo_id, kind, round(avg(score), 6) AS score, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) * 5.0 / 1e6, 9) AS cost_usd FROM j GROUP BY 1, 2"),
    "f18_replies": (replies, "SELECT event_id, CASE WHEN event_id % 7 > 1 AND event_id % 13 BETWEEN 1 AND 10 THEN CAST(event_id % 13 AS INT) END AS score, CASE WHEN event_id % 7 > 1 AND event_id % 13 BETWEEN 1 AND 10 THEN event_type END AS reason, CASE WHEN event_id % 7 = 0 THEN 'unreadable reply' WHEN event_id % 7 = 1 OR event_id % 13 NOT BETWEEN 1 AND 10 THEN 'score out of range' END AS error FROM events"),
    "f9_small_texts": (small_texts, "SELECT event_id, CASE event_id % 4 WHEN 1 THEN chr(39) || event_type || '\"' ELSE event_type END AS literal, CASE event_id % 3 WHEN 0 THEN '@x/' || event_type ELSE event_type END AS package, least(user_id % 7, event_id % 7) AS low, greatest(user_id % 7, event_id % 7) AS high FROM events"),
}
