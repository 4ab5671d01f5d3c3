"""Text, clone, classification and evaluation queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import agent_eval, classify, clones, summary
from gaugeworks.plans.adapters import table
from gaugeworks.plans.agents import rubric_sql
from gaugeworks.plans.facts import facts, plain


def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", scalars.line_count(t).alias("lines"), scalars.line_count_open(t).alias("open_lines"), scalars.word_count(t).alias("words"), scalars.token_estimate(t).alias("token_estimate"))


def shortened(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scalars.shorten(F.col("text"), 40).alias("head"), scalars.fence_count(F.col("text")).alias("fences"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of their language's repository."""
    return table(spark, sf, "documents").select(F.col("lang").alias("repo_id"), F.col("doc_id").alias("file"), "text")


def duplication(spark: SparkSession, sf: str) -> DataFrame:
    """Lines inside duplicated windows. Every line of a longer clone lies in a duplicated window of the least
    length, so windows of that length alone find all of them."""
    totals = _texts(spark, sf).groupBy("repo_id").agg(F.sum(scalars.line_count_open(F.col("text"))).alias("lines"))
    got = clones.duplication_rate(clones.line_windows(_texts(spark, sf), 3), totals)
    return got.select("repo_id", "lines", "duplicated_lines", F.round("duplication_rate", 6).alias("duplication_rate"))


#: Characters of texts whose sentences a task is meant to hold.
CHARS_A_TASK = 8 << 20


def _sentences(spark: SparkSession, sf: str, parts: int) -> DataFrame:
    """Sentences as statements, on lines of 80 characters: some share a line, others take several."""
    value = _texts(spark, sf).select("repo_id", "file", F.posexplode(F.split("text", r"\. ")).alias("pos", "value"))
    # Names and lengths go to the window, not the sentences.
    parts = value.select("repo_id", "file", "pos", F.unhex(F.md5("value")).alias("hash"), F.length("value").alias("n")).repartition(parts, "repo_id", "file")
    upto = F.sum(F.col("n") + 2).over(Window.partitionBy("repo_id", "file").orderBy("pos"))
    placed = parts.withColumn("from", upto - F.col("n") - 2)
    start, end = F.expr("`from` div 80 + 1").cast("int"), F.expr("(`from` + greatest(n, 1) - 1) div 80 + 1").cast("int")
    return placed.select("repo_id", "file", F.lit(0).alias("block"), "pos", "hash", start.alias("start"), end.alias("end"))


def _sentence_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of 80 characters of each repository; an empty last sentence begins a line after a full one."""
    empty = (F.col("text") == "") | F.col("text").endswith(". ")
    end = F.when(empty, F.expr("length(text) div 80")).otherwise(F.expr("(length(text) - 1) div 80")) + 1
    return _texts(spark, sf).where("text is not null").groupBy("repo_id").agg(F.sum(end).alias("lines"))


def statement_duplication(spark: SparkSession, sf: str) -> DataFrame:
    """Lines inside duplicated runs of three statements and six lines at least, of any length."""
    parts = 1 + (_texts(spark, sf).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHARS_A_TASK
    statements = _sentences(spark, sf, parts)
    totals = _sentence_lines(spark, sf)
    # Sentences lie where their file is, which is a block, so they don't move again.
    got = clones.duplication_rate(clones.deciding_windows(statements, parts=parts), totals)
    return got.select("repo_id", "lines", "duplicated_lines", F.round("duplication_rate", 6).alias("duplication_rate"))


def clone_partners(spark: SparkSession, sf: str) -> DataFrame:
    got = clones.partners(clones.line_windows(_texts(spark, sf), 3))
    return got.select("repo_id", "file", "start", "partner_file", "partner_start", "partner_end")


def clone_classes(spark: SparkSession, sf: str) -> DataFrame:
    return clones.clone_classes(clones.line_windows(_texts(spark, sf), 3)).drop("hash")


def longest_clones(spark: SparkSession, sf: str) -> DataFrame:
    return clones.longest_windows(_texts(spark, sf))


def maximal_clones(spark: SparkSession, sf: str) -> DataFrame:
    return clones.line_clones(_texts(spark, sf))


def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with subtotals of page kinds by host family: the first rule that applies wins."""
    url = F.col("url")
    host = F.regexp_extract(url, r"^[a-z]+://([^/]*)", 1)
    kind = F.when(url.contains("utm_"), "tracked").when(url.contains("?"), "query").when(url.endswith(".html"), "file").when(url.endswith("/"), "folder").otherwise("plain")
    rows = table(spark, sf, "pages").select(F.substring_index(host, ".", -1).alias("zone"), kind.alias("kind"))
    return rows.rollup("zone", "kind").agg(F.count("*").alias("pages"))


def name_words(spark: SparkSession, sf: str) -> DataFrame:
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", scalars.identifier_words(snake).alias("snake_words"), scalars.identifier_words(camel).alias("camel_words"), scalars.badge_text(F.concat(snake, F.lit("-"), camel)).alias("badge_text"))


def scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files by repository, language and class with subtotals, over document names made from their rows."""
    d = table(spark, sf, "documents")
    end = F.element_at(F.create_map(*[F.lit(x) for x in ("en", ".go", "de", ".py", "fr", ".ts", "es", ".md")]), F.col("lang"))
    stem = F.when(F.col("doc_id") % 5 == 0, "test_a").when(F.col("doc_id") % 7 == 0, "_hidden").otherwise("a")
    folder = F.when(F.col("doc_id") % 11 == 0, "x/vendor/").otherwise("x/")
    files = d.select(F.col("source").alias("repo_id"), F.concat(folder, stem, end).alias("rel_path"), F.lit("").alias("content"))
    return classify.scan_counters(classify.classify(files, ignored=F.col("rel_path").startswith("x/test_a.t")))


def response_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns judged by the rubric for comprehension."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", agent_eval.response_score(F.coalesce("text", F.lit("")), agent_eval.COMPREHENSION).alias("score"))


def consistency(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "conversations").select("conv_id", (F.length("text") % 11).cast("double").alias("score"))
    got = agent_eval.consistency_score(runs, ["conv_id"])
    return got.select("conv_id", "runs", F.round("variance", 6).alias("variance"), "consistency")


def metric_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select("role", agent_eval.response_score(F.coalesce("text", F.lit("")), agent_eval.NAVIGATION).alias("score"), F.when(F.col("turn") % 3 == 2, "timeout").alias("error"), (F.col("conv_id") % 10).alias("shard"))
    return agent_eval.metric_scores(rows, ["role", "shard"])


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as calls and assistant turns as captured responses, matched by their place."""
    c = table(spark, sf, "conversations")
    metric = F.col("conv_id").cast("string").alias("metric_id")
    calls = c.where("role = 'user'").select(metric, F.col("turn").alias("call_order"))
    captured = c.where("role = 'assistant'").select(metric, F.expr("cast(row_number() over (partition by conv_id order by turn) - 1 as int)").alias("sample_index"), F.col("text").alias("response"), F.lit(None).cast("string").alias("error"))
    got = agent_eval.replay(calls, captured)
    return got.select("metric_id", "sample_index", "call_order", F.length("response").alias("response_chars"), "error")


_PROMPTS = """
SELECT conv_id % 50 AS run, conv_id * 1000 + turn AS call_order, coalesce(text, '') || CASE (conv_id * 7 + turn) % 9
  WHEN 0 THEN ' List all function names.' WHEN 1 THEN ' LIST ALL EXPORTED FUNCTIONS' WHEN 2 THEN ' explain what the code does and trace the dependencies' WHEN 3 THEN ' Trace its dependencies'
  WHEN 4 THEN ' trace the complete dependency chain' WHEN 5 THEN ' Interpret what each identifier means' WHEN 6 THEN ' identify any inaccuracies' WHEN 7 THEN ' documentation accuracy; list all function names' ELSE ' nothing' END AS prompt
FROM {conversations} WHERE role = 'user'"""
_CAPTURED = """
SELECT conv_id % 50 AS run, CASE turn % 4 WHEN 0 THEN 'task_execution_consistency' WHEN 1 THEN 'code_behavior_comprehension' WHEN 2 THEN 'cross_file_navigation' ELSE 'unknown' END AS metric_id, conv_id * 1000 + turn AS place, text AS response, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'timeout' END AS error
FROM {conversations} WHERE role = 'assistant'"""


def prompt_replay(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as prompts of fifty runs, replayed by the metric that their text asks for."""
    calls = facts(spark, sf, _PROMPTS).withColumn("metric_id", agent_eval.metric_of_prompt(F.col("prompt")))
    order = Window.partitionBy("run", "metric_id").orderBy("place")
    captured = facts(spark, sf, _CAPTURED).withColumn("sample_index", (F.row_number().over(order) - 1).cast("int"))
    got = agent_eval.replay(calls, captured, ("run",))
    return got.select("run", "call_order", "metric_id", "sample_index", F.length("response").alias("response_chars"), "error")


def quality_means(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", F.col("n_chars").alias("loc"), (F.col("quality") * 100.0).alias("quality"), (F.col("toxic") * 100.0).alias("toxic"))
    got = summary.weighted_mean(joined, ["lang"], ["quality", "toxic"], "loc")
    return got.select("lang", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


def test_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("repo_id"), (F.col("doc_id") % 4 == 0).alias("is_test"), scalars.line_count(F.coalesce("text", F.lit(""))).alias("lines"))
    got = summary.test_ratio(d)
    return got.select("repo_id", "test_files", "source_files", "test_lines", "source_lines", F.round("test_to_code_ratio", 6).alias("test_to_code_ratio"), F.round("test_file_ratio", 6).alias("test_file_ratio"))


def blended(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio of each language, averaged pairwise in the fixed order; a running 0 counts as unset."""
    lang = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "go", "de", "python", "fr", "typescript", "es", "other")]), F.col("lang"))
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("repo_id"), lang.alias("language")).agg((F.count_if(F.col("doc_id") % 3 == 0) * 100.0 / F.count("*")).alias("isolation"))
    return summary.blend(rows, "isolation", unset=0.0).select("repo_id", F.round("isolation", 6).alias("isolation"))


_WINDOWS_SQL = """
l AS (SELECT lang AS repo_id, doc_id AS file, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
w AS (SELECT repo_id, file, pos AS s, pos + 2 AS e, md5(value) || '|' || md5(lead(value, 1) OVER o) || '|' || md5(lead(value, 2) OVER o) AS h FROM l WINDOW o AS (PARTITION BY file ORDER BY pos))
"""
QUERIES = {
    "f1_text_counts": (text_counts, """
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines,
length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS open_lines,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words,
CAST(strlen(coalesce(text, '')) // 4 AS INT) AS token_estimate FROM documents"""),
    "f16_shorten": (shortened, """
SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS head,
len(regexp_extract_all(text, '(?m)^```')) AS fences FROM documents"""),
    "agg4_duplication": (duplication, f"""
WITH {_WINDOWS_SQL},
k AS (SELECT * FROM w WHERE h IS NOT NULL),
d AS (SELECT DISTINCT a.repo_id, a.file, a.s, a.e FROM k a JOIN (SELECT repo_id, h, count(DISTINCT file) AS files FROM k GROUP BY 1, 2) f USING (repo_id, h)
  JOIN (SELECT repo_id, h, file, min(e) AS me, max(s) AS ms FROM k GROUP BY 1, 2, 3) m USING (repo_id, h, file) WHERE files > 1 OR me <= a.s OR ms >= a.e),
x AS (SELECT DISTINCT repo_id, file, unnest(range(s, e + 1)) AS line FROM d),
t AS (SELECT lang AS repo_id, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS lines FROM documents GROUP BY 1)
SELECT repo_id, CAST(lines AS BIGINT) AS lines, coalesce(n, 0) AS duplicated_lines, round(100.0 * coalesce(n, 0) / lines, 6) AS duplication_rate FROM t LEFT JOIN (SELECT repo_id, count(*) AS n FROM x GROUP BY 1) USING (repo_id)"""),
    "win3_statement_windows": (statement_duplication, """
WITH q AS (SELECT lang AS repo_id, doc_id AS file, unnest(string_split(text, '. ')) AS value, unnest(range(0, len(string_split(text, '. ')))) AS pos FROM documents),
o AS (SELECT *, sum(length(value) + 2) OVER (PARTITION BY file ORDER BY pos) - length(value) - 2 AS f FROM q),
s AS (SELECT repo_id, file, pos, value, CAST(f // 80 + 1 AS INT) AS st, CAST((f + greatest(length(value), 1) - 1) // 80 + 1 AS INT) AS en FROM o),
p AS (SELECT a.repo_id, a.file AS fa, b.file AS fb, a.pos AS i, b.pos - a.pos AS shift FROM s a JOIN s b ON a.repo_id = b.repo_id AND a.value = b.value AND (a.file < b.file OR (a.file = b.file AND a.pos < b.pos))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY repo_id, fa, fb, shift ORDER BY i) AS island FROM p),
r AS (SELECT repo_id, fa, fb, shift, min(i) AS i, count(*) AS n FROM g GROUP BY repo_id, fa, fb, shift, island HAVING count(*) >= 3),
x AS (SELECT *, fa = fb AND i + n > i + shift AS meet FROM r),
w AS (
  SELECT repo_id, fa, fb, shift, i, n FROM x WHERE NOT meet
  UNION ALL SELECT repo_id, fa, fb, shift, i + k, m FROM (SELECT *, unnest(range(0, n - 2)) AS k FROM x WHERE meet) y, LATERAL (SELECT unnest(range(3, n - k + 1)) AS m)),
v AS (
  SELECT w.repo_id, fa, fb, a0.st AS sa, a1.en AS ea, b0.st AS sb, b1.en AS eb FROM w
  JOIN s a0 ON a0.file = fa AND a0.pos = i JOIN s a1 ON a1.file = fa AND a1.pos = i + n - 1
  JOIN s b0 ON b0.file = fb AND b0.pos = i + shift JOIN s b1 ON b1.file = fb AND b1.pos = i + shift + n - 1),
z AS (SELECT * FROM v WHERE ea - sa >= 5 AND eb - sb >= 5 AND NOT (fa = fb AND sa < eb AND sb < ea)),
l AS (SELECT DISTINCT * FROM (SELECT repo_id, fa AS file, unnest(range(sa, ea + 1)) AS line FROM z UNION ALL SELECT repo_id, fb, unnest(range(sb, eb + 1)) FROM z)),
t AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT repo_id, file, max(en) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT repo_id, lines, coalesce(n, 0) AS duplicated_lines, round(100.0 * coalesce(n, 0) / lines, 6) AS duplication_rate FROM t LEFT JOIN (SELECT repo_id, count(*) AS n FROM l GROUP BY 1) USING (repo_id)"""),
    "jn3_partners": (clone_partners, f"""
WITH {_WINDOWS_SQL},
k AS (SELECT * FROM w WHERE h IS NOT NULL),
d AS (SELECT a.* FROM k a WHERE EXISTS (SELECT 1 FROM k b WHERE b.repo_id = a.repo_id AND b.h = a.h AND (b.file <> a.file OR b.e <= a.s OR b.s >= a.e))),
c AS (SELECT a.repo_id, a.file, a.s, b.file AS bf, b.s AS bs, b.e AS be, row_number() OVER (PARTITION BY a.repo_id, a.h, a.file, a.s ORDER BY b.file, b.s) AS of_class
  FROM d a JOIN d b USING (repo_id, h)),
f AS (SELECT c.*, min(bf) OVER o AS f0, first_value(bs) OVER (o ORDER BY bf, bs) AS s0 FROM c WINDOW o AS (PARTITION BY repo_id, file, s)),
n AS (SELECT *, CASE WHEN bf = f0 AND bs = s0 THEN 0 WHEN bf = file AND bs >= s + 2 THEN 1 ELSE 2 END AS kind FROM f WHERE bf <> file OR be <= s OR bs >= s + 2)
SELECT repo_id, file, s AS start, bf AS partner_file, bs AS partner_start, be AS partner_end FROM n
QUALIFY row_number() OVER (PARTITION BY repo_id, file, s ORDER BY kind, bf, bs) = 1"""),
    "jn3_classes": (clone_classes, f"""
WITH {_WINDOWS_SQL},
k AS (SELECT * FROM w WHERE h IS NOT NULL),
d AS (SELECT a.* FROM k a WHERE EXISTS (SELECT 1 FROM k b WHERE b.repo_id = a.repo_id AND b.h = a.h AND (b.file <> a.file OR b.e <= a.s OR b.s >= a.e)))
SELECT repo_id, count(*) AS copies, count(DISTINCT file) AS files, min(file) AS first_file, arg_min(s, (file, s)) AS first_start, arg_min(e, (file, s)) AS first_end FROM d GROUP BY repo_id, h"""),
    "top4_clone_pairs": (longest_clones, f"""
WITH {_WINDOWS_SQL},
k AS (SELECT * FROM w WHERE h IS NOT NULL),
p AS (SELECT a.repo_id, a.file AS file_a, b.file AS file_b, a.s, b.s - a.s AS shift FROM k a JOIN k b ON a.repo_id = b.repo_id AND a.h = b.h AND (a.file < b.file OR (a.file = b.file AND b.s >= a.e))),
i AS (SELECT *, s - row_number() OVER (PARTITION BY repo_id, file_a, file_b, shift ORDER BY s) AS island FROM p),
r AS (SELECT repo_id, file_a, file_b, shift, min(s) AS s, count(*) + 2 AS n FROM i GROUP BY repo_id, file_a, file_b, shift, island),
x AS (SELECT *, unnest(range(3, n + 1)) AS line_count FROM r),
y AS (SELECT *, s + unnest(range(0, n - line_count + 1)) AS start_a FROM x WHERE file_a <> file_b OR line_count <= shift + 1)
SELECT repo_id, file_a, start_a, start_a + line_count - 1 AS end_a, file_b, start_a + shift AS start_b, start_a + shift + line_count - 1 AS end_b, line_count,
  row_number() OVER (PARTITION BY repo_id ORDER BY line_count DESC, file_a, start_a, file_b, start_a + shift) AS rank FROM y QUALIFY rank <= 5"""),
    "top4_maximal_clones": (maximal_clones, f"""
WITH {_WINDOWS_SQL},
k AS (SELECT * FROM w WHERE h IS NOT NULL),
p AS (SELECT a.repo_id, a.file AS file_a, b.file AS file_b, a.s, b.s - a.s AS shift FROM k a JOIN k b ON a.repo_id = b.repo_id AND a.h = b.h AND (a.file < b.file OR (a.file = b.file AND b.s >= a.e))),
i AS (SELECT *, s - row_number() OVER (PARTITION BY repo_id, file_a, file_b, shift ORDER BY s) AS island FROM p),
r AS (SELECT repo_id, file_a, file_b, shift, min(s) AS start_a, CASE WHEN file_a = file_b THEN least(count(*) + 2, shift + 1) ELSE count(*) + 2 END AS n FROM i GROUP BY repo_id, file_a, file_b, shift, island),
c AS (SELECT repo_id, file_a, start_a, start_a + n - 1 AS end_a, file_b, start_a + shift AS start_b, start_a + shift + n - 1 AS end_b, n AS line_count FROM r)
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY line_count DESC, file_a, start_a, file_b, start_b) AS rank FROM c QUALIFY rank <= 5"""),
    "flt1_page_classes": (page_classes, """
WITH r AS (SELECT split_part(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.', -1) AS zone,
CASE WHEN contains(url, 'utm_') THEN 'tracked' WHEN contains(url, '?') THEN 'query' WHEN ends_with(url, '.html') THEN 'file' WHEN ends_with(url, '/') THEN 'folder' ELSE 'plain' END AS kind FROM pages)
SELECT zone, kind, count(*) AS pages FROM r GROUP BY ROLLUP (zone, kind)"""),
    "f8_identifier_words": (name_words, """
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') AS snake, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS camel FROM part)
SELECT p_partkey, CASE WHEN contains(snake, '_') THEN len(list_filter(string_split(snake, '_'), lambda x: x <> '')) ELSE len(regexp_extract_all(snake[2:], '[A-Z]')) + 1 END AS snake_words,
len(regexp_extract_all(camel[2:], '[A-Z]')) + 1 AS camel_words, replace(snake, '_', '__') || '--' || camel AS badge_text FROM n"""),
    "agg24_scan_counters": (scan_counts, """
WITH f AS (SELECT source AS repo_id, CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'python' WHEN 'fr' THEN 'typescript' END AS language,
  CASE WHEN doc_id % 5 = 0 THEN 'test_a' WHEN doc_id % 7 = 0 THEN '_hidden' ELSE 'a' END AS stem, doc_id % 11 = 0 AS vendored FROM documents WHERE lang <> 'es'),
c AS (SELECT repo_id, language, CASE WHEN vendored OR (stem = 'test_a' AND language = 'typescript') THEN 'excluded'
  WHEN language IN ('go', 'python') AND stem = '_hidden' THEN 'excluded' WHEN language = 'python' AND stem = 'test_a' THEN 'test' ELSE 'source' END AS class FROM f)
SELECT repo_id, language, class, count(*) AS files FROM c GROUP BY ROLLUP (repo_id, language, class)"""),
    "c7_response_scores": (response_scores, f"SELECT conv_id, turn, {rubric_sql('code_behavior_comprehension', 'lower(coalesce(text, chr(32)))')} AS score FROM conversations WHERE role = 'assistant'"),
    "agg26_consistency": (consistency, """
WITH s AS (SELECT conv_id, count(*) AS runs, count(text) AS n, sum(length(text) % 11) AS total, sum((length(text) % 11) * (length(text) % 11)) AS squares FROM conversations GROUP BY 1),
v AS (SELECT conv_id, runs, (n * squares - total * total) / nullif(n * n, 0) AS x FROM s)
SELECT conv_id, runs, round(x, 6) AS variance, CASE WHEN x < 5 THEN 10 WHEN x < 15 THEN 7 WHEN x < 30 THEN 4 ELSE 1 END AS consistency FROM v"""),
    "jn14_replay": (replayed, """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS metric_id, turn AS call_order, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS sample_index FROM conversations WHERE role = 'user'),
r AS (SELECT CAST(conv_id AS VARCHAR) AS metric_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS sample_index, text FROM conversations WHERE role = 'assistant')
SELECT metric_id, sample_index, call_order, CAST(length(text) AS INT) AS response_chars, CASE WHEN text IS NULL THEN 'no captured response' END AS error FROM c LEFT JOIN r USING (metric_id, sample_index)"""),
    "jn14_prompt_replay": (prompt_replay, f"""
WITH c AS (SELECT *, CASE
    WHEN regexp_matches(prompt, '(?i)list all (function names|exported function)') THEN 'task_execution_consistency'
    WHEN regexp_matches(prompt, '(?i)explain what the code does') THEN 'code_behavior_comprehension'
    WHEN regexp_matches(prompt, '(?i)trace (the dependencies|the complete dependency chain|its dependencies)') THEN 'cross_file_navigation'
    WHEN regexp_matches(prompt, '(?i)interpret what (the|each) identifier') THEN 'identifier_interpretability'
    WHEN regexp_matches(prompt, '(?i)review the documentation|identify any inaccuracies|documentation accuracy') THEN 'documentation_accuracy_detection' ELSE 'unknown' END AS metric_id FROM ({plain(_PROMPTS)})),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, metric_id ORDER BY call_order) - 1 AS INT) AS sample_index FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, metric_id ORDER BY place) - 1 AS INT) AS sample_index FROM ({plain(_CAPTURED)}))
SELECT n.run, call_order, n.metric_id, n.sample_index, CAST(length(response) AS INT) AS response_chars, CASE WHEN response IS NULL AND error IS NULL THEN 'no captured response' ELSE error END AS error
FROM n LEFT JOIN r ON n.run = r.run AND n.metric_id = r.metric_id AND n.sample_index = r.sample_index"""),
    "agg10_weighted_means": (quality_means, """
SELECT lang, round(sum(quality * 100.0 * n_chars) / sum(n_chars), 6) AS quality, round(sum(toxic * 100.0 * n_chars) / sum(n_chars), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1"""),
    "agg19_test_ratio": (test_ratio, """
WITH f AS (SELECT source AS repo_id, doc_id % 4 = 0 AS t, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n FROM documents),
g AS (SELECT repo_id, count(*) FILTER (t) AS test_files, count(*) FILTER (NOT t) AS source_files, CAST(sum(CASE WHEN t THEN n ELSE 0 END) AS BIGINT) AS test_lines, CAST(sum(CASE WHEN NOT t THEN n ELSE 0 END) AS BIGINT) AS source_lines FROM f GROUP BY 1)
SELECT *, round(coalesce(test_lines / nullif(source_lines, 0), 0.0), 6) AS test_to_code_ratio, round(coalesce(test_files / nullif(source_files, 0), 0.0), 6) AS test_file_ratio FROM g"""),
    "agg20_blended_isolation": (blended, """
WITH r AS (SELECT source AS repo_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 99 END AS k, 100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*) AS v FROM documents GROUP BY 1, 2),
l AS (SELECT repo_id, list(v ORDER BY k) AS vs FROM r GROUP BY 1)
SELECT repo_id, round(list_reduce(vs, lambda a, b: CASE WHEN a = 0 THEN b ELSE (a + b) / 2 END), 6) AS isolation FROM l"""),
    "agg25_metric_scores": (metric_scores, f"""
WITH s AS (SELECT role, conv_id % 10 AS shard, turn % 3 = 2 AS bad, {rubric_sql('cross_file_navigation', "lower(coalesce(text, ''))")} AS v FROM conversations)
SELECT role, shard, CAST(coalesce(sum(v) FILTER (NOT bad) // nullif(count(*) FILTER (NOT bad), 0), 0) AS INT) AS metric_score, count(*) FILTER (NOT bad) AS successes, count(*) AS samples FROM s GROUP BY 1, 2"""),
}
