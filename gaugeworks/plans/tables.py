"""Graph, summary, scoring and report queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.config import METRICS
from gaugeworks.functions.scalars import interpolate
from gaugeworks.operators import graph, scoring, summary
from gaugeworks.plans.adapters import EDGES_SQL, ORDER_EDGES_SQL, import_edges, order_edges, table
from gaugeworks.report import render
from gaugeworks.sources import coverage

_COMPLEXITY = next(m for m in METRICS if m.name == "complexity_avg")


def points(spark: SparkSession, sf: str) -> DataFrame:
    bp = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(s).alias("score")) for v, s in _COMPLEXITY.breakpoints])
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(interpolate(size, bp), 6).alias("score"), render.breakpoint_band(size, bp).alias("band"))


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round(F.greatest(F.lit(0.0), F.col("c_acctbal") / 1000.0), 2)
    return table(spark, sf, "customer").select("c_custkey", scoring.tier(score).alias("tier"), render.light(score, 8.0, 6.0, falling=False).alias("light"))


def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(import_edges(spark, sf))


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    return graph.fan_out(graph.degrees(import_edges(spark, sf)), only_with_edges=True).select("repo_id", F.round("fanout_avg", 6).alias("fanout_avg"), "fanout_max", "fanout_max_node")


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(import_edges(spark, sf))


def go_null_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a supplier as type references and pointer uses; suppliers of few large lines have no pointer uses."""
    line = table(spark, sf, "lineitem")
    sums = line.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("any_refs"), F.count_if(F.col("l_linestatus") == "O").alias("refs"), F.sum(F.when(F.col("l_quantity") > 49, F.col("l_linenumber"))).alias("pointers"), F.count_if(F.col("l_discount") > 0.05).alias("checked"))
    # Of what is no reference, nothing is the any-type.
    any_refs, pointers = F.least("any_refs", "refs"), F.coalesce("pointers", F.lit(0))
    return sums.select("l_suppkey", F.round(summary.go_null_safety(any_refs, F.col("refs"), F.col("checked"), pointers), 6).alias("null_safety"))


def trend_series(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each priority and day with orders; its categories are the statuses that the day has."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo_id"), F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias("at"), F.col("o_orderstatus").alias("category"), "o_totalprice")
    got = render.series_trend(o.groupBy("repo_id", "at", "category").agg((F.avg("o_totalprice") / 97000).alias("score")))
    return got.select("repo_id", F.col("at").alias("taken_at"), "category", F.round("score", 6).alias("score"), F.coalesce("before_at", F.lit(-1)).alias("before_at"), F.round("before", 6).alias("before"), F.round("change", 6).alias("change"))


def order_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cyclic_components(order_edges(spark, sf))


def order_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(order_edges(spark, sf))


def _cycles_sql(edges: str) -> str:
    """The first shortest path from each edge's end to its start, of all simple paths."""
    return f"""
WITH RECURSIVE e AS ({edges}),
p(repo_id, u, node, path) AS (
  SELECT repo_id, src, dst, [dst] FROM e
  UNION ALL SELECT p.repo_id, u, e.dst, list_append(path, e.dst) FROM p JOIN e ON p.repo_id = e.repo_id AND p.node = e.src WHERE p.node <> u AND NOT list_contains(path, e.dst)),
c AS (SELECT repo_id, path, list_position(path, list_min(path)) AS i FROM p WHERE node = u QUALIFY row_number() OVER (PARTITION BY repo_id, u, path[1] ORDER BY len(path), path) = 1)
SELECT DISTINCT repo_id, list_concat(path[i:], path[:i]) AS cycle FROM c"""


def _components_sql(edges: str) -> str:
    return f"""
WITH RECURSIVE e AS ({edges}),
r AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, r.src, e.dst FROM r JOIN e ON r.repo_id = e.repo_id AND r.dst = e.src)
SELECT a.repo_id, a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2"""


def url_depth(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    got = graph.depth_summary(table(spark, sf, "pages").select(host.alias("repo_id"), path.alias("rel_path")))
    return got.select("repo_id", "max_depth", F.round("avg_depth", 6).alias("avg_depth"))


def dead_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as exports of their type's unit, used where their order lines are large on the average."""
    part = table(spark, sf, "part").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("unit"), F.col("p_partkey").alias("name"))
    line = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n")).where("q >= 25 * n").select("name")
    return graph.dead_exports(part, part.join(line, "name"), part)


def dead_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as definitions, dead where fewer than ten orders name them."""
    customer = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("repo_id"), F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("name"))
    used = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).count().where("count >= 10").select("name").join(customer, "name").select("repo_id", "name")
    return graph.dead_names(customer, used, customer)


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.format_string("%d:%d", "l_orderkey", "l_linenumber").alias("entity"))
    got = summary.summary(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "entity")
    return got.select("l_returnflag", "l_linestatus", F.round("avg", 6).alias("avg"), "max", "max_entity")


def file_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals by status as a language's files: the first status gives the mean, all of them the maximum."""
    lang = F.element_at(F.create_map(*[F.lit(x) for x in ("O", "go", "F", "python", "P", "typescript")]), F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo_id"), lang.alias("language"), F.col("o_totalprice").alias("size"), F.col("o_orderkey").alias("file"))
    got = summary.file_sizes(summary.summary(rows, ["repo_id", "language"], "size", "file"))
    return got.select("repo_id", F.round("avg", 4).alias("avg"), "max", "max_entity")


def capped(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("checks"), (F.col("l_quantity") / 10).cast("int").alias("uses"))
    return summary.capped_credit(rows, ["l_returnflag"], "checks", "uses").select("l_returnflag", F.round("covered_pct", 6).alias("covered_pct"))


def joined_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the priority class found for their order and line, 1 where there is none."""
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo_id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    found = table(spark, sf, "orders").select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("repo_id"), F.col("o_orderkey").alias("file"), (1 + F.col("o_orderkey") % 4).cast("int").alias("line"), F.substring("o_orderpriority", 1, 1).cast("int").alias("complexity"))
    got = summary.with_complexity(line, found)
    return got.groupBy("repo_id").agg(F.count("*").alias("functions"), F.sum("complexity").alias("complexity"))


def covered(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_quantity").cast("int").alias("units"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("hits"))
    got = coverage.covered_percent(blocks.withColumn("year", F.year("l_shipdate")), ["year"])
    return got.select("year", F.round("coverage_percent", 6).alias("coverage_percent"))


def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines printed as a block profile, read by the parser."""
    v = F.format_string("pkg/f%d.go:%d.1,%d.2 %d %d", F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.when(F.col("l_linestatus") == "O", 0).otherwise(3))
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("repo_id"), v.alias("value"))
    got = coverage.covered_percent(coverage.profile_blocks(lines), ["repo_id", "file"])
    return got.select("repo_id", "file", F.round("coverage_percent", 6).alias("coverage_percent"))


def trend(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo_id"), F.col("o_orderstatus").alias("category"), "o_totalprice", F.year("o_orderdate").alias("y"))
    now = o.where("y >= 1998").groupBy("repo_id", "category").agg((F.avg("o_totalprice") / 100000).alias("score"))
    before = o.where("y < 1998").groupBy("repo_id", "category").agg((F.avg("o_totalprice") / 100000).alias("score"))
    got = render.trend(now, before)
    return got.select("repo_id", "category", *[F.round(c, 6).alias(c) for c in ("score", "before", "change")])


def metric_texts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in ("duplication_rate", "changelog_present", "max_dir_depth", "author_fragmentation")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    value = F.round(F.abs(F.col("s_acctbal")) / 128, 0) / 8
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("metric"), render.metric_text(name, value).alias("shown"))


def top_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return summary.top_rows(rows, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


_b = _COMPLEXITY.breakpoints
_SCORE_SQL = "CASE WHEN p_size <= 1 THEN 10.0 " + " ".join(f"WHEN p_size <= {v1} THEN {s0} + (p_size - {v0}) / ({v1} - {v0}) * ({s1} - {s0})" for (v0, s0), (v1, s1) in zip(_b, _b[1:], strict=False)) + " ELSE 1.0 END"
QUERIES = {
    "sco1_interpolate": (points, f"SELECT p_partkey, round({_SCORE_SQL}, 6) AS score, CAST(CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 5 THEN 2 WHEN p_size <= 10 THEN 3 WHEN p_size <= 20 THEN 4 ELSE 5 END AS INT) AS band FROM part"),
    "top13_tiers": (tiers, "WITH s AS (SELECT c_custkey, round(greatest(0.0, c_acctbal / 1000.0), 2) AS v FROM customer) SELECT c_custkey, CASE WHEN v >= 8 THEN 'Agent-Ready' WHEN v >= 6 THEN 'Agent-Assisted' WHEN v >= 4 THEN 'Agent-Limited' ELSE 'Agent-Hostile' END AS tier, CASE WHEN v < 6 THEN 'red' WHEN v < 8 THEN 'yellow' ELSE 'green' END AS light FROM s"),
    "agg6_degrees": (degree, f"WITH e AS ({EDGES_SQL}), n AS (SELECT repo_id, src AS node FROM e UNION SELECT repo_id, dst FROM e) SELECT repo_id, node, (SELECT count(*) FROM e WHERE e.repo_id = n.repo_id AND src = node) AS efferent, (SELECT count(*) FROM e WHERE e.repo_id = n.repo_id AND dst = node) AS afferent FROM n"),
    "agg7_fan_out": (fan_out, f"WITH e AS ({EDGES_SQL}), d AS (SELECT repo_id, src, count(*) AS n FROM e GROUP BY 1, 2) SELECT repo_id, round(avg(n), 6) AS fanout_avg, max(n) AS fanout_max, arg_max(src, (n, -rk)) AS fanout_max_node FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY src) AS rk FROM d) GROUP BY 1"),
    "gr2_cycles": (cycles, _cycles_sql(EDGES_SQL)),
    "snk7_series": (trend_series, """
WITH r AS (SELECT o_orderpriority AS repo_id, epoch(date_trunc('day', o_orderdate))::BIGINT AS taken_at, o_orderstatus AS category, avg(o_totalprice) / 97000 AS score FROM orders GROUP BY 1, 2, 3),
h AS (SELECT repo_id, taken_at, lag(taken_at) OVER (PARTITION BY repo_id ORDER BY taken_at) AS before_at FROM (SELECT DISTINCT repo_id, taken_at FROM r)),
j AS (SELECT r.*, before_at, CASE WHEN before_at IS NOT NULL THEN coalesce(o.score, 0.0) END AS before FROM r JOIN h USING (repo_id, taken_at) LEFT JOIN r o ON o.repo_id = r.repo_id AND o.taken_at = before_at AND o.category = r.category)
SELECT repo_id, taken_at, category, round(score, 6) AS score, coalesce(before_at, -1) AS before_at, round(before, 6) AS before, round(score - before, 6) AS change FROM j"""),
    "gr2_order_components": (order_components, _components_sql(ORDER_EDGES_SQL)),
    "gr2_order_cycles": (order_cycles, _cycles_sql(ORDER_EDGES_SQL)),
    "gr6_url_depth": (url_depth, "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS repo_id, CAST(max(len(string_split(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/')) - 1) AS INT) AS max_depth, round(avg(len(string_split(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/')) - 1), 6) AS avg_depth FROM pages GROUP BY 1"),
    "jn5_dead_exports": (dead_exports, "WITH u AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1) SELECT p_brand AS repo_id, p_type AS unit, p_partkey AS name FROM part WHERE p_brand IN (SELECT p_brand FROM u) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 25 * count(*))"),
    "jn6_dead_names": (dead_names, "WITH f AS (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1) SELECT c_mktsegment AS repo_id, c_custkey AS name, c_nationkey AS file FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM f) AND c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)"),
    "agg1_summaries": (summaries, "WITH r AS (SELECT *, l_orderkey || ':' || l_linenumber AS entity FROM lineitem), m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS a, max(l_quantity) AS x FROM r GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round(any_value(a), 6) AS avg, any_value(x) AS max, min(entity) AS max_entity FROM r JOIN m USING (l_returnflag, l_linestatus) WHERE l_quantity = x GROUP BY 1, 2"),
    "agg3_file_sizes": (file_sizes, "WITH g AS (SELECT o_orderpriority AS repo_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS k, avg(o_totalprice) AS a FROM orders GROUP BY 1, 2), x AS (SELECT o_orderpriority AS repo_id, max(o_totalprice) AS m FROM orders GROUP BY 1) SELECT g.repo_id, round(arg_min(a, k), 4) AS avg, any_value(m) AS max, (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority = g.repo_id AND o_totalprice = any_value(m)) AS max_entity FROM g JOIN x USING (repo_id) GROUP BY 1"),
    "agg12_go_null_safety": (go_null_safety, """
WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_linestatus = 'O') AS r, coalesce(sum(l_linenumber) FILTER (l_quantity > 49), 0) AS p, count(*) FILTER (l_discount > 0.05) AS c FROM lineitem GROUP BY 1),
t AS (SELECT *, CASE WHEN r = 0 THEN 100.0 ELSE 100.0 - 100.0 * least(a, r) / r END AS typed FROM s)
SELECT l_suppkey, round(CASE WHEN p = 0 THEN typed WHEN c >= p THEN (typed + 100) / 2 ELSE (typed + 100.0 * c / p) / 2 END, 6) AS null_safety FROM t"""),
    "agg12_capped_credit": (capped, "SELECT l_returnflag, round(100.0 * sum(least(l_linenumber, CAST(floor(l_quantity / 10) AS INT))) / sum(CAST(floor(l_quantity / 10) AS INT)), 6) AS covered_pct FROM lineitem GROUP BY 1"),
    "jn1_complexity": (joined_complexity, "SELECT l_returnflag AS repo_id, count(*) AS functions, CAST(sum(CASE WHEN l_linenumber = 1 + o_orderkey % 4 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) ELSE 1 END) AS BIGINT) AS complexity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "src12_coverage": (covered, "SELECT CAST(year(l_shipdate) AS INT) AS year, round(100.0 * sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INT) ELSE 0 END) / sum(CAST(l_quantity AS INT)), 6) AS coverage_percent FROM lineitem GROUP BY 1"),
    "src12_profile_text": (profile_text, "SELECT l_returnflag AS repo_id, 'pkg/f' || l_suppkey || '.go' AS file, round(100.0 * sum(CASE WHEN l_linestatus <> 'O' THEN CAST(l_quantity AS INT) ELSE 0 END) / sum(CAST(l_quantity AS INT)), 6) AS coverage_percent FROM lineitem GROUP BY 1, 2"),
    "snk7_trend": (trend, "WITH n AS (SELECT o_orderpriority AS repo_id, o_orderstatus AS category, avg(o_totalprice) / 100000 AS score FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2), b AS (SELECT o_orderpriority AS repo_id, o_orderstatus AS category, avg(o_totalprice) / 100000 AS before FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1, 2) SELECT repo_id, category, round(score, 6) AS score, round(coalesce(before, 0), 6) AS before, round(score - coalesce(before, 0), 6) AS change FROM n LEFT JOIN b USING (repo_id, category)"),
    "snk12_metric_texts": (metric_texts, "WITH v AS (SELECT s_suppkey, s_suppkey % 4 AS k, round(abs(s_acctbal) / 128, 0) / 8 AS x FROM supplier) SELECT s_suppkey, CASE k WHEN 0 THEN 'duplication_rate' WHEN 1 THEN 'changelog_present' WHEN 2 THEN 'max_dir_depth' ELSE 'author_fragmentation' END AS metric, CASE k WHEN 0 THEN printf('%.1f%%', round(x + 1e-9, 1)) WHEN 1 THEN CASE WHEN x >= 1 THEN 'yes' ELSE 'no' END WHEN 2 THEN printf('%d', CAST(round(x) AS BIGINT)) ELSE printf('%.2f', round(x + 1e-9, 2)) END AS shown FROM v"),
    "top1_lines": (top_lines, "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5"),
}
