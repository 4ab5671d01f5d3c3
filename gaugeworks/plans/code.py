"""Queries on names, numbers, imports, tests and file listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import classify, documentation, evidence, graph, semantics, summary, testing
from gaugeworks.plans.adapters import table
from gaugeworks.plans.facts import FILES, IMPORTS, LISTING, NAMES, NUMBERS, TESTS, facts, plain
from gaugeworks.sources import coverage


def go_naming(spark: SparkSession, sf: str) -> DataFrame:
    names = facts(spark, sf, NAMES)
    got = semantics.naming_consistency(names, semantics.go_name_counts(F.col("name")), semantics.go_name_fits(F.col("name"), F.col("exported")), unjudged=100.0)
    return got.withColumn("naming_consistency", F.round("naming_consistency", 6))


def python_naming(spark: SparkSession, sf: str) -> DataFrame:
    names = facts(spark, sf, NAMES)
    got = semantics.naming_consistency(names, semantics.python_name_counts(F.col("name"), F.col("kind")), semantics.python_name_fits(F.col("name"), F.col("kind")))
    return got.withColumn("naming_consistency", F.round("naming_consistency", 6))


def name_tests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return facts(spark, sf, NAMES).select("part_id", "name", semantics.is_snake(n).alias("snake"), semantics.is_upper(n).alias("upper"), semantics.is_camel(n).alias("camel"))


def magic_numbers(spark: SparkSession, sf: str, language: str) -> DataFrame:
    magic = semantics.is_magic(F.col("language"), F.col("value"), F.col("in_const"), F.col("target"), F.col("subscript"))
    got = facts(spark, sf, NUMBERS).where(F.col("language") == language).groupBy("repo_id", "value").agg(F.count_if(magic).alias("magic"), F.count("*").alias("numbers"))
    return got.where("magic > 0")


def magic_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Magic numbers a thousand lines, over all languages."""
    magic = semantics.is_magic(F.col("language"), F.col("value"), F.col("in_const"), F.col("target"), F.col("subscript"))
    rows = facts(spark, sf, NUMBERS).select("repo_id", F.when(magic, 10).otherwise(0).alias("part"), "code_lines")
    return summary.ratio_of_sums(rows, ["repo_id"], "part", "code_lines", "magic_number_ratio").withColumn("magic_number_ratio", F.round("magic_number_ratio", 6))


def strictness(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, LISTING).where("rel_path = 'tsconfig.json'")
    return rows.select("repo_id", semantics.strict_config(F.col("content")).alias("c")).select("repo_id", "c.strict", "c.null_checks")


def external_imports(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, IMPORTS)
    return rows.groupBy("language", "module").agg(F.count("*").alias("imports"), F.count_if(testing.is_external(F.col("language"), F.col("module"))).alias("external"))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return testing.with_external(facts(spark, sf, TESTS), testing.external_files(facts(spark, sf, IMPORTS)))


def isolation(spark: SparkSession, sf: str) -> DataFrame:
    got = summary.isolation(facts(spark, sf, TESTS), testing.external_files(facts(spark, sf, IMPORTS)))
    return got.select("repo_id", "tests", F.round("test_isolation", 6).alias("test_isolation"))


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    return testing.assertion_density(facts(spark, sf, TESTS)).withColumn("avg", F.round("avg", 6))


def tests_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return testing.test_evidence(_flagged(spark, sf))


def first_files(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tests of one name's last digit, the first in file and line order."""
    rows = facts(spark, sf, TESTS).withColumn("key", F.substring("name", -1, 1)).withColumn("priority", F.struct("file", "line", "name"))
    return summary.first_by_priority(rows, ["repo_id", "key"], "priority", "name")


def imported_names(spark: SparkSession, sf: str) -> DataFrame:
    """Modules imported anywhere: by name, and by their first part."""
    rows = facts(spark, sf, IMPORTS)
    return graph.imported_names(rows.select("repo_id", F.col("module").alias("name")), rows.select("repo_id", F.substring_index("module", "/", 1).alias("name")))


def union_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Tests of the languages, one table under another."""
    t = facts(spark, sf, TESTS)
    parts = [t.where(F.col("line") % 3 == k).withColumn("language", F.lit(name)) for k, name in enumerate(summary.LANGUAGE_ORDER)]
    return summary.union_all(parts).groupBy("repo_id", "language").agg(F.count("*").alias("tests"), F.sum("assertions").alias("assertions"))


def languages(spark: SparkSession, sf: str) -> DataFrame:
    return semantics.project_languages(facts(spark, sf, LISTING))


def checkers(spark: SparkSession, sf: str) -> DataFrame:
    return semantics.type_checker(facts(spark, sf, LISTING))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return documentation.well_known(facts(spark, sf, LISTING))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return documentation.has_examples(facts(spark, sf, LISTING))


def collected(spark: SparkSession, sf: str) -> DataFrame:
    return documentation.example_texts(facts(spark, sf, LISTING))


def diagrams(spark: SparkSession, sf: str) -> DataFrame:
    return documentation.diagrams(facts(spark, sf, LISTING))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    ignored = classify.ignored_by(F.col("rel_path"), ["web/*.ts", "!web/app.ts", "# note", "pkg/"])
    got = classify.classify(facts(spark, sf, LISTING), ignored=ignored)
    return got.groupBy("rel_path", "language", "class", "exclude_reason").agg(F.count("*").alias("files"))


def repository_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of their hosts; a host's ignore file has lines of its own, made from its pages' folders."""
    host, path = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$", 1)
    pages = table(spark, sf, "pages").select(host.alias("repo_id"), path.alias("rel_path"))
    ends = pages.groupBy("repo_id").agg(F.min(F.substring_index("rel_path", "/", 1)).alias("a"), F.max(F.substring_index("rel_path", "/", 1)).alias("b"))
    www = F.when(F.col("repo_id").startswith("www."), "!*5").otherwise("# *")
    text = F.array(F.lit("[0-4]*"), www, F.concat(F.lit("/"), F.col("a"), F.lit("/  ")), F.concat(F.lit("!"), F.col("b"), F.lit("/1?")), F.lit("**/77/"), F.when(F.length("repo_id") % 2 == 0, "9").otherwise("!9"))
    lines = ends.select("repo_id", F.posexplode(text).alias("line_no", "line"))
    return classify.ignored_paths(pages, classify.ignore_rules(lines))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, LISTING).groupBy(classify.is_generated(F.col("content")).alias("generated")).agg(F.count("*").alias("files"))


def test_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("rel_path")
    rows = facts(spark, sf, LISTING).groupBy("rel_path").agg(F.count("*").alias("files")).withColumn("language", classify.language(p)).where("language is not null")
    return rows.select("rel_path", "language", classify.is_test_path(p, F.col("language")).alias("is_test"), classify.pruned(p).alias("pruned"), "files")


def source_only(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("rel_path")
    rows = facts(spark, sf, LISTING).withColumn("language", classify.language(p)).where("language is not null")
    return classify.source_files(rows).groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return classify.discovery_counters(classify.classify(facts(spark, sf, LISTING), ignored=F.col("rel_path").startswith("pkg/")))


def modules(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, LISTING)
    return graph.module_paths(rows.where("rel_path like '%.go'"), rows.where("substring_index(rel_path, '/', -1) = 'go.mod'"))


def intra(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, IMPORTS).select("repo_id", "file", F.col("module").alias("target"))
    own = rows.select("repo_id").distinct().withColumn("module", F.when(F.col("repo_id").startswith("1"), "net").otherwise("github.com/x"))
    return graph.intra_module(rows, own).groupBy("repo_id", "target").agg(F.count("*").alias("imports"))


def fan_outs(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, IMPORTS).groupBy("repo_id", "language", "file").agg(F.count_distinct("module").alias("efferent"))
    per = graph.fan_out(rows.select(F.struct("repo_id", "language").alias("repo_id"), F.col("file").alias("node"), "efferent"))
    return graph.merged_fan_out(per.select("repo_id.*", "fanout_avg", "fanout_max", "fanout_max_node")).withColumn("fanout_avg", F.round("fanout_avg", 6))


def depths(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, LISTING).withColumn("language", classify.language(F.col("rel_path"))).where("language is not null")
    per = graph.depth_summary(rows.withColumn("repo_id", F.struct("repo_id", "language")))
    return graph.merged_depth(per.select("repo_id.*", "max_depth", "avg_depth")).withColumn("avg_depth", F.round("avg_depth", 6))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    got = graph.segment_summary(facts(spark, sf, IMPORTS), "module")
    return got.select("repo_id", F.round("segments_avg", 6).alias("segments_avg"), F.col("segments_max").cast("long").alias("segments_max"))


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of files that stand for modules: file f7 is imported as module 7 by those whose number it follows."""
    rows = facts(spark, sf, TESTS).select("repo_id", F.col("file").alias("src"), F.concat(F.lit("f"), F.col("line").cast("string")).alias("target"))
    known = facts(spark, sf, IMPORTS).select("repo_id", F.col("file").alias("module"))
    return graph.resolve_imports(rows, known)


def duplication_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, FILES).groupBy("repo_id", "language").agg((F.count_if(F.col("lines") < 3) * 100.0 / F.count("*")).alias("duplication_rate"))
    return semantics.mean_of_positive(rows, "duplication_rate").withColumn("duplication_rate", F.round("duplication_rate", 6))


def null_safety(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, FILES).groupBy("repo_id").agg(F.sum(F.length("content") % 5).alias("chains"), F.sum("lines").alias("lines"), F.bool_or(F.col("lines") > 400).alias("strict"))
    return rows.select("repo_id", F.round(summary.script_null_safety(F.col("strict"), F.col("chains"), F.col("lines")), 6).alias("null_safety"))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, FILES).select("repo_id", "file_path", documentation.comment_lines(F.col("content")).alias("c"))
    return rows.select("repo_id", "file_path", F.col("c.total").alias("total"), F.col("c.comments").alias("comments"))


def densities(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, FILES).select("repo_id", documentation.comment_lines(F.col("content")).alias("c"), documentation.documented_exports(F.col("content")).alias("d"))
    flat = rows.select("repo_id", "c.total", "c.comments", "d.public", "d.documented")
    got = documentation.density(flat, ["repo_id"]).join(documentation.api_coverage(flat, ["repo_id"]), "repo_id")
    return got.select("repo_id", F.round("comment_density", 6).alias("comment_density"), F.round("api_doc_coverage", 6).alias("api_doc_coverage"))


_EXPORTS = "CASE conv_id % 4 WHEN 0 THEN '/** says */' || chr(10) || 'export function a() {}' || chr(10) WHEN 1 THEN '/**' || chr(10) || ' * says' || chr(10) || ' */' || chr(10) || '@deco' || chr(10) || 'export class B {}' || chr(10) || 'export const c = 1' || chr(10) WHEN 2 THEN '/** lone */' || chr(10) || 'let x' || chr(10) || 'export let y' || chr(10) ELSE 'export type T = {}' || chr(10) END"
EXPORTS = f"SELECT conv_id, turn, {_EXPORTS} || replace(coalesce(text, ''), '*', '') AS content FROM {{conversations}}"


def exports(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, EXPORTS).select("conv_id", "turn", documentation.documented_exports(F.col("content")).alias("d")).select("conv_id", "turn", "d.public", "d.documented")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT doc_id, '```' || chr(10) || replace(coalesce(text, ''), '```', '') || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```go' || chr(10) || lang || chr(10) || '  ```' || chr(10) || '```' || chr(10) || 'open' AS content FROM {documents}"
    got = facts(spark, sf, text).select("doc_id", documentation.code_blocks(F.col("content")).alias("b"))
    return got.select("doc_id", F.size("b").cast("long").alias("blocks"), F.sha2(F.array_join("b", "|"), 256).alias("bodies"))


def relative(spark: SparkSession, sf: str) -> DataFrame:
    """Python files as modules, and a relative import from each."""
    rows = facts(spark, sf, LISTING).select("repo_id", "rel_path", graph.module_of(F.concat(F.regexp_replace("rel_path", r"\.[a-z]+$", ""), F.lit(".py"))).alias("module"))
    return rows.select("repo_id", "rel_path", "module", graph.relative_module(F.col("module"), F.lit(1), F.lit("io")).alias("up_one"), graph.relative_module(F.col("module"), F.lit(2), F.lit("")).alias("up_two"))


def script_paths(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    rows = facts(spark, sf, LISTING)
    return rows.select("repo_id", "rel_path", graph.script_path(folder, F.lit("../lib/./index.tsx")).alias("a"), graph.script_path(folder, F.col("rel_path")).alias("b"))


def lcov(spark: SparkSession, sf: str) -> DataFrame:
    lines = facts(spark, sf, "SELECT l_returnflag AS repo_id, CASE WHEN l_linenumber = 1 THEN 'SF:x' ELSE 'DA:' || CAST(l_suppkey AS STRING) || ',' || CAST(l_partkey % 3 AS STRING) END AS value FROM {lineitem}")
    return coverage.covered_percent(coverage.lcov_blocks(lines), ["repo_id"]).withColumn("coverage_percent", F.round("coverage_percent", 6))


_REPORT = "SELECT 'r' || CAST(o_custkey AS STRING) AS repo_id, CASE o_orderkey % 4 WHEN 0 THEN 'build/cover.out' WHEN 1 THEN 'lcov.info' WHEN 2 THEN 'coverage.xml' ELSE 'x.txt' END AS rel_path, max(CASE o_orderkey % 4 WHEN 0 THEN 'mode: set' || chr(10) || 'a.go:1.1,2.2 ' || CAST(o_orderkey % 9 AS STRING) || ' 1' || chr(10) || 'a.go:3.1,4.2 4 0' WHEN 1 THEN 'DA:1,' || CAST(o_orderkey % 2 AS STRING) || chr(10) || 'DA:2,5' ELSE '<?xml version=\"1.0\"?><coverage line-rate=\"0.' || CAST(10 + o_orderkey % 80 AS STRING) || '\"></coverage>' END) AS text FROM {orders} GROUP BY 1, 2"


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.repository_coverage(facts(spark, sf, _REPORT)).withColumn("coverage_percent", F.round("coverage_percent", 6))


def cobertura(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, _REPORT)
    return rows.select("repo_id", "rel_path", F.round(coverage.cobertura_percent(F.col("text")), 6).alias("percent"))


def coupling(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, IMPORTS).select("repo_id", F.col("file").alias("src"), F.col("module").alias("dst")).distinct()
    return evidence.coupling_evidence(graph.degrees(rows))


def dead_evidence(spark: SparkSession, sf: str) -> DataFrame:
    names = facts(spark, sf, NAMES).select("repo_id", F.col("kind").alias("unit"), "name")
    used = names.where("name like '%_X'")
    return evidence.dead_export_evidence(graph.dead_exports(names.distinct(), used, names))


_N, _L, _I, _T, _F = (plain(x) for x in (NAMES, NUMBERS, IMPORTS, TESTS, FILES))
_S = plain(LISTING)
_ACRONYMS = ", ".join(f"'{a}'" for a in semantics.ACRONYMS)
_LANG = "CASE WHEN ends_with(rel_path, '.go') THEN 'go' WHEN ends_with(rel_path, '.py') THEN 'python' WHEN ends_with(rel_path, '.ts') OR ends_with(rel_path, '.tsx') THEN 'typescript' END"
_OUT = {k: ", ".join(f"'{m}'" for m in v) for k, v in testing.OUTSIDE.items()}
_EXTERNAL = f"""CASE language WHEN 'go' THEN module IN ({_OUT["go"]}) OR (contains(module, 'github.com') AND regexp_matches(module, 'http|sql|redis|mongo'))
  WHEN 'python' THEN split_part(module, '.', 1) IN ({_OUT["python"]})
  ELSE NOT starts_with(module, '.') AND CASE WHEN starts_with(module, '@') THEN regexp_extract(module, '^@[^/]+/[^/]+') ELSE split_part(module, '/', 1) END IN ({_OUT["typescript"]}) END"""
_MAGIC = {
    "go": "value NOT IN ('0', '1', '0.0', '1.0', '2', '0x0', '0x1') AND NOT in_const",
    "python": "value NOT IN ('0', '1', '-1', '2', '100', '0.0', '1.0') AND coalesce(target, '') <> 'MAX_SIZE' AND NOT subscript",
    "typescript": "value NOT IN ('0', '1', '-1', '0.0', '1.0') AND NOT in_const",
}
_FITS_GO = "CASE WHEN exported THEN regexp_matches(name, '^[A-Z]') ELSE regexp_matches(name, '^[a-z_]') END AND (NOT contains(substr(name, 2), '_') OR starts_with(lower(name[1]) || substr(name, 2), 'test'))"
_TOP = "NOT contains(rel_path, '/')"


def _naming_sql(judged: str, fits: str, unjudged: float = 0.0) -> str:
    return f"SELECT repo_id, count(*) FILTER ({judged}) AS judged, count(*) FILTER (({judged}) AND ({fits})) AS fitting, round(coalesce(100.0 * count(*) FILTER (({judged}) AND ({fits})) / nullif(count(*) FILTER ({judged}), 0), {unjudged}), 6) AS naming_consistency FROM ({_N}) GROUP BY 1"


def _magic_sql(language: str) -> str:
    return f"SELECT repo_id, value, count(*) FILTER ({_MAGIC[language]}) AS magic, count(*) AS numbers FROM ({_L}) WHERE language = '{language}' GROUP BY 1, 2 HAVING count(*) FILTER ({_MAGIC[language]}) > 0"


_MAGIC_ANY = "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _MAGIC.items()) + " END"
_FLAGGED = f"t AS ({_T}), e AS (SELECT DISTINCT repo_id, file FROM ({_I}) WHERE {_EXTERNAL}), g AS (SELECT t.*, e.file IS NOT NULL AS external FROM t LEFT JOIN e USING (repo_id, file))"
_COMMENTS = """
l AS (SELECT *, unnest(string_split(content, chr(10))) AS v, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS pos FROM f),
m AS (SELECT *, CASE WHEN starts_with(trim(v, ' '), '//') THEN 'line' WHEN starts_with(trim(v, ' '), '/*') THEN 'open' WHEN contains(v, '*/') THEN 'close' END AS mark FROM l),
w AS (SELECT *, last_value(CASE WHEN mark IN ('open', 'close') THEN mark END IGNORE NULLS) OVER (PARTITION BY repo_id, file_path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
k AS (SELECT repo_id, file_path, count(*) AS total, count(*) FILTER (mark IN ('line', 'open') OR before = 'open') AS comments FROM w GROUP BY 1, 2)
"""
QUERIES = {
    "flt11_go_naming": (go_naming, _naming_sql(f"length(name) > 1 AND name NOT IN ({_ACRONYMS})", _FITS_GO, 100.0)),
    "flt12_python_naming": (python_naming, _naming_sql("length(name) > 1 AND (kind = 'class' OR (kind = 'function' AND NOT (starts_with(name, '__') AND ends_with(name, '__'))))", "CASE kind WHEN 'class' THEN regexp_matches(name, '^[A-Z]') ELSE regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') END")),
    "f7_name_tests": (name_tests, f"SELECT part_id, name, regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') AS snake, regexp_full_match(name, '[A-Z][A-Z0-9_]*') AS upper, regexp_matches(name, '^[A-Z]') AS camel FROM ({_N})"),
    "flt13_go_magic": (lambda spark, sf: magic_numbers(spark, sf, "go"), _magic_sql("go")),
    "flt14_python_magic": (lambda spark, sf: magic_numbers(spark, sf, "python"), _magic_sql("python")),
    "flt15_script_magic": (lambda spark, sf: magic_numbers(spark, sf, "typescript"), _magic_sql("typescript")),
    "agg11_magic_ratio": (magic_ratio, f"SELECT repo_id, round(1000.0 * count(*) FILTER ({_MAGIC_ANY}) / sum(code_lines), 6) AS magic_number_ratio FROM ({_L}) GROUP BY 1"),
    "f19_strictness": (strictness, f"""
WITH c AS (SELECT repo_id, CASE WHEN json_valid(content) THEN content END AS j FROM ({_S}) WHERE rel_path = 'tsconfig.json'),
o AS (SELECT repo_id, coalesce(j->>'$.compilerOptions.strict' = 'true', false) AS s, coalesce(j->>'$.compilerOptions.strictNullChecks' = 'true', false) AS n, coalesce(j->>'$.compilerOptions.noImplicitAny' = 'true', false) AS a, coalesce(j->>'$.compilerOptions.strictFunctionTypes' = 'true', false) AS f FROM c)
SELECT repo_id, s OR (n AND a AND f) AS strict, s OR n AS null_checks FROM o"""),
    "f20_type_checker": (checkers, f"SELECT repo_id, bool_or(rel_path IN ('mypy.ini', '.mypy.ini', 'pyrightconfig.json') OR (rel_path = 'setup.cfg' AND contains(content, '[mypy]')) OR (rel_path = 'pyproject.toml' AND (contains(content, '[tool.mypy]') OR contains(content, '[tool.pyright]')))) AS type_checker FROM ({_S}) GROUP BY 1"),
    "src6_languages": (languages, f"""
SELECT repo_id, bool_or({_TOP} AND (rel_path = 'go.mod' OR ends_with(rel_path, '.go'))) AS go,
bool_or({_TOP} AND (rel_path IN ('pyproject.toml', 'setup.py', 'setup.cfg', 'requirements.txt') OR ends_with(rel_path, '.py'))) AS python,
bool_or({_TOP} AND (rel_path = 'tsconfig.json' OR ends_with(rel_path, '.ts') OR (rel_path = 'package.json' AND contains(content, 'ependencies": {{"typescript"')))) AS typescript FROM ({_S}) GROUP BY 1"""),
    "flt9_external_imports": (external_imports, f"SELECT language, module, count(*) AS imports, count(*) FILTER ({_EXTERNAL}) AS external FROM ({_I}) GROUP BY 1, 2"),
    "agg20_isolation": (isolation, f"WITH {_FLAGGED} SELECT repo_id, count(*) AS tests, round(100.0 * count(*) FILTER (NOT external) / count(*), 6) AS test_isolation FROM g GROUP BY 1"),
    "agg21_assertions": (assertions, f"WITH t AS ({_T}), m AS (SELECT repo_id, avg(assertions) AS a, max(assertions) AS m FROM t GROUP BY 1) SELECT repo_id, round(any_value(a), 6) AS avg, any_value(m) AS max, coalesce(arg_min(name, (file, line, name)) FILTER (assertions = m AND m > 0), '') AS max_entity FROM t JOIN m USING (repo_id) GROUP BY 1"),
    "top9_test_evidence": (tests_evidence, f"""
WITH {_FLAGGED}, x AS (SELECT *, row_number() OVER (PARTITION BY repo_id, external ORDER BY file, line, name) AS r1, row_number() OVER (PARTITION BY repo_id ORDER BY assertions, file, line, name) AS r2 FROM g)
SELECT repo_id, 'test_isolation' AS metric, r1 AS rank, file, line, 1.0::DOUBLE AS value, name || ' has external dependency' AS description FROM x WHERE external AND r1 <= 5
UNION ALL SELECT repo_id, 'assertion_density_avg', r2, file, line, assertions::DOUBLE, name || ' has ' || assertions || ' assertions' FROM x WHERE r2 <= 5"""),
    "agg28_first_rows": (first_files, f"SELECT repo_id, name[-1] AS key, arg_min(name, (file, line, name)) AS name FROM ({_T}) GROUP BY 1, 2"),
    "set2_imported_names": (imported_names, f"SELECT repo_id, module AS name FROM ({_I}) UNION SELECT repo_id, split_part(module, '/', 1) FROM ({_I})"),
    "set1_union_tests": (union_tests, f"SELECT repo_id, ['go', 'python', 'typescript'][line % 3 + 1] AS language, count(*) AS tests, CAST(sum(assertions) AS BIGINT) AS assertions FROM ({_T}) GROUP BY 1, 2"),
    "src20_well_known": (documents, f"""
WITH k(kind, priority, rel_path) AS (VALUES {", ".join(f"('{k}', {i}, '{n}')" for k, v in documentation.WELL_KNOWN.items() for i, n in enumerate(v))})
SELECT repo_id, kind, arg_min(rel_path, priority) AS rel_path FROM ({_S}) JOIN k USING (rel_path) GROUP BY 1, 2"""),
    "src20_examples": (examples, f"SELECT repo_id, bool_or(regexp_matches(rel_path, '^(examples|example|_examples)/') OR (rel_path = 'README.md' AND len(regexp_extract_all(content, '(?m)^```')) >= 2)) AS examples_present FROM ({_S}) GROUP BY 1"),
    "c7_12_examples": (collected, f"""
WITH s AS ({_S}), c AS (
  SELECT repo_id, CASE WHEN starts_with(rel_path, 'examples/') THEN 0 ELSE 1 END AS source, split_part(rel_path, '/', -1) AS name, content AS body FROM s WHERE regexp_full_match(rel_path, '(examples|example)/[^/]*\\.(go|py|ts|js)')
  UNION ALL SELECT repo_id, 2, 'README Example ' || n, b FROM (SELECT repo_id, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS n FROM (SELECT repo_id, regexp_extract_all(content, '(?s)```[^\\n]*\\n(.*?)\\n```', 1) AS bs FROM s WHERE rel_path = 'README.md'))),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS k FROM c WHERE (repo_id, source) IN (SELECT repo_id, min(source) FROM c GROUP BY 1))
SELECT repo_id, substr(string_agg('=== ' || name || ' ===' || chr(10) || body || chr(10) || chr(10), '' ORDER BY k), 1, 10000) AS examples FROM r WHERE k <= 3 GROUP BY 1"""),
    "src21_diagrams": (diagrams, f"""
WITH s AS (SELECT repo_id, starts_with(rel_path, 'docs/') AS d, (regexp_matches(lower(split_part(rel_path, '/', -1)), '\\.(png|svg|mermaid|drawio|puml)$') AND regexp_matches(lower(split_part(rel_path, '/', -1)), 'architecture|diagram|flow|sequence|class|er|uml')) OR (ends_with(rel_path, '.md') AND contains(content, '```mermaid')) AS h FROM ({_S}))
SELECT repo_id, CASE WHEN bool_or(d) THEN bool_or(d AND h) ELSE bool_or(h) END AS diagrams_present FROM s GROUP BY 1"""),
    "src5_ignored": (classified, f"""
WITH s AS (SELECT rel_path, content, {_LANG} AS language, split_part(rel_path, '/', -1) AS n FROM ({_S})),
c AS (SELECT *, CASE WHEN rel_path LIKE '%vendor/%' THEN 'vendor' WHEN starts_with(rel_path, 'pkg/') THEN 'gitignore' WHEN language = 'go' AND starts_with(content, '// Code generated') THEN 'generated' END AS exclude_reason FROM s WHERE language IS NOT NULL)
SELECT rel_path, language, CASE WHEN exclude_reason IN ('vendor', 'gitignore') THEN 'excluded' WHEN exclude_reason = 'generated' THEN 'generated' WHEN language = 'go' AND ends_with(n, '_test.go') THEN 'test' WHEN language = 'typescript' AND n = 'app.spec.tsx' THEN 'test' ELSE 'source' END AS class, exclude_reason, count(*) AS files FROM c GROUP BY ALL"""),
    "src5_repository_rules": (repository_rules, """
WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo_id, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS rel_path FROM pages),
e AS (SELECT repo_id, min(split_part(rel_path, '/', 1)) AS a, max(split_part(rel_path, '/', 1)) AS b FROM p GROUP BY 1),
m AS (
  SELECT p.*, [
    CASE WHEN regexp_matches(rel_path, '(^|/)[0-4][^/]*(/|$)') THEN 1 END,
    CASE WHEN starts_with(repo_id, 'www.') AND regexp_matches(rel_path, '(^|/)[^/]*5(/|$)') THEN -2 END,
    CASE WHEN starts_with(rel_path, a || '/') THEN 3 END,
    CASE WHEN regexp_matches(rel_path, '^' || b || '/1[^/](/|$)') THEN -4 END,
    CASE WHEN regexp_matches(rel_path, '(^|/)77/') THEN 5 END,
    CASE WHEN regexp_matches(rel_path, '(^|/)9(/|$)') THEN CASE WHEN length(repo_id) % 2 = 0 THEN 6 ELSE -6 END END] AS marks
  FROM p JOIN e USING (repo_id))
SELECT repo_id, rel_path, coalesce(list_filter(marks, lambda x: x IS NOT NULL)[-1] > 0, false) AS ignored FROM m"""),
    "flt3_generated": (generated, f"SELECT regexp_matches(content, '(?m)^// Code generated .* DO NOT EDIT\\.$') AS generated, count(*) AS files FROM ({_S}) GROUP BY 1"),
    "flt7_test_paths": (test_paths, f"SELECT rel_path, {_LANG} AS language, rel_path IN ('src/m_test.go', 'web/app.spec.tsx', 'web/__tests__/t.ts', 'pkg/test_io.py') AS is_test, rel_path = 'src/vendor/k.go' AS pruned, count(*) AS files FROM ({_S}) WHERE {_LANG} IS NOT NULL GROUP BY ALL"),
    "flt8_source_only": (source_only, f"SELECT repo_id, {_LANG} AS language, count(*) AS files FROM ({_S}) WHERE {_LANG} IS NOT NULL AND rel_path NOT IN ('src/m_test.go', 'web/app.spec.tsx', 'web/__tests__/t.ts', 'pkg/test_io.py') GROUP BY 1, 2"),
    "src1_counters": (scanned, f"""
WITH s AS (SELECT repo_id, rel_path, content, {_LANG} AS language FROM ({_S})), k AS (SELECT *, rel_path LIKE '%vendor/%' AS v, starts_with(rel_path, 'pkg/') AS g FROM s WHERE language IS NOT NULL),
c AS (SELECT *, NOT v AND NOT g AND language = 'go' AND starts_with(content, '// Code generated') AS made FROM k),
d AS (SELECT *, NOT v AND NOT g AND NOT made AND rel_path IN ('src/m_test.go', 'web/app.spec.tsx') AS t FROM c)
SELECT repo_id, count(*) AS total, count(*) FILTER (NOT v AND NOT g AND NOT made AND NOT t) AS source, count(*) FILTER (t) AS test, count(*) FILTER (made) AS generated, count(*) FILTER (v) AS vendor, count(*) FILTER (NOT v AND g) AS ignored FROM d GROUP BY 1"""),
    "gr5_module_paths": (modules, f"""
WITH s AS ({_S}), m AS (SELECT repo_id, regexp_replace(rel_path, '/?[^/]*$', '') AS d, regexp_extract(content, '(?m)^module (.*)$', 1) AS module FROM s WHERE split_part(rel_path, '/', -1) = 'go.mod'),
f AS (SELECT repo_id, rel_path FROM s WHERE ends_with(rel_path, '.go')),
j AS (SELECT f.repo_id, f.rel_path, arg_max(module, length(d)) AS module FROM f JOIN m ON f.repo_id = m.repo_id AND m.module <> '' AND (d = '' OR starts_with(f.rel_path, d || '/')) GROUP BY 1, 2)
SELECT repo_id, rel_path, coalesce(module, array_to_string(string_split(rel_path, '/')[1:3], '/')) AS module FROM f LEFT JOIN j USING (repo_id, rel_path)"""),
    "flt20_intra_module": (intra, f"SELECT repo_id, module AS target, count(*) AS imports FROM ({_I}) WHERE starts_with(module, CASE WHEN starts_with(repo_id, '1') THEN 'net' ELSE 'github.com/x' END) GROUP BY 1, 2"),
    "agg7_merged_fan_out": (fan_outs, f"""
WITH d AS (SELECT repo_id, language, file, count(DISTINCT module) AS n FROM ({_I}) GROUP BY 1, 2, 3), l AS (SELECT repo_id, language, avg(n) AS a, max(n) AS m, arg_min(file, (-n, file)) AS f FROM d GROUP BY 1, 2)
SELECT repo_id, round(a, 6) AS fanout_avg, m AS fanout_max, f AS fanout_max_node FROM l QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY m DESC, language) = 1"""),
    "agg8_merged_depth": (depths, f"WITH l AS (SELECT repo_id, {_LANG} AS language, len(string_split(rel_path, '/')) - 1 AS d FROM ({_S}) WHERE {_LANG} IS NOT NULL), g AS (SELECT repo_id, language, max(d) AS m, avg(d) AS a FROM l GROUP BY 1, 2) SELECT repo_id, CAST(max(m) AS INT) AS max_depth, round(max(a), 6) AS avg_depth FROM g GROUP BY 1"),
    "agg9_segments": (segments, f"SELECT repo_id, round(avg(len(string_split(module, '/'))), 6) AS segments_avg, max(len(string_split(module, '/'))) AS segments_max FROM ({_I}) GROUP BY 1"),
    "jn4_resolved_imports": (resolved, f"SELECT DISTINCT t.repo_id, t.file AS src, i.file AS dst FROM ({_T}) t JOIN ({_I}) i ON t.repo_id = i.repo_id AND 'f' || t.line = i.file WHERE t.file <> i.file"),
    "agg5_mean_duplication": (duplication_means, f"WITH r AS (SELECT repo_id, language, 100.0 * count(*) FILTER (lines < 3) / count(*) AS v FROM ({_F}) GROUP BY 1, 2) SELECT repo_id, round(coalesce(avg(v) FILTER (v > 0), 0.0), 6) AS duplication_rate FROM r GROUP BY 1"),
    "agg13_null_safety": (null_safety, f"SELECT repo_id, round(CASE WHEN bool_or(lines > 400) THEN 50.0 ELSE 0.0 END + least(50.0, 10.0 * sum(length(content) % 5) * 1000.0 / sum(lines)), 6) AS null_safety FROM ({_F}) GROUP BY 1"),
    "win5_comment_lines": (comments, f"WITH f AS ({_F}), {_COMMENTS} SELECT repo_id, file_path, CAST(total AS INT) AS total, CAST(comments AS INT) AS comments FROM k"),
    "agg14_densities": (densities, f"""
WITH f AS ({_F}), {_COMMENTS}, a AS (SELECT repo_id, sum(comments) * 100.0 / sum(total) AS c FROM k GROUP BY 1),
p AS (SELECT repo_id, count(*) FILTER (regexp_matches(v, '^ *export\\s+(default\\s+)?(async\\s+)?(abstract\\s+)?(function|class|interface|type|enum|const|let|var)\\b')) AS n FROM l GROUP BY 1)
SELECT repo_id, round(c, 6) AS comment_density, 0.0::DOUBLE AS api_doc_coverage FROM a JOIN p USING (repo_id)"""),
    "win6_documented_exports": (exports, "SELECT conv_id, turn, CAST(CASE conv_id % 4 WHEN 1 THEN 2 ELSE 1 END AS INT) AS public, CAST(CASE WHEN conv_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS INT) AS documented FROM conversations"),
    "win8_code_blocks": (blocks, "SELECT doc_id, 2::BIGINT AS blocks, sha256(replace(coalesce(text, ''), '```', '') || '|' || lang) AS bodies FROM documents"),
    "gr3_relative_modules": (relative, f"""
WITH m AS (SELECT repo_id, rel_path, replace(regexp_replace(rel_path, '\\.[a-z]+$', ''), '/', '.') AS module FROM ({_S})), p AS (SELECT *, string_split(module, '.') AS q FROM m)
SELECT repo_id, rel_path, module, array_to_string(list_append(q[:-2], 'io'), '.') AS up_one, array_to_string(q[1:greatest(len(q) - 2, 0)], '.') AS up_two FROM p"""),
    "gr4_script_paths": (script_paths, f"""
WITH s AS (SELECT repo_id, rel_path, regexp_replace(rel_path, '/?[^/]*$', '') AS d FROM ({_S})), u AS (SELECT *, string_split(d, '/') AS q FROM s)
SELECT repo_id, rel_path, CASE WHEN d = '' THEN '../' WHEN len(q) = 1 THEN '' ELSE array_to_string(q[:-2], '/') || '/' END || 'lib' AS a,
regexp_replace(CASE WHEN d = '' THEN '' ELSE d || '/' END || rel_path, '\\.(tsx?|jsx?)$', '') AS b FROM u"""),
    "src13_lcov": (lcov, "SELECT l_returnflag AS repo_id, round(100.0 * count(*) FILTER (l_partkey % 3 > 0) / count(*), 6) AS coverage_percent FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1"),
    "src14_cobertura": (cobertura, f"SELECT repo_id, rel_path, round(CASE WHEN contains(text, 'line-rate') THEN CAST(regexp_extract(text, 'line-rate=\"([0-9.]*)', 1) AS DOUBLE) * 100 END, 6) AS percent FROM ({plain(_REPORT)})"),
    "src15_repository_coverage": (reports, f"""
WITH r AS ({plain(_REPORT)}), p AS (
  SELECT repo_id, 0 AS k, 100.0 * CAST(regexp_extract(text, '2 (\\d+) 1', 1) AS INT) / (CAST(regexp_extract(text, '2 (\\d+) 1', 1) AS INT) + 4) AS v FROM r WHERE rel_path = 'build/cover.out'
  UNION ALL SELECT repo_id, 1, CASE WHEN contains(text, 'DA:1,0') THEN 50.0 ELSE 100.0 END FROM r WHERE rel_path = 'lcov.info'
  UNION ALL SELECT repo_id, 2, CAST(regexp_extract(text, 'line-rate=\"([0-9.]*)', 1) AS DOUBLE) * 100 FROM r WHERE rel_path = 'coverage.xml')
SELECT repo_id, round(arg_min(v, k), 6) AS coverage_percent FROM p GROUP BY 1"""),
    "top3_coupling_evidence": (coupling, f"""
WITH e AS (SELECT DISTINCT repo_id, file AS src, module AS dst FROM ({_I})), o AS (SELECT repo_id, src AS node, count(*) AS n FROM e GROUP BY 1, 2), i AS (SELECT repo_id, dst AS node, count(*) AS n FROM e GROUP BY 1, 2),
n AS (SELECT repo_id, src AS node FROM e UNION SELECT repo_id, dst FROM e), d AS (SELECT n.repo_id, n.node, coalesce(o.n, 0) AS efferent, coalesce(i.n, 0) AS afferent FROM n LEFT JOIN o ON o.repo_id = n.repo_id AND o.node = n.node LEFT JOIN i ON i.repo_id = n.repo_id AND i.node = n.node),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY afferent DESC, node) AS ra, row_number() OVER (PARTITION BY repo_id ORDER BY efferent DESC, node) AS re FROM d)
SELECT repo_id, 'afferent_coupling_avg' AS metric, ra AS rank, node AS file, afferent::DOUBLE AS value, afferent || ' dependents' AS description FROM r WHERE ra <= 5
UNION ALL SELECT repo_id, 'efferent_coupling_avg', re, node, efferent::DOUBLE, efferent || ' dependencies' FROM r WHERE re <= 5"""),
    "top5_dead_exports": (dead_evidence, f"""
WITH n AS (SELECT DISTINCT repo_id, kind AS unit, name FROM ({_N})), u AS (SELECT repo_id FROM n GROUP BY 1 HAVING count(DISTINCT unit) > 1),
d AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY unit, name) AS rank FROM n WHERE repo_id IN (SELECT repo_id FROM u) AND NOT name LIKE '%_X')
SELECT repo_id, 'dead_exports' AS metric, rank, unit AS file, 1.0::DOUBLE AS value, name || ' is never imported' AS description FROM d WHERE rank <= 5"""),
}
