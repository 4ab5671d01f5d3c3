"""Predicates on names and numbers, rubrics, targets, sources that read files, and cyclic components."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import agent_eval, documentation, graph, raw_values, semantics, testing
from gaugeworks.report import prompts, render
from gaugeworks.sources import files


def one(spark, column, **values):
    """A column over one row of values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("name", "exported", "fits"), [("ServeHTTP", True, True), ("serve", True, False), ("serve", False, True), ("_x", False, True), ("my_name", False, False), ("Test_it", True, True), ("X", False, False)])
def test_go_names(spark, name, exported, fits):
    assert one(spark, semantics.go_name_fits(F.col("n"), F.col("e")), n=name, e=exported) is fits


def test_which_names_count(spark):
    rows = spark.createDataFrame([("ID",), ("_",), ("x",), ("Idx",), ("OK",)], "n string")
    assert [r[0] for r in rows.select(semantics.go_name_counts(F.col("n"))).collect()] == [False, False, False, True, False]
    rows = spark.createDataFrame([("__init__", "function"), ("x", "class"), ("run_it", "function"), ("__x__", "class"), ("v", "variable"), ("value", "variable")], "n string, k string")
    assert [r[0] for r in rows.select(semantics.python_name_counts(F.col("n"), F.col("k"))).collect()] == [False, False, True, True, False, False]
    assert one(spark, semantics.is_snake(F.col("n")), n="a1_b2") and not one(spark, semantics.is_snake(F.col("n")), n="a__b")


def test_strict_config(spark):
    def got(text):
        return tuple(one(spark, semantics.strict_config(F.col("t")), t=text))

    assert got('{"compilerOptions": {"strict": true}}') == (True, True)
    assert got('{"compilerOptions": {"strictNullChecks": true}}') == (False, True)
    assert got("{} // no") == (False, False) and got("") == (False, False)


@pytest.mark.parametrize(("language", "module", "external"), [("go", "net/http", True), ("go", "net/url", False), ("go", "github.com/a/redisx", True), ("python", "http.client", True), ("python", "httpclient", False), ("typescript", "./fs", False), ("typescript", "fs/promises", True), ("typescript", "@x/pg", False)])
def test_external_modules(spark, language, module, external):
    assert one(spark, testing.is_external(F.col("l"), F.col("m")), l=language, m=module) is external


def test_assertions_of_tests_without_any(spark):
    rows = spark.createDataFrame([("r", "f", "TestA", 3, 0), ("r", "f", "TestB", 9, 0), ("s", "g", "TestC", 1, 4)], "repo_id string, file string, name string, line int, assertions int")
    assert sorted(tuple(r) for r in testing.assertion_density(rows).collect()) == [("r", 0.0, 0, ""), ("s", 4.0, 4, "TestC")]


@pytest.mark.parametrize(("metric", "text", "score"), [
    ("code_behavior_comprehension", "It returns the sum, handles an error when x is bad; an edge case it checks. A side effect.", 8),
    ("code_behavior_comprehension", "Unclear, I'm not sure, it might work", 1),
    ("cross_file_navigation", "import a/b/c/d/e/f/g.go -> flow; the module provides", 6),
    ("identifier_interpretability", "Interpretation: it parses. Verification: done. Accuracy: accurate", 7),
    ("identifier_interpretability", "wrong", 1),
    ("documentation_accuracy_detection", "a mismatch at line 4", 4),
    ("documentation_accuracy_detection", "", 3),
])
def test_rubrics(spark, metric, text, score):
    assert one(spark, agent_eval.response_score(F.col("t"), agent_eval.RUBRICS[metric]), t=text) == score


def test_next_target(spark):
    def got(points, score):
        rows = spark.createDataFrame([([(float(a), float(b)) for a, b in points], float(score))], "b array<struct<value:double,score:double>>, s double")
        return tuple(rows.select(prompts.next_target(F.col("b"), F.col("s")).alias("t")).first()[0])

    rising, falling = [(0, 1), (30, 4), (90, 10)], [(1, 10), (10, 6), (40, 1)]
    assert got(rising, 2) == (30.0, 4.0) and got(rising, 10) == (90.0, 10.0)
    assert got(falling, 2) == (10.0, 6.0) and got(falling, 6) == (1.0, 10.0) and got([], 3) == (0.0, 3.0)


def test_bullets_cycles_and_replies(spark):
    assert one(spark, prompts.improvement_bullets(F.col("h")), h="<h4>How to Improve</h4><li> <b>a</b> b</li>\n<li></li><h4>x</h4><li>c</li>") == "- a b\n"
    assert one(spark, prompts.improvement_bullets(F.col("h")), h="<li>c</li>") == ""
    assert one(spark, prompts.cycle_text(F.array(F.lit("a"), F.lit("b")))) == "a -> b -> a"
    assert tuple(one(spark, prompts.reply_score(F.col("r")), r='{"structured_output": {"score": 11}}')) == (None, None, "score out of range")
    assert tuple(one(spark, prompts.reply_score(F.col("r")), r="{")) == (None, None, "unreadable reply")


def test_missing_categories_are_unavailable(spark):
    wide = spark.createDataFrame([("r", 5.0, False, 3.0, -1.0), ("s", 6.0, True, 4.0, 50.0)], "repo_id string, complexity_avg double, c5_available boolean, churn_rate double, coverage_percent double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in raw_values.raw_values(wide).collect()}
    assert got["r", "churn_rate"] == (None, False) and got["s", "churn_rate"] == (4.0, True)
    assert got["r", "coverage_percent"] == (-1.0, False) and got["s", "coverage_percent"] == (50.0, True)
    assert got["r", "complexity_avg"] == (5.0, True) and ("r", "max_dir_depth") not in got


def test_cyclic_components(spark):
    edges = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("r", "d", "e"), ("r", "e", "d"), ("r", "x", "a"), ("r", "f", "f"), ("s", "a", "b")]
    got = graph.cyclic_components(spark.createDataFrame(edges, "repo_id string, src string, dst string")).collect()
    assert sorted(tuple(r) for r in got) == [("r", "a", "a"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "d"), ("r", "e", "d")]


def test_diagrams_look_in_docs_first(spark):
    rows = [("a", "docs/x.txt", ""), ("a", "flow.png", ""), ("b", "flow.png", ""), ("c", "docs/uml.SVG", ""), ("d", "n.md", "```mermaid\n")]
    got = documentation.diagrams(spark.createDataFrame(rows, "repo_id string, rel_path string, content string"))
    assert {r[0]: r[1] for r in got.collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_trees_reports_and_responses_from_files(spark, tmp_path):
    (tmp_path / "t" / "src").mkdir(parents=True)
    (tmp_path / "t" / "node_modules").mkdir()
    (tmp_path / "t" / "src" / "a.go").write_text("package a\n\nfunc A() {}\n")
    (tmp_path / "t" / "node_modules" / "b.ts").write_text("x")
    tree = files.read_tree(spark, str(tmp_path / "t"), "r").select("rel_path", "lines").collect()
    assert [tuple(r) for r in tree] == [("src/a.go", 4)]
    (tmp_path / "old.json").write_text(json.dumps({"version": "2", "composite_score": 5.5, "categories": [{"name": "C1", "score": 4.0, "weight": 0.25}]}))
    base = files.read_baseline(spark, str(tmp_path / "old.json"))
    now = spark.createDataFrame([("r", "C1", 6.0), ("r", "C2", 3.0)], "repo_id string, category string, score double")
    assert sorted(tuple(r) for r in render.trend(now, base).collect()) == [("r", "C1", 6.0, 4.0, 2.0), ("r", "C2", 3.0, 0.0, 3.0)]
    said = spark.createDataFrame([("m1", 0, "a.go", "p", "answer\nmore", 1.5, None), ("m2", 1, "b.go", "p", "", 0.5, "timeout")], files.RESPONSE_SCHEMA)
    files.write_responses(said, str(tmp_path / "said"))
    back = files.read_responses(spark, str(tmp_path / "said")).select("metric_id", "sample_index", "response", "error").collect()
    assert sorted(tuple(r) for r in back) == [("m1", 0, "answer\nmore", None), ("m2", 1, "", "timeout")]


def test_rounding_is_half_up(spark):
    assert one(spark, scalars.rounded(F.col("v"), 1), v=0.25) == 0.3
