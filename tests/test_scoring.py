"""Interpolation, composites, tiers, recommendations and configuration."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.config import CATEGORY_WEIGHTS, METRICS, TIERS, ScoringConfig, project_config, scoring_overlay
from gaugeworks.functions.scalars import interpolate
from gaugeworks.operators import scoring

SCHEMA = "repo_id string, metric string, value double, available boolean"


def scores(spark, breakpoints, values):
    rows = spark.createDataFrame([(float(v), list(breakpoints)) for v in values], "v double, b array<struct<value:double,score:double>>")
    return [r[0] for r in rows.select(interpolate(F.col("v"), F.col("b"))).collect()]


def test_interpolation_goldens(spark):
    falling = next(m for m in METRICS if m.name == "complexity_avg").breakpoints
    assert scores(spark, falling, [0.0, 1, 3, 5, 7.5, 10, 15, 20, 30, 40, 50]) == [10, 10, 9, 8, 7, 6, 4.5, 3, 2, 1, 1]
    rising = ((0.0, 1.0), (30.0, 4.0), (50.0, 6.0), (80.0, 9.0), (100.0, 10.0))
    assert scores(spark, rising, [0.0, 15, 50, 80, 100]) == [1, 2.5, 6, 9, 10]
    assert scores(spark, (), [3.0]) == [5.0]
    assert scores(spark, ((2.0, 7.0),), [0.0, 9.0]) == [7, 7]


def test_configuration_is_consistent():
    for category in CATEGORY_WEIGHTS:
        own = [m for m in METRICS if m.category == category]
        assert own and sum(m.weight for m in own) == pytest.approx(1.0)
    assert len(METRICS) == 38
    for m in METRICS:
        values = [v for v, _ in m.breakpoints]
        assert values == sorted(values)
    assert [s for _, s in TIERS] == sorted((s for _, s in TIERS), reverse=True)


def test_composite_and_tiers(spark):
    def composite(*pairs):
        rows = spark.createDataFrame([("r", f"c{i}", s, w) for i, (s, w) in enumerate(pairs)], "repo_id string, category string, score double, weight double")
        return scoring.composite_scores(rows).first()

    assert composite((8.0, 0.25), (6.0, 0.2), (7.0, 0.15))["composite"] == pytest.approx(7.08333333)
    assert composite((8.0, 0.25), (None, 0.2), (6.0, 0.15))["composite"] == pytest.approx(7.25)
    assert composite((None, 0.25))["composite"] == 0
    got = spark.createDataFrame([(s,) for s in (8.0, 7.99, 6.0, 5.99, 4.0, 3.9)], "s double").select(scoring.tier(F.col("s"))).collect()
    assert [r[0] for r in got] == ["Agent-Ready", "Agent-Assisted", "Agent-Assisted", "Agent-Limited", "Agent-Limited", "Agent-Hostile"]


def raw(spark, values):
    return spark.createDataFrame([("r", k, v, True) for k, v in values.items()], SCHEMA)


def test_recommendations_equal_a_full_recomputation(spark):
    values = {"complexity_avg": 18.0, "func_length_avg": 40.0, "duplication_rate": 9.0, "churn_rate": 400.0, "commit_stability": 2.0, "coverage_percent": 20.0}
    config = ScoringConfig().frame(spark)

    def composite_of(v):
        return scoring.composite_scores(scoring.category_scores(scoring.score_metrics(raw(spark, v), config))).first()["composite"]

    before = composite_of(values)
    rows = scoring.recommend(scoring.score_metrics(raw(spark, values), config)).orderBy("rank").collect()
    assert 0 < len(rows) <= 5
    assert [r["score_improvement"] for r in rows] == sorted((r["score_improvement"] for r in rows), reverse=True)
    for r in rows:
        assert composite_of(values | {r["metric"]: r["target_value"]}) - before == pytest.approx(r["score_improvement"], abs=1e-9)


def test_unavailable_metrics_have_no_weight(spark):
    rows = spark.createDataFrame([("r", "coverage_percent", None, False), ("r", "test_isolation", 95.0, True), ("r", "unknown", 1.0, True)], SCHEMA)
    sub = scoring.score_metrics(rows, ScoringConfig().frame(spark))
    assert sub.count() == 5
    by = {r["metric"]: r for r in sub.collect()}
    assert by["coverage_percent"]["score"] == 0 and by["test_isolation"]["score"] == 10 and by["test_file_ratio"]["score"] == 1


def test_effort_and_texts(spark):
    rows = spark.createDataFrame([(0.5, "x"), (1.0, "x"), (2.5, "x"), (0.5, "complexity_avg"), (2.6, "duplication_rate")], "gap double, metric string")
    assert [r[0] for r in rows.select(scoring.effort(F.col("gap"), F.col("metric"))).collect()] == ["Low", "Medium", "High", "Medium", "High"]
    advice = spark.createDataFrame([("churn_rate", 400.0, 300.0), ("null_safety", 10.0, 30.0)], "metric string, current_value double, target_value double")
    texts = spark.createDataFrame([("churn_rate", "Churn", None)], "metric string, title string, action string")
    got = {r["metric"]: r for r in scoring.with_texts(advice, texts).collect()}
    assert got["churn_rate"]["summary"] == "Churn: 400.0 to 300.0" and got["null_safety"]["action"].startswith("Move null_safety")


def test_settings():
    got = project_config("version: 1\nscoring:\n  weights: {C1: 0.5}\n  threshold: 6\n")
    assert got.weights == {"C1": 0.5} and got.threshold == 6
    for bad in ("version: 2", "scoring: {weights: {C1: -1}}", "scoring: {threshold: -2}"):
        with pytest.raises(ValueError):
            project_config(bad)
    config = ScoringConfig().with_weights({"C1": 0.9, "X": 1})
    assert config.categories["C1"] == 0.9 and "X" not in config.categories
    over = scoring_overlay("categories:\n  C1:\n    weight: 0.4\n    metrics: [{name: complexity_avg, weight: 0.5}]\n")
    assert over.categories["C1"] == 0.4 and next(m for m in over.metrics if m.name == "complexity_avg").weight == 0.5


def test_settings_of_each_repository(spark):
    """Project over file over default, breakpoints as rows, unusable documents ignored; equal to a configuration for each."""
    import json

    from gaugeworks.operators import settings

    file = {"categories": {"C1": {"weight": 0.4, "metrics": [{"name": "complexity_avg", "weight": 0.6, "breakpoints": [{"value": 2, "score": 9}, {"value": 8, "score": 3}, {"value": 9, "score": 2}]}]}, "Z": {"weight": 3}}}
    docs = [
        ("a", "file", json.dumps(file)), ("a", "project", '{"version": 1, "scoring": {"weights": {"C1": 0.9, "C2": 0.01}}}'),
        ("b", "file", json.dumps(file)), ("c", "project", '{"scoring": {"weights": {"C2": 0.7}}}'),
        ("d", "project", '{"version": 2, "scoring": {"weights": {"C2": 0.7}}}'), ("e", "project", '{"scoring": {"weights": {"C1": -1}}}'), ("f", "project", "nothing"), ("g", "other", "{}"), ("h", "project", '{"scoring": {"threshold": -2}}'), ("i", "file", ""),
    ]
    values = (1.0, 5.0, 8.0, 8.5, 40.0)
    documents = spark.createDataFrame(docs, "repo_id string, layer string, content string")
    errors = {(r["repo_id"], r["error"]) for r in settings.settings_errors(documents).collect()}
    assert errors == {("d", "unknown version"), ("e", "negative number"), ("f", "no JSON"), ("g", "unknown layer"), ("h", "negative number")}
    for value in values:
        raw = spark.createDataFrame([(r, m, v, True) for r in "abcdefghi" for m, v in (("complexity_avg", value), ("duplication_rate", 4.0), ("null_safety", 60.0))], "repo_id string, metric string, value double, available boolean")
        got = settings.score_with_settings(raw, ScoringConfig().frame(spark), settings.settings_rows(documents))
        mine = {r["repo_id"]: r["composite"] for r in scoring.composite_scores(scoring.category_scores(got)).collect()}
        filed = scoring_overlay(json.dumps({"categories": {"C1": file["categories"]["C1"]}}))
        configs = {"a": filed.with_weights({"C1": 0.9, "C2": 0.01}), "b": filed, "c": ScoringConfig().with_weights({"C2": 0.7})}
        by_config = {}
        for repo in ("a", "b", "c", "none"):
            config = configs.get(repo, ScoringConfig()).frame(spark)
            one = scoring.score_metrics(raw.where(F.col("repo_id") == ("d" if repo == "none" else repo)), config)
            by_config[repo] = scoring.composite_scores(scoring.category_scores(one)).first()["composite"]
        assert mine == pytest.approx({repo: by_config.get(repo, by_config["none"]) for repo in "abcdefghi"})


def test_lights_by_each_metrics_limits(spark):
    from gaugeworks.report import render

    rows = [
        ("complexity_avg", 10.0, 1.0, "green"), ("complexity_avg", 10.1, 9.0, "yellow"), ("complexity_avg", 20.1, 9.0, "red"), ("circular_deps", 0.0, 1.0, "green"), ("circular_deps", 2.0, 1.0, "yellow"), ("circular_deps", 3.0, 9.0, "red"),
        ("naming_consistency", 69.9, 9.0, "red"), ("naming_consistency", 70.0, 1.0, "yellow"), ("naming_consistency", 90.0, 1.0, "green"), ("test_to_code_ratio", 0.2, 1.0, "yellow"), ("assertion_density_avg", 0.0, 1.0, "green"),
        ("cross_file_navigation", 7.0, 1.0, "green"), ("cross_file_navigation", 3.0, 1.0, "red"), ("afferent_coupling_avg", 99.0, 8.0, "green"), ("afferent_coupling_avg", 0.0, 6.5, "yellow"), ("afferent_coupling_avg", 0.0, 5.9, "red"),
    ]
    frame = spark.createDataFrame([(*r, True) for r in rows] + [("complexity_avg", 1.0, 9.0, "grey", False)], "metric string, raw_value double, score double, want string, available boolean")
    assert [r for r in render.metric_lights(frame).collect() if r["light"] != r["want"]] == []
    assert not set(render.FALLING_LIGHTS) & set(render.RISING_LIGHTS) and {*render.FALLING_LIGHTS, *render.RISING_LIGHTS} <= {m.name for m in METRICS}


def test_go_null_safety(spark):
    from gaugeworks.operators import summary

    rows = [(0, 0, 0, 0, 100.0), (1, 4, 0, 0, 75.0), (1, 4, 5, 10, 62.5), (1, 4, 30, 10, 87.5), (0, 0, 1, 4, 62.5), (9, 4, 0, 0, 0.0)]
    frame = spark.createDataFrame(rows, "a int, t int, c int, p int, want double")
    assert [(r[0], r[1]) for r in frame.select(summary.go_null_safety(F.col("a"), F.col("t"), F.col("c"), F.col("p")), "want").collect() if r[0] != r[1]] == []


def test_metric_of_a_prompt(spark):
    from gaugeworks.operators import agent_eval

    rows = [("Please LIST all exported functions", "task_execution_consistency"), ("Trace its dependencies; explain what the code does", "code_behavior_comprehension"), ("trace the complete dependency chain", "cross_file_navigation"), ("interpret what the identifier x means", "identifier_interpretability"), ("Review the documentation", "documentation_accuracy_detection"), ("hello", "unknown"), (None, "unknown")]
    frame = spark.createDataFrame(rows, "prompt string, want string")
    assert [tuple(r) for r in frame.select(agent_eval.metric_of_prompt(F.col("prompt")).alias("got"), "want").where("got != want").collect()] == []


def test_measured_rows(spark):
    """Facts of one repository by hand: values of each table's metrics, and all of them scored."""
    from gaugeworks.operators import measured

    frame = spark.createDataFrame
    functions = frame([("r", 1, 10), ("r", 5, 30)], "repo_id string, complexity int, lines int")
    files = frame([("r", "a/b/x.go", False, 100, 10, 4, 3), ("r", "y.go", False, 300, 0, 0, 0), ("r", "y_test.go", True, 100, 15, 0, 0)], "repo_id string, rel_path string, is_test boolean, lines int, comments int, public int, documented int")
    texts = frame([("r", 1, "a\nb\nc\nd"), ("r", 2, "x\na\nb\nc")], "repo_id string, file long, text string")
    edges = frame([("r", "a", "b"), ("r", "a", "c")], "repo_id string, src string, dst string")
    exports = frame([("r", "u", "X"), ("r", "u", "Y"), ("r", "v", "Z")], "repo_id string, unit string, name string")
    names = frame([("r", "Good", True), ("r", "bad_name", False), ("r", "x", False)], "repo_id string, name string, exported boolean")
    numbers = frame([("r", "go", "7", False, None, False, 100), ("r", "go", "0", False, None, False, 100)], "repo_id string, language string, value string, in_const boolean, target string, subscript boolean, code_lines int")
    imports = frame([("r", "f1", "go", "net/http"), ("r", "f2", "go", "fmt")], "repo_id string, file string, language string, module string")
    tests = frame([("r", "f1", 2), ("r", "f2", 4)], "repo_id string, file string, assertions int")
    said = frame([("r", "cross_file_navigation", "import a -> b", None), ("r", "cross_file_navigation", "lost", "timeout"), ("r", "identifier_interpretability", "x", "timeout"), ("r", "other", "x", None)], "repo_id string, metric string, response string, error string")
    parts = [
        measured.of_functions(functions), measured.of_files(files), measured.of_texts(texts), measured.of_edges(edges), measured.of_exports(exports, exports.where("name = 'X'")),
        measured.of_names(names), measured.of_numbers(numbers), measured.of_imports(imports, tests), measured.of_responses(said),
    ]
    rows = {r["metric"]: r for r in measured.measured(*parts).collect()}
    got = {m: r["value"] for m, r in rows.items()}
    navigation = got.pop("cross_file_navigation")
    assert got == pytest.approx({
        "complexity_avg": 3.0, "func_length_avg": 20.0, "file_size_avg": 200.0, "max_dir_depth": 2.0, "comment_density": 5.0, "api_doc_coverage": 75.0, "test_to_code_ratio": 0.25, "test_file_ratio": 0.5,
        "duplication_rate": 75.0, "efferent_coupling_avg": 2 / 3, "afferent_coupling_avg": 2 / 3, "module_fanout_avg": 2.0, "dead_exports": 2.0, "naming_consistency": 50.0, "magic_number_ratio": 5.0,
        "import_complexity_avg": 1.5, "test_isolation": 50.0, "assertion_density_avg": 3.0, "identifier_interpretability": 0.0,
    })
    assert 1 <= navigation <= 10 and not rows["identifier_interpretability"]["available"]
    scored = scoring.category_scores(scoring.score_metrics(measured.measured(*parts), ScoringConfig().frame(spark)))
    assert {r["category"] for r in scored.collect()} == {"C1", "C2", "C3", "C4", "C6", "C7"}
