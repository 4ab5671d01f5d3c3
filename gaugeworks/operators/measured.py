"""Raw values of all seven categories from the facts that parsers and histories give, for ``scoring.score_metrics``.

Each table of facts is read once: all metrics that it gives come from one grouping by repository, and go from there
to rows of (repo_id, metric, value, available). The rows of all tables are put together; no wide row is built and
the tables are never joined with each other, except where a metric is about two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import percentage
from gaugeworks.operators import agent_eval, clones, graph, semantics, summary, testing
from gaugeworks.operators.graph import depth


def long_rows(frame: DataFrame, **metrics: Column) -> DataFrame:
    """One row for each metric of a table with one row a repository; a metric without a value is unavailable."""
    one = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), value.isNotNull().alias("available")) for name, value in metrics.items()]
    return frame.select("repo_id", F.explode(F.array(*one)).alias("m")).select("repo_id", "m.*")


def of_functions(functions: DataFrame) -> DataFrame:
    """From functions (repo_id, complexity, lines): how complex and how long they are."""
    got = functions.groupBy("repo_id").agg(F.avg("complexity").alias("complexity"), F.avg("lines").alias("lines"))
    return long_rows(got, complexity_avg=F.col("complexity"), func_length_avg=F.col("lines"))


def of_files(files: DataFrame) -> DataFrame:
    """From files (repo_id, rel_path, is_test, lines, comments, public, documented): sizes, depth, comments, tests."""
    test, source = F.col("is_test"), ~F.col("is_test")
    lines = lambda where: F.sum(F.when(where, F.col("lines")).otherwise(0))
    got = files.groupBy("repo_id").agg(
        F.avg(F.when(source, F.col("lines"))).alias("size"), F.max(depth(F.col("rel_path"))).alias("depth"),
        percentage(F.sum("comments"), F.sum("lines")).alias("density"), percentage(F.sum("documented"), F.sum("public")).alias("documented"),
        F.coalesce(F.try_divide(lines(test), lines(source)), F.lit(0.0)).alias("test_lines"), F.coalesce(F.try_divide(F.count_if(test), F.count_if(source)), F.lit(0.0)).alias("test_files"),
    )
    return long_rows(got, file_size_avg=F.col("size"), max_dir_depth=F.col("depth"), comment_density=F.col("density"), api_doc_coverage=F.col("documented"), test_to_code_ratio=F.col("test_lines"), test_file_ratio=F.col("test_files"))


def of_texts(texts: DataFrame, least: int = clones.LEAST_STATEMENTS) -> DataFrame:
    """From texts (repo_id, file, text): the share of lines in duplicated windows of ``least`` lines."""
    totals = texts.groupBy("repo_id").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    got = clones.duplication_rate(clones.line_windows(texts, least), totals)
    return long_rows(got, duplication_rate=F.col("duplication_rate"))


def of_edges(edges: DataFrame) -> DataFrame:
    """From import edges (repo_id, src, dst): mean degrees and fan-out of modules."""
    got = graph.degrees(edges).groupBy("repo_id").agg(F.avg("efferent").alias("efferent"), F.avg("afferent").alias("afferent"), F.avg(F.when(F.col("efferent") > 0, F.col("efferent"))).alias("fan_out"))
    return long_rows(got, efferent_coupling_avg=F.col("efferent"), afferent_coupling_avg=F.col("afferent"), module_fanout_avg=F.col("fan_out"))


def of_exports(exports: DataFrame, used: DataFrame) -> DataFrame:
    """From exports and used names (repo_id, unit, name): how many exports nothing needs."""
    dead = graph.dead_exports(exports, used, exports).groupBy("repo_id").agg(F.count("*").alias("dead"))
    got = exports.select("repo_id").distinct().join(dead, "repo_id", "left")
    return long_rows(got, dead_exports=F.coalesce("dead", F.lit(0)))


def of_names(names: DataFrame) -> DataFrame:
    """From declared names (repo_id, name, exported) of Go sources: whether they keep to the rules."""
    got = semantics.naming_consistency(names, semantics.go_name_counts(F.col("name")), semantics.go_name_fits(F.col("name"), F.col("exported")), unjudged=100.0)
    return long_rows(got, naming_consistency=F.col("naming_consistency"))


def of_numbers(numbers: DataFrame) -> DataFrame:
    """From numbers (repo_id, language, value, in_const, target, subscript, code_lines): those without a name by thousand lines."""
    magic = semantics.is_magic(F.col("language"), F.col("value"), F.col("in_const"), F.col("target"), F.col("subscript"))
    got = numbers.groupBy("repo_id").agg(F.coalesce(F.try_divide(F.count_if(magic) * 1000.0, F.sum("code_lines")), F.lit(0.0)).alias("ratio"))
    return long_rows(got, magic_number_ratio=F.col("ratio"))


def of_imports(imports: DataFrame, tests: DataFrame) -> DataFrame:
    """From imports (repo_id, file, language, module) and tests (repo_id, file, assertions): how deep import paths are,
    how many tests stay inside their process, and how much they assert."""
    paths = graph.segment_summary(imports, "module")
    flagged = testing.with_external(tests, testing.external_files(imports))
    got = flagged.groupBy("repo_id").agg(percentage(F.count_if(~F.col("external")), F.count("*")).alias("isolated"), F.avg("assertions").alias("assertions"))
    return long_rows(paths, import_complexity_avg=F.col("segments_avg")).unionByName(long_rows(got, test_isolation=F.col("isolated"), assertion_density_avg=F.col("assertions")))


def of_responses(responses: DataFrame) -> DataFrame:
    """From responses (repo_id, metric, response, error) of an agent: the score of each metric that has a rubric."""
    score = F.lit(None).cast("int")
    for metric, rubric in agent_eval.RUBRICS.items():
        score = F.when(F.col("metric") == metric, agent_eval.response_score(F.col("response"), rubric)).otherwise(score)
    got = agent_eval.metric_scores(responses.where(F.col("metric").isin(*agent_eval.RUBRICS)).withColumn("score", score), ["repo_id", "metric"])
    return got.select("repo_id", "metric", F.col("metric_score").cast("double").alias("value"), (F.col("successes") > 0).alias("available"))


def measured(*parts: DataFrame) -> DataFrame:
    """All rows together; a metric that two tables give is an error of the caller's and fails in scoring."""
    return summary.union_all([p.select("repo_id", "metric", "value", "available") for p in parts])
