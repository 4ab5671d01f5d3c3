"""Summaries of functions, files and tests: means, maxima with who has them, blends over languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import percentage

#: The order of languages wherever a result depends on one.
LANGUAGE_ORDER = ("go", "python", "typescript")


def language_rank(lang: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, LANGUAGE_ORDER)), lang)
    return F.when(at > 0, at).otherwise(F.lit(99))


def summary(rows: DataFrame, keys: list[str], value: str, entity: str) -> DataFrame:
    """Mean, maximum and the entity that has it; of equal maxima the smallest entity."""
    v = F.col(value)
    best = F.min(F.struct((-v).alias("v"), F.col(entity).alias("e")))
    return rows.groupBy(*keys).agg(F.avg(v).alias("avg"), F.max(v).alias("max"), best["e"].alias("max_entity"))


def with_complexity(functions: DataFrame, complexity: DataFrame) -> DataFrame:
    """Functions with the complexity found at their file and line, 1 where there is none."""
    return functions.join(complexity.select("repo_id", "file", "line", "complexity"), ["repo_id", "file", "line"], "left").withColumn("complexity", F.coalesce("complexity", F.lit(1)))


def file_sizes(by_language: DataFrame) -> DataFrame:
    """Over languages (repo_id, language, avg, max, max_entity): the first language's mean, the largest file of all."""
    first = F.min(F.struct(language_rank(F.col("language")).alias("r"), F.col("avg").alias("avg")))
    best = F.min(F.struct((-F.col("max")).alias("v"), F.col("max_entity").alias("e")))
    return by_language.groupBy("repo_id").agg(first["avg"].alias("avg"), F.max("max").alias("max"), best["e"].alias("max_entity"))


def top_rows(rows: DataFrame, keys: list[str], value: str, ties: list[str], n: int = 5, descending: bool = True) -> DataFrame:
    """The first ``n`` rows of each group by a value, ties in a fixed order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value) if descending else F.asc(value), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def weighted_mean(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Weighted means of several values; null where the weights sum to 0."""
    w = F.col(weight)
    return rows.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(v) * w), F.sum(w)).alias(v) for v in values])


def ratio_of_sums(rows: DataFrame, keys: list[str], part: str, whole: str, name: str) -> DataFrame:
    """A percentage of summed counts."""
    return rows.groupBy(*keys).agg(percentage(F.sum(part), F.sum(whole)).alias(name))


def capped_credit(rows: DataFrame, keys: list[str], checks: str, uses: str) -> DataFrame:
    """How much of the uses is checked, each row's checks counting up to its uses."""
    return rows.groupBy(*keys).agg(percentage(F.sum(F.least(checks, uses)), F.sum(uses)).alias("covered_pct"))


def go_null_safety(any_refs: Column, type_refs: Column, checked: Column, pointers: Column) -> Column:
    """The share of type references that are not the any-type (100 without references), in the mean with the share of
    pointer uses that are checked, at most 100, where there are such uses."""
    whole = F.lit(100.0)
    typed = F.greatest(F.lit(0.0), whole - F.coalesce(F.try_divide(any_refs * 100.0, type_refs.cast("double")), F.lit(0.0)))
    safe = F.least(whole, F.try_divide(checked * 100.0, pointers.cast("double")))
    return F.when(pointers > 0, (typed + safe) / 2).otherwise(typed)


def script_null_safety(strict: Column, chains: Column, lines: Column) -> Column:
    """Half for strict mode, and up to a half for optional chains by thousand lines."""
    per_k = F.coalesce(F.try_divide(chains * 1000.0, lines.cast("double")), F.lit(0.0))
    return F.when(strict, 50.0).otherwise(0.0) + F.least(F.lit(50.0), per_k * 10.0)


def blend(rows: DataFrame, value: str, unset: float | None = None) -> DataFrame:
    """Per repository, values of languages averaged pairwise in the fixed order; an ``unset`` running value is replaced."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(language_rank(F.col("language")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"])
    gathered = rows.groupBy("repo_id").agg(ordered.alias("all"))  # at most one value a language

    def step(acc: Column, v: Column) -> Column:
        fresh = acc.isNull() if unset is None else acc.isNull() | (acc == F.lit(unset))
        return F.when(fresh, v).otherwise((acc + v) / 2)

    return gathered.select("repo_id", F.aggregate("all", F.lit(None).cast("double"), step).alias(value))


def test_ratio(files: DataFrame) -> DataFrame:
    """Test and source files and lines (repo_id, is_test, lines), with their ratios."""
    t = F.col("is_test")
    out = files.groupBy("repo_id").agg(F.count_if(t).alias("test_files"), F.count_if(~t).alias("source_files"), F.sum(F.when(t, F.col("lines")).otherwise(0)).alias("test_lines"), F.sum(F.when(~t, F.col("lines")).otherwise(0)).alias("source_lines"))
    return out.withColumn("test_to_code_ratio", F.coalesce(F.try_divide("test_lines", "source_lines"), F.lit(0.0))).withColumn("test_file_ratio", F.coalesce(F.try_divide("test_files", "source_files"), F.lit(0.0)))


def isolation(tests: DataFrame, external: DataFrame) -> DataFrame:
    """Per cent of tests (repo_id, file, name) whose file has no external dependency; 100 without tests elsewhere."""
    flagged = tests.join(external.select("repo_id", "file").distinct().withColumn("ext", F.lit(True)), ["repo_id", "file"], "left")
    return flagged.groupBy("repo_id").agg(F.count("*").alias("tests"), percentage(F.count_if(F.col("ext").isNull()), F.count("*")).alias("test_isolation"))


def first_by_priority(rows: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """The value of the row with the least priority, as for alternative files of one kind."""
    return rows.groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of several languages in one table, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
