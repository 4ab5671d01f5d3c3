"""Agent evaluation from captured responses: sample selection, response scores, metric scores.

Responses are replayed from a table; nothing here calls a model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import any_of, clamp, comment_estimate, identifier_words, word_count


@dataclass(frozen=True)
class Rubric:
    """A base score, groups that add a point (or their delta) for any of their words, words that take one, and the bounds."""

    base: int
    groups: dict[str, list[str]]
    negatives: list[str]
    low: int = 1
    high: int = 10
    deltas: dict[str, int] = field(default_factory=dict)
    #: Groups that depend on more than words: name to a condition on the response.
    rules: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


# The rubrics by which captured responses are judged.
COMPREHENSION = Rubric(
    2,
    {
        "behavior_understanding": ["returns", "return value", "returns the"],
        "error_handling": ["error", "handles", "handling"],
        "control_flow": ["if ", "when ", "condition"],
        "edge_awareness": ["edge case", "corner case", "boundary"],
        "side_effects": ["side effect", "modifies", "updates"],
        "validation": ["validates", "checks", "ensures"],
        "hedging_language": ["might", "probably", "seems to"],
    },
    ["i don't know", "unclear", "cannot determine", "not sure", "unsure"],
    deltas={"hedging_language": -1},
)
NAVIGATION = Rubric(
    2,
    {
        "import_awareness": ["import", "from"],
        "cross_file_refs": [".go", ".py", ".ts", ".js"],
        "data_flow": ["->", "flow"],
        "purpose_mapping": ["module", "provides", "exports", "purpose"],
    },
    ["cannot find", "not found", "no file", "unable to", "cannot trace", "unknown"],
    rules={"depth": lambda t: F.regexp_count(t, F.lit("/")) > 6, "extensive_depth": lambda t: word_count(t) > 200},
)
IDENTIFIERS = Rubric(
    1,
    {
        "self_report_positive": ["accurate"],
        "self_report_partial": ["mostly correct", "partially"],
        "self_report_negative": ["incorrect", "wrong", "misunderstood"],
        "detailed_interpretation": ["interpretation:", "purpose:"],
        "action_words": ["handles", "manages", "creates", "processes", "returns", "validates", "converts", "parses"],
        "structure_verification": ["verification:"],
        "structure_accuracy": ["accuracy:"],
    },
    [],
    deltas={"self_report_positive": 2, "self_report_negative": -2},
)
_CONCLUSION = ["all documentation appears accurate", "no mismatches found", "documentation is accurate"]
DOCUMENTATION = Rubric(
    3,
    {
        "structure_summary": ["## summary"],
        "accurate_section": ["accurate documentation", "## accurate"],
        "mismatch_section": ["potential mismatch", "## potential"],
        "specific_analysis": ["location:", "comment says", "code does", "issue:"],
        "quality_language": ["accurate", "correctly", "describes", "matches", "documentation"],
    },
    ["cannot analyze", "unable to", "error reading", "no comments", "file not found"],
    rules={"conclusion": lambda t: any_of(t, _CONCLUSION) | (any_of(t, ["mismatch"]) & any_of(t, ["line"]))},
)
#: The metrics by their rubric, and how many samples each takes.
RUBRICS = {"code_behavior_comprehension": COMPREHENSION, "cross_file_navigation": NAVIGATION, "identifier_interpretability": IDENTIFIERS, "documentation_accuracy_detection": DOCUMENTATION}
SAMPLES = {"task_execution_consistency": 1, "code_behavior_comprehension": 3, "cross_file_navigation": 2, "identifier_interpretability": 5, "documentation_accuracy_detection": 3}


def matches(text: Column, rubric: Rubric) -> Column:
    """The checklist: name, matched and delta of each indicator."""
    found = {n: any_of(text, w) for n, w in rubric.groups.items()} | {n: rule(text) for n, rule in rubric.rules.items()}
    rows = [F.struct(F.lit(n).alias("name"), hit.alias("matched"), F.when(hit, rubric.deltas.get(n, 1)).otherwise(0).alias("delta")) for n, hit in found.items()]
    rows += [F.struct(F.lit(f"negative:{w}").alias("name"), any_of(text, [w]).alias("matched"), F.when(any_of(text, [w]), -1).otherwise(0).alias("delta")) for w in rubric.negatives]
    return F.array(*rows)


def response_score(text: Column, rubric: Rubric) -> Column:
    """Base and deltas within the bounds."""
    total = F.aggregate(matches(text, rubric), F.lit(rubric.base), lambda acc, m: acc + m["delta"])
    return clamp(total, rubric.low, rubric.high).cast("int")


def array_score(text: Column) -> Column:
    """How well a response keeps to a JSON array: 10 if it parses, 7 if it has a bracket, 4 if it says anything, else 1."""
    trimmed = F.trim(text)
    parsed = trimmed.startswith("[") & F.from_json(trimmed, "array<string>", {"mode": "PERMISSIVE"}).isNotNull() & trimmed.endswith("]")
    return F.when(parsed, 10).when(trimmed.contains("["), 7).when(F.length(trimmed) > 0, 4).otherwise(1)


def consistency_score(runs: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores of repeated runs judged by their population variance: 10 below 5, 7 below 15, 4 below 30, else 1.

    The variance comes from sums, which are exact for whole scores: a running mean leaves a variance of 5 just
    above or below it, by the order of the runs.
    """
    x, n = F.col(score).cast("double"), F.count(score)
    v = F.try_divide(n * F.sum(x * x) - F.sum(x) * F.sum(x), (n * n).cast("double"))
    return runs.groupBy(*keys).agg(v.alias("variance"), F.count("*").alias("runs")).withColumn("consistency", F.when(F.col("variance") < 5, 10).when(F.col("variance") < 15, 7).when(F.col("variance") < 30, 4).otherwise(1))


def metric_scores(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The truncated mean of successful samples (score, error); 0 where all failed."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    return samples.groupBy(*keys).agg(F.coalesce(F.expr("sum(case when error is null or error = '' then score end) div nullif(count_if(error is null or error = ''), 0)"), F.lit(0)).cast("int").alias("metric_score"), F.count_if(ok).alias("successes"), F.count("*").alias("samples"))


def overall_score(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of metrics (score, weight) that are above 0."""
    w = F.when(F.col("score") > 0, F.col("weight"))
    return metrics.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(w * F.col("score")), F.sum(w)), F.lit(0.0)).alias("overall"))


def select_samples(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The best ``n`` candidates (selection_score, file_path) of each group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("selection_score"), "file_path")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# What the prompts of each metric say, asked for in this order.
PROMPT_WORDS = {
    "task_execution_consistency": ("list all function names", "list all exported function"),
    "code_behavior_comprehension": ("explain what the code does",),
    "cross_file_navigation": ("trace the dependencies", "trace the complete dependency chain", "trace its dependencies"),
    "identifier_interpretability": ("interpret what the identifier", "interpret what each identifier"),
    "documentation_accuracy_detection": ("review the documentation", "identify any inaccuracies", "documentation accuracy"),
}


def metric_of_prompt(prompt: Column) -> Column:
    """The metric that a prompt asks for, by its words in any case; of several the first; ``unknown`` without any."""
    low = F.lower(prompt)
    out = F.lit("unknown")
    for metric, words in reversed(PROMPT_WORDS.items()):
        out = F.when(low.rlike("|".join(words)), F.lit(metric)).otherwise(out)
    return F.when(prompt.isNull(), F.lit("unknown")).otherwise(out)


def replay(calls: DataFrame, responses: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Calls (metric_id, call_order) with the captured response of the same place; a missing one is an error row.

    ``run`` names further columns of both that tell evaluations apart; places count within a run and metric.
    """
    keys = [*run, "metric_id"]
    order = Window.partitionBy(*keys).orderBy("call_order")
    numbered = calls.withColumn("sample_index", (F.row_number().over(order) - 1).cast("int"))
    got = responses.select(*keys, "sample_index", "response", "error")
    joined = numbered.join(got, [*keys, "sample_index"], "left")
    return joined.withColumn("error", F.when(F.col("response").isNull() & F.col("error").isNull(), "no captured response").otherwise(F.col("error")))


def size_sample_score(lines: Column, functions: Column) -> Column:
    """Closeness to a hundred lines and five functions; null outside 50 to 200 lines and 3 to 10 functions."""
    near = (1 - F.abs(lines - 100) / 100.0 + 1 - F.abs(functions - 5) / 5.0) / 2
    return F.when(lines.between(50, 200) & functions.between(3, 10), near)


def complexity_sample_score(keywords: Column, lines: Column) -> Column:
    """Keywords by the root of the lines; null below 30 lines or 5 keywords."""
    return F.when((lines >= 30) & (keywords >= 5), keywords / F.sqrt(lines.cast("double")))


# Words of control flow, import lines and public names by language.
_KEYWORDS = r"(?<![0-9A-Za-z_])(?:if|for|switch|case|while|try|catch|else)(?![0-9A-Za-z_])"
_IMPORTS = {
    "go": r'(?m)^\s*(?:import\s+|"[^"]+"\s*$|\t"[^"]+")',
    "python": r"(?m)^(?:import|from)\s+\w+",
    "typescript": r"(?m)^import\s+.+from\s+['\"]",
}
_OTHER_IMPORTS = r"(?m)^(?:import|from|require|include)\s+"
_PUBLIC = {
    "go": (r"^func\s+([A-Z][a-zA-Z0-9_]*)\s*\(", r"^type\s+([A-Z][a-zA-Z0-9_]*)\s+", r"^(?:var|const)\s+([A-Z][a-zA-Z0-9_]*)"),
    "python": (r"^(?:def|class)\s+([a-zA-Z][a-zA-Z0-9_]*)",),
    "typescript": (r"^export\s+(?:function|class|const|let|var|interface|type)\s+([a-zA-Z_][a-zA-Z0-9_]*)",),
}


def size_samples(files: DataFrame) -> DataFrame:
    """The file of a repository nearest to the ideal size; without any, the longest other file of more than 20 lines.

    ``files`` has repo_id, file_path, language, class, lines and content, as for all kinds of samples.
    """
    score = size_sample_score(F.col("lines"), F.regexp_count("content", F.lit(r"(?m)^func\s+")))
    first = files.where("class = 'source'").withColumn("selection_score", score).where("selection_score is not null")
    other = files.where("class != 'source' and lines > 20").withColumn("selection_score", F.col("lines").cast("double"))
    other = other.join(first.select("repo_id").distinct(), "repo_id", "left_anti")
    both = first.unionByName(other).select("repo_id", "file_path", "selection_score")
    return select_samples(both, ["repo_id"], SAMPLES["task_execution_consistency"])


def control_words(text: Column) -> Column:
    """How many words of control flow a text has."""
    return F.regexp_count(text, F.lit(_KEYWORDS))


def complexity_samples(files: DataFrame) -> DataFrame:
    """The files with most control flow for their length."""
    score = complexity_sample_score(control_words(F.col("content")), F.col("lines"))
    found = files.where("class = 'source'").select("repo_id", "file_path", score.alias("selection_score")).where("selection_score is not null")
    return select_samples(found, ["repo_id"], SAMPLES["code_behavior_comprehension"])


def import_samples(files: DataFrame) -> DataFrame:
    """The files with most import lines, three at least."""
    count = F.regexp_count("content", F.lit(_OTHER_IMPORTS))
    for name, pattern in _IMPORTS.items():
        count = F.when(F.col("language") == name, F.regexp_count("content", F.lit(pattern))).otherwise(count)
    found = files.where("class = 'source'").select("repo_id", "file_path", count.cast("double").alias("selection_score")).where("selection_score >= 3")
    return select_samples(found, ["repo_id"], SAMPLES["cross_file_navigation"])


def public_names(files: DataFrame) -> DataFrame:
    """Public names (repo_id, file_path, line, name) of source files, of four letters and more, tests and examples left out."""
    lines = files.where("class = 'source'").select("repo_id", "file_path", "language", F.posexplode(F.split("content", "\n")).alias("at", "value"))
    none, found = F.lit(None).cast("string"), []
    for language, patterns in _PUBLIC.items():
        hits = [F.regexp_extract("value", p, 1) for p in patterns]
        found.append(F.when(F.col("language") == language, F.coalesce(*[F.when(h != "", h) for h in hits])))
    named = lines.select("repo_id", "file_path", (F.col("at") + 1).alias("line"), F.coalesce(*found, none).alias("name"))
    low = F.lower("name")
    return named.where((F.length("name") >= 4) & ~low.startswith("test") & ~low.startswith("example") & ~low.startswith("mock"))


def name_samples(files: DataFrame) -> DataFrame:
    """The public names with most letters and words, each once, at its first place."""
    score = (F.length("name") * identifier_words(F.col("name"))).cast("double")
    once = Window.partitionBy("repo_id", "name").orderBy("file_path", "line")
    first = public_names(files).withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    order = Window.partitionBy("repo_id").orderBy(F.desc("selection_score"), "file_path", "line", "name")
    ranked = first.withColumn("selection_score", score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= SAMPLES["identifier_interpretability"])


def comment_samples(files: DataFrame) -> DataFrame:
    """The files of 20 lines and more with most comments for their length, a twentieth at least."""
    density = comment_estimate(F.col("content")) / F.col("lines")
    found = files.where("class = 'source' and lines >= 20").select("repo_id", "file_path", density.alias("selection_score")).where("selection_score >= 0.05")
    return select_samples(found, ["repo_id"], SAMPLES["documentation_accuracy_detection"])


def judgement_costs(judgements: DataFrame) -> DataFrame:
    """Captured judgements (repo_id, kind, score, tokens): mean score of each kind, tokens, and their cost at 5 dollars a million."""
    return judgements.groupBy("repo_id", "kind").agg(F.avg("score").alias("score"), F.sum("tokens").alias("tokens"), (F.sum("tokens") * 5.0 / 1e6).alias("cost_usd"))
