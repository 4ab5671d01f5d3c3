"""Documentation measures over lines of text: comments, exports with comments, code blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import percentage


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def comment_lines(text: Column) -> Column:
    """(total, comments) by a walk over lines that knows line comments and open block comments.

    A block opened on a line stays open until a later line holds its end; a
    block that opens and closes on one line is counted and leaves the walk open,
    as the measure is defined.
    """
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("comments"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        opens = t.startswith("/*")
        plain = t.startswith("//")
        closes = acc["open"] & ~plain & ~opens & t.contains("*/")
        counted = plain | opens | acc["open"]
        still = F.when(plain, acc["open"]).when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(acc["open"])
        return F.struct((acc["total"] + 1).alias("total"), (acc["comments"] + F.when(counted, 1).otherwise(0)).alias("comments"), still.alias("open"))

    return F.aggregate(lines_of(text), zero, step, lambda a: F.struct(a["total"].alias("total"), a["comments"].alias("comments")))


def documented_exports(text: Column) -> Column:
    """(public, documented): exported declarations, and those right after a documentation block."""
    zero = F.struct(F.lit(0).alias("public"), F.lit(0).alias("documented"), F.lit(False).alias("inside"), F.lit(False).alias("ready"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        starts, ends = t.startswith("/**"), t.contains("*/")
        export = t.rlike(r"^export\s+(default\s+)?(async\s+)?(abstract\s+)?(function|class|interface|type|enum|const|let|var)\b") & ~acc["inside"]
        inside = F.when(starts, ~ends).when(acc["inside"], ~ends).otherwise(F.lit(False))
        done = (starts | acc["inside"]) & ends
        ready = F.when(done, F.lit(True)).when((t == "") | inside, acc["ready"] & (t == "")).otherwise(t.startswith("@") & acc["ready"])
        return F.struct(
            (acc["public"] + F.when(export, 1).otherwise(0)).alias("public"),
            (acc["documented"] + F.when(export & acc["ready"], 1).otherwise(0)).alias("documented"),
            inside.alias("inside"),
            ready.alias("ready"),
        )

    return F.aggregate(lines_of(text), zero, step, lambda a: F.struct(a["public"].alias("public"), a["documented"].alias("documented")))


def code_blocks(text: Column) -> Column:
    """The bodies of fenced code blocks, in order; an unclosed block is left out."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("body"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.trim(line).startswith("```")
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(fence & acc["open"], F.array_append(acc["done"], F.array_join(acc["body"], "\n"))).otherwise(acc["done"]).alias("done"),
            F.when(fence, none).when(acc["open"], F.array_append(acc["body"], line)).otherwise(none).alias("body"),
            F.when(fence, ~acc["open"]).otherwise(acc["open"]).alias("open"),
        )

    return F.aggregate(lines_of(text), zero, step, lambda a: a["done"])


def density(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of comment lines over summed files (total, comments)."""
    return files.groupBy(*keys).agg(percentage(F.sum("comments"), F.sum("total")).alias("comment_density"))


def api_coverage(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of public declarations that are documented."""
    return files.groupBy(*keys).agg(percentage(F.sum("documented"), F.sum("public")).alias("api_doc_coverage"))


# File names that count as each kind of document, first match first; folders of examples; drawings.
WELL_KNOWN = {
    "readme": ("README.md", "README", "readme.md", "README.txt", "README.rst"),
    "changelog": ("CHANGELOG.md", "CHANGELOG", "HISTORY.md", "changelog.md"),
    "contributing": ("CONTRIBUTING.md", "CONTRIBUTING", "contributing.md", ".github/CONTRIBUTING.md"),
}
EXAMPLE_FOLDERS = ("examples", "example", "_examples")
DRAWINGS, DRAWING_WORDS = ("png", "svg", "mermaid", "drawio", "puml"), ("architecture", "diagram", "flow", "sequence", "class", "er", "uml")
#: Files and characters of collected examples.
EXAMPLE_FILES, EXAMPLE_CHARS = 3, 10000


def well_known(listing: DataFrame, names: dict[str, tuple[str, ...]] = WELL_KNOWN) -> DataFrame:
    """The first well-known file of each kind at a repository's top: repo_id, kind, rel_path."""
    table = listing.sparkSession.createDataFrame([(k, i, n) for k, v in names.items() for i, n in enumerate(v)], "kind string, priority int, rel_path string")
    found = listing.select("repo_id", "rel_path").join(F.broadcast(table), "rel_path")
    return found.groupBy("repo_id", "kind").agg(F.min_by("rel_path", "priority").alias("rel_path"))


def has_examples(listing: DataFrame) -> DataFrame:
    """Whether a repository (repo_id, rel_path, content) has a folder of examples, or a code block in its README.md."""
    p = F.col("rel_path")
    folder = p.contains("/") & F.substring_index(p, "/", 1).isin(*EXAMPLE_FOLDERS)
    blocks = (p == "README.md") & (F.regexp_count(F.coalesce("content", F.lit("")), F.lit("(?m)^```")) >= 2)
    return listing.groupBy("repo_id").agg(F.bool_or(folder | blocks).alias("examples_present"))


def example_texts(listing: DataFrame) -> DataFrame:
    """A repository's example code, collected: the first three code files of ``examples``, else of ``example``; else the first code blocks of its README.md.

    The text is cut where the measure is defined to cut it.
    """
    name, folder = F.substring_index("rel_path", "/", -1), F.substring_index("rel_path", "/", 1)
    direct = F.size(F.split("rel_path", "/")) == 2
    code = listing.where(direct & folder.isin(*EXAMPLE_FOLDERS[:2]) & F.lower("rel_path").rlike(r"\.(go|py|ts|js)$"))
    files = code.select("repo_id", F.when(folder == "examples", 0).otherwise(1).alias("source"), name.alias("name"), F.col("content").alias("body"))
    readme = listing.where("rel_path = 'README.md'").select("repo_id", F.lit(2).alias("source"), F.posexplode(code_blocks(F.coalesce("content", F.lit("")))).alias("at", "body"))
    blocks = readme.select("repo_id", "source", F.format_string("README Example %d", F.col("at") + 1).alias("name"), "body")
    every = files.unionByName(blocks)
    best = every.groupBy("repo_id").agg(F.min("source").alias("source"))
    order = Window.partitionBy("repo_id").orderBy("name")
    few = every.join(best, ["repo_id", "source"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EXAMPLE_FILES)
    part = F.struct("rank", F.format_string("=== %s ===\n%s\n\n", "name", "body").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "")
    return few.groupBy("repo_id").agg(F.substring(joined, 1, EXAMPLE_CHARS).alias("examples"))


def has_diagram(path: Column, text: Column) -> Column:
    """A drawing by extension and a word in its name, or a diagram fence in a Markdown file."""
    name = F.lower(F.substring_index(path, "/", -1))
    drawn = name.rlike(rf"\.({'|'.join(DRAWINGS)})$") & name.rlike("|".join(DRAWING_WORDS))
    return drawn | (name.endswith(".md") & F.coalesce(text, F.lit("")).contains("```mermaid"))


def diagrams(listing: DataFrame) -> DataFrame:
    """Whether a repository has a diagram: under ``docs`` where there is such a folder, else anywhere."""
    inside = F.col("rel_path").startswith("docs/")
    hit = has_diagram(F.col("rel_path"), F.col("content"))
    both = listing.groupBy("repo_id").agg(F.bool_or(inside).alias("docs"), F.bool_or(inside & hit).alias("in_docs"), F.bool_or(hit).alias("anywhere"))
    return both.select("repo_id", F.when(F.col("docs"), F.col("in_docs")).otherwise(F.col("anywhere")).alias("diagrams_present"))
