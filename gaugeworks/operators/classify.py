"""Languages, file classes and exclusion rules of a file listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions, pruned folders, and the marker of generated files.
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript"}
PRUNED = ("vendor", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", "target", "testdata")
GENERATED = r"(?m)^// Code generated .* DO NOT EDIT\.$"


def language(path: Column) -> Column:
    """The language of a file by its extension; null if none is known."""
    out = F.lit(None).cast("string")
    for end, name in LANGUAGES.items():
        out = F.when(path.endswith(end), F.lit(name)).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_vendor(path: Column) -> Column:
    """Whether any component of the path is ``vendor``."""
    return F.array_contains(F.split(path, "/"), "vendor")


def pruned(path: Column, names: tuple[str, ...] = PRUNED) -> Column:
    """Whether a folder of the path is hidden or one of the names that are never entered."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.exists(folders, lambda f: f.startswith(".") | f.isin(*names))


def is_generated(text: Column) -> Column:
    """Whether the marker stands before the package clause."""
    return F.element_at(F.split(text, r"(?m)^package "), 1).rlike(GENERATED)


def class_by_name(path: Column, lang: Column) -> Column:
    """source, test or excluded by the file's name."""
    name = base_name(path)
    hidden = name.startswith("_") | name.startswith(".")
    low = F.lower(name)
    go = F.when(hidden, "excluded").when(name.endswith("_test.go"), "test").otherwise("source")
    python = F.when(hidden, "excluded").when((name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py"), "test").otherwise("source")
    script = F.when(low.rlike(r"\.(test|spec)\.tsx?$"), "test").otherwise("source")
    return F.when(lang == "go", go).when(lang == "python", python).otherwise(script)


def is_test_path(path: Column, lang: Column) -> Column:
    """The analyzers' own test predicate, which also looks at folders and fixtures."""
    name, low = base_name(path), F.lower(path)
    python = name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")
    script = low.rlike(r"\.(test|spec)\.[jt]sx?$") | low.contains("__tests__/")
    return F.when(lang == "go", name.endswith("_test.go")).when(lang == "python", python).otherwise(script)


def classify(files: DataFrame, ignored: Column | None = None) -> DataFrame:
    """``files`` (repo_id, rel_path, content) with language, class and exclude_reason.

    The first rule that applies wins: vendor, ignore file, generated (Go only),
    then the name. Rows of unknown language are dropped.
    """
    path, lang = F.col("rel_path"), F.col("language")
    listed = files.withColumn("language", language(path)).where("language is not null")
    ignore = F.coalesce(ignored, F.lit(False)) if ignored is not None else F.lit(False)
    made = (lang == "go") & is_generated(F.col("content").cast("string"))
    reason = F.when(in_vendor(path), "vendor").when(ignore, "gitignore").when(made, "generated")
    kind = F.when(in_vendor(path) | ignore, "excluded").when(made, "generated").otherwise(class_by_name(path, lang))
    return listed.withColumn("class", kind).withColumn("exclude_reason", reason)


def scan_counters(classified: DataFrame) -> DataFrame:
    """Files by repository, language and class, with subtotals."""
    return classified.rollup("repo_id", "language", "class").agg(F.count("*").alias("files"))


def discovery_counters(classified: DataFrame) -> DataFrame:
    """What a scan of a repository found: all files of known languages, and those of each class and reason."""
    c, r = F.col("class"), F.col("exclude_reason")
    counts = {"source": c == "source", "test": c == "test", "generated": c == "generated", "vendor": r.eqNullSafe(F.lit("vendor")), "ignored": r.eqNullSafe(F.lit("gitignore"))}
    return classified.groupBy("repo_id").agg(F.count("*").alias("total"), *[F.count_if(v).alias(k) for k, v in counts.items()])


def source_files(files: DataFrame) -> DataFrame:
    """Files (rel_path, language) that the analyzers' test predicate does not name as tests."""
    return files.where(~is_test_path(F.col("rel_path"), F.col("language")))


def ignore_pattern(line: str) -> tuple[bool, str] | None:
    """One line of an ignore file as (negated, regular expression over relative paths); null for blanks and comments."""
    line = line.rstrip("\n")
    line = line.rstrip() if not line.endswith("\\ ") else line[:-2] + " "
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated or line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    body = line.strip("/") if folder else line.lstrip("/")
    anchored = line.startswith("/") or "/" in body
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inside = body[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return negated, f"^{'' if anchored else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.+)?'}$"


def ignored_by(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file excludes a path; later lines override earlier ones."""
    out = F.lit(False)
    for got in filter(None, map(ignore_pattern, lines)):
        out = F.when(path.rlike(got[1]), F.lit(not got[0])).otherwise(out)
    return out


def ignore_rules(lines: DataFrame) -> DataFrame:
    """Ignore files as data: rules (repo_id, place, negated, folder, anchored, glob, body, pattern) from their lines
    (repo_id, line_no, line). Blank lines and comments give none; a later place overrides an earlier one."""
    bare = F.regexp_replace("line", r"[\r\n]+$", "")
    rows = lines.select("repo_id", F.col("line_no").alias("place"), bare.alias("bare"))
    rows = rows.withColumn("bare", F.when(F.col("bare").endswith("\\ "), F.expr("concat(substring(bare, 1, length(bare) - 2), ' ')")).otherwise(F.rtrim("bare")))
    rows = rows.where("bare != '' and not startswith(bare, '#')").withColumn("negated", F.col("bare").startswith("!"))
    marked = F.col("negated") | F.col("bare").startswith("\\#") | F.col("bare").startswith("\\!")
    rows = rows.withColumn("bare", F.when(marked, F.expr("substring(bare, 2)")).otherwise(F.col("bare"))).withColumn("folder", F.col("bare").endswith("/"))
    rows = rows.withColumn("body", F.when(F.col("folder"), F.regexp_replace("bare", "^/+|/+$", "")).otherwise(F.regexp_replace("bare", "^/+", "")))
    rows = rows.withColumn("anchored", F.col("bare").startswith("/") | F.col("body").contains("/")).withColumn("glob", F.col("body").rlike(r"[*?\[\\]"))

    def piece(token: Column) -> Column:
        """A piece of a pattern as a regular expression over paths."""
        inside = F.regexp_replace(F.regexp_replace(token, r"^\[!", "[^"), r"\\", r"\\\\")
        out = F.when(token == "**/", "(?:.*/)?").when(token == "**", ".*").when(token == "*", "[^/]*").when(token == "?", "[^/]")
        return out.when(token.rlike(r"^\[.+\]$"), inside).otherwise(F.concat(F.lit("\\Q"), token, F.lit("\\E")))

    tokens = F.regexp_extract_all("body", F.lit(r"(\*\*/|\*\*|\*|\?|\[[^\]][^\]]*\]|[^*?\[]+|\[)"), 1)
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(tokens, piece), ""), F.lit("$"))
    return rows.select("repo_id", "place", "negated", "folder", "anchored", "glob", "body", pattern.alias("pattern"))


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, rel_path, ignored) of each distinct path: by the last rule of its repository that fits the path or one
    of its folders.

    Each path is listed with its folders; rules without wildcards meet them by an equi-join on the folder (or its
    name), the few others by repository and expression, and the last place is a grouped maximum. Rules are a table
    like any other: no expression grows with them.
    """
    paths = files.select("repo_id", "rel_path").distinct()
    parts = F.split("rel_path", "/")
    each = paths.select("repo_id", "rel_path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    upto = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/")
    forms = F.explode(F.array(F.struct(F.lit(True).alias("anchored"), upto.alias("subject")), F.struct(F.lit(False).alias("anchored"), F.get("parts", F.col("k") - 1).alias("subject"))))
    subjects = each.select("repo_id", "rel_path", (F.col("k") == F.size("parts")).alias("whole"), forms.alias("s")).select("repo_id", "rel_path", "whole", "s.*")
    plain = rules.where("not glob").select("repo_id", "anchored", F.col("body").alias("subject"), "folder", "negated", "place")
    fits = subjects.join(plain, ["repo_id", "anchored", "subject"])
    globs = rules.where("glob").select("repo_id", "anchored", "pattern", "folder", "negated", "place")
    wild = subjects.join(globs, ["repo_id", "anchored"]).where(F.rlike("subject", F.col("pattern")))
    keep = ["repo_id", "rel_path", "whole", "folder", "negated", "place"]
    met = fits.select(*keep).unionByName(wild.select(*keep)).where("not (whole and folder)")
    last = met.groupBy("repo_id", "rel_path").agg((~F.max_by("negated", "place")).alias("ignored"))
    return paths.join(last, ["repo_id", "rel_path"], "left").select("repo_id", "rel_path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
