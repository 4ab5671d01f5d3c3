"""Names, numbers and strictness of code: predicates over facts (one row a name, number or file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations that are names of their own, and numbers that need no name, by language.
ACRONYMS = (
    "ID", "URL", "HTTP", "HTTPS", "API", "JSON", "XML", "SQL", "HTML", "CSS", "DNS", "EOF", "IP", "TCP",
    "UDP", "TLS", "SSL", "SSH", "RPC", "CPU", "GPU", "RAM", "ROM", "OS", "IO", "DB", "UI", "OK",
)
PLAIN_NUMBERS = {
    "go": ("0", "1", "0.0", "1.0", "2", "0x0", "0x1"),
    "python": ("0", "1", "-1", "2", "100", "0.0", "1.0"),
    "typescript": ("0", "1", "-1", "0.0", "1.0"),
}


def is_snake(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$")


def is_upper(name: Column) -> Column:
    return name.rlike(r"^[A-Z][A-Z0-9_]*$")


def is_camel(name: Column) -> Column:
    """Whether the first letter is a capital."""
    return name.rlike(r"^\p{Lu}")


def go_name_counts(name: Column) -> Column:
    """Whether a Go name is judged: not blank, longer than a letter, no abbreviation."""
    return (F.length(name) > 1) & ~name.isin(*ACRONYMS)


def go_name_fits(name: Column, exported: Column) -> Column:
    """Exported names begin with a capital, others with a small letter or underscore; no later underscore but in tests."""
    first = F.when(exported, name.rlike(r"^\p{Lu}")).otherwise(name.rlike(r"^[\p{Ll}_]"))
    inner = F.substring(name, 2, 1 << 30).contains("_") & ~name.rlike("^[Tt]est")
    return (F.length(name) == 0) | (first & ~inner)


def python_name_counts(name: Column, kind: Column) -> Column:
    """Functions and classes with more than a letter; functions with doubled underscores at both ends are not judged."""
    dunder = name.startswith("__") & name.endswith("__")
    return (F.length(name) > 1) & ((kind == "class") | ((kind == "function") & ~dunder))


def python_name_fits(name: Column, kind: Column) -> Column:
    return F.when(kind == "class", is_camel(name)).otherwise(is_snake(name))


def naming_consistency(names: DataFrame, counts: Column, fits: Column, unjudged: float = 0.0) -> DataFrame:
    """Judged and fitting names of each repository, and their percentage; ``unjudged`` where none is judged, which
    is 100 by the rules for Go and 0 by those for Python."""
    out = names.groupBy("repo_id").agg(F.count_if(counts).alias("judged"), F.count_if(counts & fits).alias("fitting"))
    return out.withColumn("naming_consistency", F.coalesce(F.try_divide(F.col("fitting") * 100.0, F.col("judged").cast("double")), F.lit(unjudged)))


def is_magic(language: Column, value: Column, in_const: Column, target: Column, subscript: Column) -> Column:
    """Whether a number should have a name: rules by language.

    ``in_const``: in a constant declaration (or an enumeration); ``target``: the
    nearest name assigned to; ``subscript``: an index.
    """
    go = ~value.isin(*PLAIN_NUMBERS["go"]) & ~in_const
    python = ~value.isin(*PLAIN_NUMBERS["python"]) & ~F.coalesce(is_upper(target), F.lit(False)) & ~subscript
    script = ~value.isin(*PLAIN_NUMBERS["typescript"]) & ~in_const
    return F.when(language == "go", go).when(language == "python", python).otherwise(script)


def strict_config(text: Column) -> Column:
    """(strict, null_checks) of a compiler configuration: the switch for all, or its three parts; text that is not JSON is not strict."""
    o = F.from_json(text, "compilerOptions struct<strict:boolean,strictNullChecks:boolean,noImplicitAny:boolean,strictFunctionTypes:boolean>")["compilerOptions"]
    on = {k: F.coalesce(o[k], F.lit(False)) for k in ("strict", "strictNullChecks", "noImplicitAny", "strictFunctionTypes")}
    every = on["strictNullChecks"] & on["noImplicitAny"] & on["strictFunctionTypes"]
    return F.struct((on["strict"] | every).alias("strict"), (on["strict"] | on["strictNullChecks"]).alias("null_checks"))


def type_checker(listing: DataFrame) -> DataFrame:
    """Whether a repository's top (repo_id, rel_path, content) configures a Python type checker."""
    p, t = F.col("rel_path"), F.coalesce(F.col("content"), F.lit(""))
    found = p.isin("mypy.ini", ".mypy.ini", "pyrightconfig.json") | ((p == "setup.cfg") & t.contains("[mypy]")) | ((p == "pyproject.toml") & (t.contains("[tool.mypy]") | t.contains("[tool.pyright]")))
    return listing.groupBy("repo_id").agg(F.bool_or(found).alias("type_checker"))


def project_languages(listing: DataFrame) -> DataFrame:
    """Languages that a repository's top folder shows, by marker files, extensions or a dependency."""
    p, t = F.col("rel_path"), F.col("content")
    top = ~p.contains("/")
    deps = F.from_json(F.when(p == "package.json", t), "dependencies map<string,string>, devDependencies map<string,string>")
    has = F.coalesce(F.map_contains_key(deps["dependencies"], "typescript"), F.lit(False)) | F.coalesce(F.map_contains_key(deps["devDependencies"], "typescript"), F.lit(False))
    go = p.rlike(r"^go\.mod$|\.go$")
    python = p.isin("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt") | p.endswith(".py")
    script = (p == "tsconfig.json") | p.endswith(".ts") | has
    return listing.groupBy("repo_id").agg(*[F.bool_or(top & c).alias(n) for n, c in (("go", go), ("python", python), ("typescript", script))])


def mean_of_positive(rows: DataFrame, value: str) -> DataFrame:
    """A repository's mean over the languages whose value is above 0; 0 where none is."""
    return rows.groupBy("repo_id").agg(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias(value))
