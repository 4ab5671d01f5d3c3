"""Scalar expressions over columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Newlines plus one; an empty text has no line."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + 1)


def line_count_open(text: Column) -> Column:
    """Newlines plus one, an empty text counting as one line."""
    return F.regexp_count(text, F.lit("\n")) + 1


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def rename_target(path: Column) -> Column:
    """The new path of a rename as version control prints it: ``a/{b => c}/d`` or ``a => b``."""
    braced = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braced).otherwise(F.regexp_replace(path, r"^.* => ", ""))


def identifier_words(name: Column) -> Column:
    """Parts between underscores; without underscores, one more than the capitals after the first letter."""
    parts = F.size(F.filter(F.split(name, "_"), lambda p: p != ""))
    return F.when(name.contains("_"), parts).otherwise(F.regexp_count(F.substring(name, 2, 1 << 30), F.lit("[A-Z]")) + 1)


def strip_quotes(text: Column) -> Column:
    """A literal without one pair of surrounding quotes of any kind."""
    return F.regexp_replace(text, r"^(['\"`])(.*)\1$", "$2")


def top_module(spec: Column) -> Column:
    """The package of an import: two segments if scoped, else one."""
    return F.when(spec.startswith("@"), F.regexp_extract(spec, r"^(@[^/]+(?:/[^/]+)?)", 1)).otherwise(F.regexp_extract(spec, r"^([^/]*)", 1))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text has any of the words as a part."""
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """Half up by binary arithmetic, the same in every engine."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def shorten(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three dots if something was cut."""
    return F.when(F.length(text) <= size, text).when(F.lit(size <= 3), F.substring(text, 1, size)).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def fence_count(text: Column) -> Column:
    """Lines that open or close a code block."""
    return F.regexp_count(text, F.lit("(?m)^```"))


def comment_estimate(text: Column) -> Column:
    """Comment lines judged by their first characters, three for each pair of block marks."""
    opened, closed = (F.size(F.split(text, m, -1)) - 1 for m in (r"/\*", r"\*/"))
    return F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?://|#)")) + 3 * F.least(opened, closed)


def badge_text(text: Column) -> Column:
    """Text for a badge address: dashes and underscores doubled, the rest path-escaped."""
    doubled = F.replace(F.replace(text, F.lit("-"), F.lit("--")), F.lit("_"), F.lit("__"))
    return F.replace(F.url_encode(doubled), F.lit("+"), F.lit("%20"))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The two values in order."""
    return F.least(a, b), F.greatest(a, b)


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array, counted from zero; null if empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def interpolate(value: Column, breakpoints: Column) -> Column:
    """Piecewise-linear score of a value; clamped at both ends, 5 without breakpoints."""
    below = F.try_element_at(F.filter(breakpoints, lambda b: b["value"] < value), F.lit(-1))
    above = F.try_element_at(F.filter(breakpoints, lambda b: b["value"] >= value), F.lit(1))
    share = F.try_divide(value - below["value"], above["value"] - below["value"])
    first, last = F.try_element_at(breakpoints, F.lit(1)), F.try_element_at(breakpoints, F.lit(-1))
    return (
        F.when(F.size(breakpoints) == 0, F.lit(5.0))
        .when(below.isNull(), first["score"])
        .when(above.isNull(), last["score"])
        .otherwise(below["score"] + share * (above["score"] - below["score"]))
    )
