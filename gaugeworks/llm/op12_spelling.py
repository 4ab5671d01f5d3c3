"""Spelling variants grouped by asymmetric q-chunks.

Words are runs of Latin letters, A-Z lower-cased. To plant slips at a known
rate, an occurrence loses one letter where a checksum of its document and run
says so; what then stands in the text often enough, and is long enough, is a
word. Two words are near if one letter is put in, taken out or exchanged.

Search. The asking word contributes two disjoint chunks, its first and its last
half; the answering word contributes positional grams as long as the chunks of
every length that a near word can have. One edit spoils one chunk at most, so
the other stands whole in the answering word: a first chunk in its place, a last
chunk shifted by the difference of the lengths, which is one at most. So no
shift but these two is asked for. A chunk alone is common to very many short
words; the edit also leaves alone one half of the rest of the asking word, so
the key is the chunk and that half together, at their places. Words meet by
these keys in one equi-join, and each meeting is verified by edit distance.

A word has at most some hundred near words for each of its letters (the letters
are few), so whatever the text, the pairs grow with the words only. Occurrences
are counted before they move, so a word of any frequency is one row a task. A
word's form is its near word of largest count where that is large enough, and
forms are followed to the root by doubling pointers; counts grow tenfold at each
step, so the number of rounds is that of the digits of the largest count, halved
again and again.

Defined results: null and empty texts have no words; a null doc_id stands as
empty text in the checksum; repeated rows count each; of near words with equal
counts the first in code-point order is the form; very long texts are read
whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.runtime import materialise, release, table, text_of

#: Letters, and one occurrence in so many loses a letter.
LETTERS, SLIPS = "A-Za-zÀ-ÿ", 31
#: Code points and occurrences of a word at least; how many times the count of a word its form must have.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH, slips: int = SLIPS) -> DataFrame:
    """One ``word`` for each run of ``least`` letters or more, after its slip."""
    low = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(F.translate("text", _UPPER, _LOWER))
    # Greedy from its first letter on, a match is a maximal run; shorter runs can't become words.
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    number = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    found = docs.select(number.alias("number"), text_of().alias("text")).select("number", F.explode(runs).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("number", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word"))


def counted_words(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    found = occurrences(docs, least, slips).groupBy("word").agg(F.count("*").alias("n"))
    return found.where((F.col("n") >= count) & (F.length("word") >= least))


def keys_of(words: DataFrame, least: int) -> DataFrame:
    """The keys (key, word, n, asks) of each word: for its own length those with which it asks, and for each
    length within one those with which it answers. Lengths below ``least`` have no words to answer."""
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda x: x >= least)
    rows = words.select("word", "n", F.explode(lengths).alias("length"))
    # Ends of the two chunks and of their halves, in an asking word of that length.
    half = F.expr("length div 2")
    cuts = F.array(F.lit(0), F.expr("length div 4"), half, half + F.expr("(length - length div 2) div 2"), F.col("length"))
    rows = rows.select("word", "n", "length", (size - F.col("length")).alias("shift"), cuts.alias("cuts"), F.explode(F.array(*map(F.lit, range(4)))).alias("edited"))
    # The quarter with the edit is left out: one chunk and half of the other remain.
    begin, end = F.get("cuts", F.col("edited")), F.get("cuts", F.col("edited") + 1) + F.col("shift")
    key = F.xxhash64("length", "edited", F.substring("word", F.lit(1), begin), F.substring("word", end + 1, size))
    return rows.select(key.alias("key"), "word", "n", (F.col("shift") == 0).alias("asks"))


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, once, dealt by word."""
    keys = materialise(keys_of(words, least))
    asking = keys.where("asks").select("key", "word")
    answering = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = asking.join(answering.hint("merge"), "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    # Dealt by the word, repeats of a pair and the pairs of a word lie together.
    return met.select("word", "near", "near_n").repartition("word").dropDuplicates(["word", "near"])


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to their end."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        moved = after.where("moved").head(1)
        release(now)
        now = after.select("word", "root")
        if not moved:
            return now


def variants(words: DataFrame, least: int = LEAST_LENGTH, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of ``words`` (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nears = near_pairs(words, least).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.less") >= times * F.col("n")
    joined = words.join(nears, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).cast("long").alias("form_n"),
    )
    found = materialise(joined)
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(materialise(counted_words(table(spark, sf_dir, "documents"))))


def brute_force(rows: list[tuple[int | None, str | None]], least: int = LEAST_LENGTH, count: int = LEAST_COUNT, times: int = FORM_TIMES) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n) by comparing each word with all; for tests on small tables."""
    n: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % SLIPS == 0 else run] += 1
    n = Counter({w: k for w, k in n.items() if k >= count and len(w) >= least})

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    form: dict[str, str] = {}
    nears = {}
    for w in n:
        met = [v for v in n if near(w, v)]
        nears[w] = len(met)
        if met and n[best := min(met, key=lambda v: (-n[v], v))] >= times * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], nears[w], n[form[w]] if w in form else None)
    return out
