"""Repeated passages, found by a count-min prefilter and an exact second pass.

A window is ``window`` consecutive words. The word covered by a window whose
words also start in a document with a smaller doc_id is removed.

First pass. A window's sketch key is the smallest hash among its ``gram``-word
sequences: equal windows have equal keys, and neighbouring windows mostly share
one, so a document adds about a twentieth as many keys as it has windows. Each
partition counts its documents' keys in a count-min sketch (two rows), sent as
the touched counters only; the partitions' sketches are merged by slices of
counters, and reduced to one bit a counter: counted twice or more. A key's
estimate is never below the number of documents that hold such a window.

Second pass. Only windows whose key is estimated repeated go on, and equal
windows are grouped exactly, by two independent 64-bit hashes of their words.
Consecutive windows with one key form a run. A run that also lies in an earlier
document goes as a whole; of each distinct run the earliest holder stays, and
where one key has several distinct runs, their windows are grouped one by one.
The earliest document that holds a window always takes part, so none is lost.

The sketch has at most ``repeats.MAX_COUNTERS`` counters, so what is broadcast is at
most 64 MB; a corpus beyond its capacity gets a weaker filter and the same
result, the exact pass growing in proportion to the corpus. A hot passage meets
map-side minima and joins that adaptive execution can split.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing; rows that repeat a doc_id do not remove each other's
words; a null doc_id is smaller than any; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.repeats import build_filter, repeated
from gaugeworks.llm.runtime import bound_batches, materialise, release, strings, sweep, table, text_of
from gaugeworks.llm.shingles import hasher, mix, sliding_min, spans, words_of

WINDOW, GRAM = 50, 8
CALL = 64
_NULL_ID = -(1 << 63)


def window_keys(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The sketch key of each window."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(mix(hasher().rolling(hashes, gram, 0)), window - gram + 1)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id (null as the smallest number), a hash of the text to tell repeated numbers apart, the text."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    return docs.select(number.alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, ranges): for documents that lose words, the windows they lose as (first window, number)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _identified(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def keys_of(texts: list[str]) -> Iterator[np.ndarray]:
        for words in hasher().hashes([words_of(t) for t in texts]):
            yield np.unique(window_keys(words, window, gram))

    sent = spark.sparkContext.broadcast(build_filter(rows.select("text"), keys_of, chars // (3 * (window - gram))))

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bitmaps = sent.value
        for batch in batches:
            texts = strings(batch.column(2))
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for at in range(0, len(texts), CALL):
                for k, words in enumerate(hasher().hashes([words_of(t) for t in texts[at : at + CALL]]), at):
                    keys = window_keys(words, window, gram)
                    if not len(keys):
                        continue
                    start = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
                    start, length = start, np.diff(np.r_[start, len(keys)])
                    keep = repeated(keys[start], n, bitmaps)
                    start, length = start[keep], length[keep]
                    if not len(start):
                        continue
                    for c, x in zip(cols, (keys[start], *spans(words, start, length + window - 1), np.full(len(start), ids[k]), np.full(len(start), hs[k]), start.astype(np.int32), length.astype(np.int32)), strict=True):
                        c.append(x)
            if cols[0]:
                key, a, b, doc, h, first, length = (np.concatenate(c) for c in cols)
                yield pa.record_batch([_signed(key), _signed(a), _signed(b), pa.array(doc), pa.array(h), pa.array(first), pa.array(length)], ["key", "a", "b", "doc_id", "h", "start", "n"])

    runs = materialise(rows.mapInArrow(find_runs, "key long, a long, b long, doc_id long, h long, start int, n int"))
    first = materialise(runs.groupBy("key", "a", "b").agg(F.min("doc_id").alias("first")))
    mixed = first.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1").select("key")
    mixed = materialise(mixed)
    judged = runs.join(first, ["key", "a", "b"])
    whole = judged.where("doc_id > first").select("doc_id", "h", "start", "n")
    open_runs = judged.where("doc_id = first").join(mixed, "key", "left_semi")
    # A document's own runs: bounded by its length, however often its row is repeated.
    sweep(spark)
    opened = materialise(open_runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("runs")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs_of = strings(batch.column(2)), batch.column(3).to_pylist()
            for at in range(0, len(texts), CALL):
                cols: list[list[np.ndarray]] = [[] for _ in range(5)]
                for k, words in enumerate(hasher().hashes([words_of(t) for t in texts[at : at + CALL]]), at):
                    at_ = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs_of[k]]))
                    a, b = (hasher().rolling(words, window, lane)[at_] for lane in (0, 1))
                    for c, x in zip(cols, (a, b, np.full(len(at_), batch.column(0)[k].as_py()), np.full(len(at_), batch.column(1)[k].as_py()), at_.astype(np.int32)), strict=True):
                        c.append(x)
                if cols[0]:
                    a, b, doc, h, pos = (np.concatenate(c) for c in cols)
                    yield pa.record_batch([_signed(a), _signed(b), pa.array(doc), pa.array(h), pa.array(pos)], ["a", "b", "doc_id", "h", "start"])

    involved = rows.join(opened.hint("merge"), ["doc_id", "h"]).select("doc_id", "h", "text", "runs")
    windows = materialise(involved.mapInArrow(expand, "a long, b long, doc_id long, h long, start int"))
    sweep(spark)
    earliest = materialise(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first")))
    single = windows.join(earliest, ["a", "b"]).where("doc_id > first").select("doc_id", "h", "start", F.lit(1).alias("n"))
    out = materialise(whole.unionByName(single).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("ranges")))
    for done in (runs, first, opened, windows, earliest):
        release(done)
    sweep(spark)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (or their SHA-256).

    ``keep`` names columns of ``docs`` that come along unchanged.
    """
    ranges = removed_ranges(docs, window, gram)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    rows = docs.select(number.alias("doc_id"), text_of().alias("text"), F.struct(F.lit(0).alias("none"), *keep).alias("more"))
    joined = rows.withColumn("h", F.xxhash64("text")).join(ranges.hint("merge"), ["doc_id", "h"], "left")
    more_type = joined.schema["more"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for text, lost in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                counts.append(len(words))
                if lost:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in lost:
                        edge[r["start"]] += 1
                        edge[r["start"] + r["n"] + window - 1] -= 1
                    cover = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    gone.append(int(cover.sum()))
                else:
                    gone.append(0)
                value = " ".join(words)
                kept.append(hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest() if digests else value)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), batch.column(3)], ["doc_id", "n_words", "n_removed", "kept", "more"])

    schema = f"doc_id long, n_words long, n_removed long, kept string, more {more_type}"
    out = joined.select("doc_id", "text", "ranges", "more").mapInArrow(run, schema)
    number_back: Column = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id"))
    return out.select(number_back.alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digests else "kept_text"), *[f"more.{c}" for c in keep])


def keep_first(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars`` (if there is one) made true.

    Texts that lose nothing stay as they are, white space included.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = remove_repeats(whole, window, keep=("row",))
    lost = F.col("n_removed") > 0
    new = {c: F.col("row")[c] for c in docs.columns}
    new["text"] = F.when(lost, F.col("kept_text")).otherwise(new["text"])
    if "n_chars" in new:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast("long")).otherwise(new["n_chars"])
    return found.select(*[v.alias(c) for c, v in new.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
