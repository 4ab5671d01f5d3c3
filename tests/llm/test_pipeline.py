"""The pipeline as a whole against a plain version, on the smallest documents and awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import op1_jaccard_join, op9_toxicity
from gaugeworks.llm.shingles import words_of
from gaugeworks.llm.wordbpe import default_path

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
#: A null number sorts before all others.
LAST = -(1 << 63)


def plain_pipeline(rows, rejected):
    """(doc_id, text) of what is left to pack, stage by stage."""
    rows = [(LAST if d is None else d, t) for d, t in rows if (d, t) not in rejected]
    best = {}
    for d, t in rows:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, d), d)
    once = {(d, (t or "").translate(LOWER)): (d, t) for d, t in rows if best[(t or "").translate(LOWER)] == d}
    rows = list(once.values())
    # Rows, not numbers, are documents: near duplicates by place.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], k))
    numbered = [(n, rows[k][1]) for n, k in enumerate(order)]
    found = op1_jaccard_join.brute_force(numbered, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    rows = [rows[k] for n, k in enumerate(order) if found[n][0] == 0 or found[n][1] == n]
    first = {}
    for d, t in rows:
        w = words_of(t or "")
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words_of(t or "")
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((None if d == LAST else d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def folder_of(frame, labels, path):
    frame.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_a_plain_version(spark, awkward, tmp_path):
    """All documents of the smallest table, awkward rows, repeats, and further columns with clashing names."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", *(F.lit("x").alias(c) for c in awkward.columns[3:]))
    # The awkward numbers lie beyond those of the table, but for the null one.
    frame = docs.unionByName(awkward.withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(docs.where("doc_id % 40 = 1"))
    sf = folder_of(frame.repartition(5), spark.read.parquet(f"{SF}/labels.parquet"), tmp_path / "all")
    judged = op9_toxicity.query(spark, sf).join(frame.select("doc_id", "text"), "doc_id").where("predicted = 1").select("doc_id", "text").distinct().collect()
    rejected = {(r["doc_id"], r["text"]) for r in judged}
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    assert rejected and all(sum(d == r for d, _ in {x for x in rows}) == 1 for r, _ in rejected)

    library = Tokenizer.from_file(default_path())
    left = plain_pipeline(rows, rejected)
    want = sorted((repr(d), zlib.crc32(np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in left)
    pieces = corpus_pipeline.run(spark, sf).collect()
    tokens = {}
    for p in pieces:
        tokens.setdefault(repr(p["doc_id"]), 0)
        tokens[repr(p["doc_id"])] += p["length"]
    expected = {}
    for d, _, n in want:
        expected[d] = expected.get(d, 0) + n
    assert tokens == expected
    whole = sorted((repr(p["doc_id"]), p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["length"] == p["doc_tokens"])
    assert whole and set(whole) <= set(want)
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    assert len(left) < len(rows)


@pytest.mark.parametrize("kind", ["none", "empty texts", "one number"])
def test_run_on_little(spark, awkward, tmp_path, kind):
    """No row, rows without words, and rows that all share one number and text."""
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = {"none": [], "empty texts": [(1, None), (None, ""), (3, "  ")], "one number": [(None, "the same words again and again")] * 5}[kind]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, row string, score string")
    got = corpus_pipeline.run(spark, folder_of(frame, labels, tmp_path / "little")).collect()
    documents = sum(p["length"] / p["doc_tokens"] for p in got)  # tails are cut to powers of two
    assert documents == pytest.approx({"none": 0, "empty texts": 2, "one number": 1}[kind])
