"""Exact dedup, near duplicates, substring dedup, and components, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm import op1_jaccard_join, op3_exact_dedup, op8_substring_dedup
from gaugeworks.llm.components import components
from gaugeworks.llm.repeats import build_filter, repeated

LOWER = {c: c + 32 for c in range(65, 91)}


def documents(n=160, seed=3):
    """Random texts with copies, near copies, shared passages and very short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    passage = [rng.choice(words) for _ in range(70)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        elif kind < 0.6:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))))
        else:
            t = [rng.choice(words) for _ in range(rng.randint(40, 220))]
            if rng.random() < 0.5:
                at = rng.randrange(len(t))
                t[at:at] = passage[rng.randint(0, 15) :]
            texts.append(" ".join(t))
    return list(enumerate(texts))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7), (5, None)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = find(u), find(v)
            label[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in label}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join_equals_brute_force(spark, words, percent):
    rows = documents()
    got = op1_jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == op1_jaccard_join.brute_force(rows, words, percent)


def test_jaccard_join_splits_hot_blocks(spark, monkeypatch):
    """Many different texts that share most words meet in tiles, and none of their links is lost."""
    monkeypatch.setattr(op1_jaccard_join, "TILE", 4)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(t)))
    got = op1_jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == op1_jaccard_join.brute_force(rows, 3, 90)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * (100 - percent) / 100]
        b = np.unique(np.r_[keep, rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(op1_jaccard_join.signatures(a, percent), op1_jaccard_join.signatures(b, percent)))


def test_rtree_finds_all_within_the_bound():
    rng = np.random.default_rng(4)
    points = rng.poisson(3, (200, 64)).astype(np.int32)
    points[100:] = np.maximum(0, points[:100] + rng.integers(-1, 2, (100, 64)) * (rng.random((100, 64)) < 0.1))
    sizes = points.sum(1)
    tree = op1_jaccard_join.RTree(points, sizes, 80)
    for q in range(0, 200, 7):
        bound = np.minimum(points, points[q]).sum(1)
        assert sorted(tree.query(points[q], int(sizes[q])).tolist()) == np.flatnonzero(180 * bound >= 80 * (sizes + sizes[q])).tolist()


def test_jaccard_join_of_awkward_rows(awkward, empty):
    got = op1_jaccard_join.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] not in (10, None)}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[5][1] == 1 and by[7][1] == by[6][1] == 6 and by[11] == (1, 11)
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] == 10) == [(1, 10), (1, 10), (4, 10)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None) == [(0, None), (3, None)]
    assert op1_jaccard_join.near_duplicates(empty).count() == 0


def test_tile_links_join_what_links_join():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (6, 90)).astype(np.uint64) << np.uint64(1)
    sets = [np.unique(np.r_[base[k % 6][: 90 - int(rng.integers(0, 12))], rng.integers(0, 1 << 63, int(rng.integers(0, 9))).astype(np.uint64)]) for k in range(70)]
    links = op1_jaccard_join.tile_links(sets, np.arange(70), np.zeros(70, bool), 80)
    assert all(op1_jaccard_join.linked(sets[i], sets[j], 80) for i, j in links)
    label = list(range(70))
    for i in range(70):
        for j in range(i):
            if op1_jaccard_join.linked(sets[i], sets[j], 80):
                label = [label[j] if x == label[i] else x for x in label]
    got = list(range(70))
    for i, j in links:
        got = [got[j] if x == got[i] else x for x in got]
    assert len(links) == 70 - len(set(label)) and all((label[i] == label[j]) == (got[i] == got[j]) for i in range(70) for j in range(i))


def test_folded_vectors_bound_the_overlap():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)) for n in (3, 60, 700, 5000)]
    sets += [np.unique(np.r_[s[: len(s) // 2], sets[-1][:300]]) for s in sets]
    vectors, sizes = [op1_jaccard_join.count_vector(s) for s in sets], np.array([len(s) for s in sets])
    vectors[1] = np.zeros(0, np.uint8)
    points = op1_jaccard_join.folded(vectors, sizes)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.minimum(points[i], points[j]).sum() >= len(np.intersect1d(a, b))


def test_near_duplicates_keep_rows_that_share_only_a_number(spark, awkward, empty):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "x"), (10, text, "x"), (10, "a text that is like no other one here", "y"), (5, text, "z"), (3, None, None), (None, text.upper(), "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    got = op1_jaccard_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted([(10, rows[2][1]), (3, None), (None, text.upper())], key=repr)
    kept = op1_jaccard_join.keep_one(awkward, 5, 80)
    assert kept.columns == awkward.columns and sorted(repr(r[0]) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, 4, 6, 8, 9, 10, 10, 11, None, None]))
    assert op1_jaccard_join.keep_one(empty, 5, 80).count() == 0


def test_near_duplicates_kept_equal_brute_force(spark, sample):
    """The pipeline's stage: of each group of the smallest tables' documents, the smallest number stays."""
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    want = op1_jaccard_join.brute_force(rows, 5, 80)
    got = [r["doc_id"] for r in op1_jaccard_join.keep_one(sample, 5, 80).select("doc_id").collect()]
    assert sorted(got) == sorted(d for d, (n, c) in want.items() if n == 0 or c == d) and len(got) < len(rows)


def exact_expected(rows):
    norm = [(d, (t or "").translate(LOWER)) for d, t in rows]
    count = Counter(t for _, t in norm)
    best = {}
    for d, t in norm:
        if t not in best or (d is not None and (best[t] is None or d > best[t])):
            best[t] = d
    return sorted(((d, best[t], count[t], d == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), key=repr)


@pytest.mark.parametrize(("block", "part"), [(3, 512), (64, 2), (4096, 1), (4096, 512)])
def test_exact_dedup(spark, awkward, block, part):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()] + [(d + 100, t) for d, t in documents(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if block == 3:
        rows = [r for r in rows if len(r[1] or "") < 2000]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op3_exact_dedup.exact_duplicates(frame, block, part).collect()
    assert sorted((tuple(r) for r in got), key=repr) == exact_expected(rows)


def test_exact_dedup_of_texts_that_share_blocks(spark):
    """Texts of one length and equal blocks in other places stay apart; frequent blocks lie in many parts."""
    rows = [(k, "".join("abcd"[k * 7 + j * j & 3] * 4 for j in range(k % 5 + 1))) for k in range(120)] + [(500 + k, "é" * 9) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op3_exact_dedup.exact_duplicates(frame, 4, 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == exact_expected(rows)


def test_exact_dedup_runs_no_python(awkward, empty):
    plan = op3_exact_dedup.exact_duplicates(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert op3_exact_dedup.exact_duplicates(empty).count() == 0
    kept = op3_exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [3, 4, 5, 7, 8, 9, 10, 10, 11]


def substring_expected(rows, window):
    words = [(-1 if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if d == -1 else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gram"), [(50, 8), (12, 4)])
def test_substring_dedup_equals_brute_force(spark, awkward, window, gram):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()] + [(d + 100, t) for d, t in documents(90, seed=9)]
    got = op8_substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window, gram, digests=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == substring_expected(rows, window)


def test_substring_dedup_keeps_columns(awkward, empty):
    got = op8_substring_dedup.keep_first(awkward)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["text"] is None and by[1]["text"].startswith("The quick") and by[7]["text"] == "" and by[6]["score"] == "score"
    assert op8_substring_dedup.keep_first(empty).count() == 0


def test_filter_loses_no_repeated_key(spark):
    rows = [(" ".join(str(k) for k in range(i, i + 40)),) for i in range(0, 4000, 25)]

    def keys_of(texts):
        for t in texts:
            yield np.unique(np.array([int(x) for x in t.split()], np.uint64))

    size, filters = build_filter(spark.createDataFrame(rows, "text string").repartition(5), keys_of, 5000)
    count = Counter(int(k) for (t,) in rows for k in t.split())
    keys = np.array(sorted(count), np.uint64)
    hit = repeated(keys, size, filters)
    assert all(h for k, h in zip(keys.tolist(), hit.tolist(), strict=True) if count[k] > 1)
    assert hit.sum() < len(keys)


def swapped(n, places):
    """Whether each place of a Thue-Morse sequence holds the second word."""
    return [bin(k).count("1") % 2 == 1 for k in range(n)][:places]


@pytest.mark.parametrize(("n", "apart"), [(1024, 1), (2048, 1), (4096, 1), (512, 40)])
def test_spans_tell_thue_morse_patterns_apart(n, apart):
    from gaugeworks.llm.shingles import hasher, spans

    def text(flip):
        return [("red" if s != flip else "blue") if k == 0 else f"f{k}" for s in swapped(n, n) for k in range(apart)]

    one, two = hasher().hashes([text(False), text(True)])
    whole = np.array([0]), np.array([n * apart])
    a, b = spans(one, *whole), spans(two, *whole)
    assert a[0] != b[0] and a[1] != b[1]
    again = hasher().hashes([["x", "y", *text(False), "z"]])[0]
    assert spans(again, np.array([2]), np.array([n * apart])) == a


def test_substring_dedup_keeps_words_no_other_document_holds(spark):
    """A passage every 40 words makes each text one run; one word in 40 is swapped in a Thue-Morse pattern."""
    passage = " ".join(f"p{k}" for k in range(8))
    rest = " ".join(f"f{k}" for k in range(31))
    rows = [(d, " ".join(f"{passage} {'red' if s != bool(d) else 'blue'} {rest}" for s in swapped(512, 512))) for d in (0, 1)]
    got = {r.doc_id: r.n_removed for r in op8_substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    windows = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in (t.split(" ") for _, t in rows)]
    covered = set()
    words = rows[1][1].split(" ")
    for i in range(len(words) - 49):
        if tuple(words[i : i + 50]) in windows[0]:
            covered |= set(range(i, i + 50))
    assert got == {0: 0, 1: len(covered)}
