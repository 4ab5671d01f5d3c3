"""Shards of the hash tree, spelling variants and aligned tokenizers against plain versions."""

import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import op11_sharding as op11
from gaugeworks.llm import op12_spelling as op12
from gaugeworks.llm import op13_alignment as op13
from gaugeworks.llm.wordbpe import default_path

PATHS = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")


# --- op11


def plain_shard(key, shards):
    """The descent for one row."""

    def draw(name, weight):
        u = xxhash.xxh64_intdigest(f"{key}|{name}".encode(), seed=42) >> 11
        return -math.log((u + 0.5) / 2**53) / weight

    def weigh(some):
        return sum(s.weight for s in some)

    regions = {}
    for s in shards:
        regions.setdefault(f"region {s.region}" if s.region else f"shard {s.number}", []).append(s)
    inside = regions[min(regions, key=lambda r: draw(r, weigh(regions[r])))] if len(regions) > 1 else shards
    racks = {}
    for s in inside:
        racks.setdefault(s.rack, []).append(s)
    inside = racks[min(racks, key=lambda r: draw(f"rack {r}", weigh(racks[r])))] if len(racks) > 1 else inside
    return min(inside, key=lambda s: draw(f"shard {s.number}", s.weight)).number if len(inside) > 1 else inside[0].number


def shards_of(spark, shards, n=3000):
    rows = op11.descended(spark.range(n).withColumn("key", F.col("id").cast("string")), shards, "shard")
    return dict(rows.select("id", "shard").collect())


def test_tree_equals_a_plain_descent(spark):
    shards = [s._replace(weight=1.0 + s.number % 3) for s in op11.founded(11, 2, 3)]
    for tree in (shards, op11.grown(shards), op11.founded(1), [op11.Shard(4, None), op11.Shard(2, "a", "b")]):
        assert shards_of(spark, tree, 400) == {k: plain_shard(str(k), tree) for k in range(400)}


@pytest.mark.parametrize("count", [1, 7, 8, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, count):
    before, after = shards_of(spark, op11.founded(count)), shards_of(spark, op11.grown(op11.founded(count)))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {count}
    assert abs(len(moved) - 3000 / (count + 1)) < 5 * math.sqrt(3000 / (count + 1))


def test_growth_can_go_on(spark):
    twice = op11.grown(op11.grown(op11.founded(5)))
    once, both = shards_of(spark, twice[:-1]), shards_of(spark, twice)
    assert {both[k] for k in both if both[k] != once[k]} == {6}


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    shards = op11.founded(24, 2, 4)  # three regions
    heavier = [s._replace(weight=3.0) if s.number == 9 else s for s in shards]
    before, after = shards_of(spark, shards), shards_of(spark, heavier)
    region = {s.number: s.region for s in shards}
    rack = {s.number: s.rack for s in shards}
    for k in (k for k in before if before[k] != after[k]):
        assert region[after[k]] == region[9]  # a subtree that got heavier loses no row to another
        if region[before[k]] == region[9] and rack[before[k]] != rack[after[k]]:
            assert rack[after[k]] == rack[9]
        if rack[before[k]] == rack[after[k]]:
            assert after[k] == 9
    assert sum(after[k] == 9 for k in after) > 1.8 * sum(before[k] == 9 for k in before)


def test_weights_are_shares(spark):
    shards = [s._replace(weight=float(1 + s.number % 4)) for s in op11.founded(8, 2, 2)]
    got = shards_of(spark, shards, 8000)
    for s in shards:
        want = 8000 * s.weight / 20
        assert abs(sum(v == s.number for v in got.values()) - want) < 5 * math.sqrt(want)


def test_trees_are_checked():
    for bad in ([], [op11.Shard(1, None), op11.Shard(1, None)], [op11.Shard(1, "a")], [op11.Shard(1, None, None, 0.0)], [op11.Shard(1, "a", "r"), op11.Shard(2, "b", "r")]):
        with pytest.raises(ValueError):
            op11._checked(bad)


def assigned_as_expected(got, rows, shards):
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_shard(key, shards), plain_shard(key, op11.grown(shards)))
    raw = sorted(((d is not None, d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id), r["size"], r.text_crc32) for r in got) == raw
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        numbers = [(r.doc_id is not None, r.doc_id) for r in own]
        assert numbers == sorted(numbers)


def test_sharding_of_awkward_rows(spark, awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    shards = op11.founded(5)
    assigned_as_expected(op11.assigned(awkward, shards, op11.grown(shards)).collect(), rows, shards)
    assert op11.assigned(empty, shards).count() == 0
    assert {r.grown_shard for r in op11.assigned(awkward, shards).collect()} == {None}


def test_slots_where_one_number_has_half_of_the_rows(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(7)
    got = op11.assigned(docs, op11.founded(3)).collect()
    for shard in range(3):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


# --- op12

NEAR = "straßenbahn straßenbahn straßenbahm straßenbahm straßenbahnx straßenbahnx straenbahn straenbahn "


def spelled(df, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12.variants(df, **more).collect()}


def test_spelling_equals_brute_force(spark, sample):
    rows = [tuple(r) for r in sample.orderBy("doc_id").select("doc_id", "text").limit(50).collect()]
    rows += [(None, NEAR), (7, NEAR * 3), (7, NEAR * 3), (8, "aaaaaaa aaaaaaaa aaaaaaaaa " * 4), (9, "ÀÉÎõüÿ×÷ " * 3 + "Straßenbahn" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = op12.brute_force(rows)
    assert len(want) > 250 and sum(v[3] for v in want.values()) > 20
    assert spelled(op12.counted_words(docs)) == want


def test_every_single_edit_is_found(spark):
    """All deletions, exchanges and insertions of words of every length, at every place."""
    words = {}
    for base in ("abcdefg", "abcdefgh", "abcdefghi", "aabbaabbaab", "aaaaaaaaaaaa"):
        words[base] = 100
        for k in range(len(base) + 1):
            for edited in (base[:k] + base[k + 1 :], base[:k] + "z" + base[k + 1 :], base[:k] + "z" + base[k:], base[:k] + "a" + base[k:]):
                if len(edited) >= 7:
                    words.setdefault(edited, 2 + k % 3)
    got = {r.word: r.n_near for r in op12.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    assert got == {w: sum(near(w, v) for v in words) for w in words}


def test_forms_lead_to_roots_and_ties_go_by_code_points(spark):
    chain = {"abcdefg": 100_000, "abcdefh": 10_000, "abcdeih": 1000, "abcdjih": 100, "abckjih": 10, "ablkjih": 1, "zzzzzzy": 50, "zzzzzzx": 50, "zzzzzzz": 5, "éééééééz": 30, "éééééééa": 3}
    got = spelled(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert got["ablkjih"] == ("abckjih", "abcdefg", 1, 1, 10)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 5, 2, 50)
    assert got["zzzzzzy"] == (None, "zzzzzzy", 50, 2, None)
    assert got["éééééééa"] == ("éééééééz", "éééééééz", 3, 1, 30)


def test_spelling_of_awkward_rows(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert spelled(op12.counted_words(awkward)) == op12.brute_force(rows)
    assert spelled(op12.counted_words(empty)) == {}


def test_words_that_share_a_chunk_meet_by_more_than_that(spark):
    """All words share their first half; those that meet also share half of the rest."""
    letters = F.translate(F.lpad(F.conv(F.col("id"), 10, 5), 6, "0"), "01234", "abcde")
    words = spark.range(5**5).select(F.concat(F.lit("common"), letters).alias("word"), F.lit(5).cast("long").alias("n"))
    most = op12.keys_of(words, 7).where("asks").groupBy("key").count().agg(F.max("count")).first()[0]
    assert most == 5**3
    assert op12.variants(words).agg(F.sum("n_near")).first()[0] == 5**5 * 5 * 4


# --- op13


def aligned(df, block=300_000):
    return sorted((tuple(r) for r in op13.alignments(df, *PATHS, block).collect()), key=repr)


def plain(rows):
    return sorted(op13.brute_force(rows, *PATHS), key=repr)


ODD = [(-1, ""), (None, None), (-2, " "), (-3, "\n\n a  b\n c\t\td ▁x <s> <|endoftext|> e　f"), (-4, "日本語 🙂 x\0y\r\n z"), (-5, "\nabc"), (-5, "a \n b  \n\n c"), (-6, " <0x41> ▁ "), (-7, "  a\u0085 b"), (-8, "<unk> x </s>\n<0x0A>")]


def test_alignment_equals_whole_text_calls(spark, sample):
    import random

    rng = random.Random(3)
    pool = "abcdefgh  \n\t\r'ésS1234.,!? 　 \x85\x1c\x01日🙂<|>İΣς"
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()] + ODD
    rows += [(-100 - i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert aligned(docs) == plain(rows)


def test_blocks_do_not_change_counts(spark):
    rows = [(i, f"shared words here and number {i % 7}") for i in range(400)] + [(1000 + i, "copies of one text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert aligned(docs, 1) == aligned(docs, 1 << 20) == plain(rows)


def test_alignment_of_awkward_rows(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert aligned(awkward) == plain(rows)
    assert aligned(empty) == []


def test_pointer_jumping_ends_at_the_components(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        ends = [np.unique(np.r_[rng.integers(1, size + 1, int(rng.integers(0, size + 1))), size]) for _ in range(2)]
        terminal, first, last = op13.terminals(*ends)
        cuts = np.intersect1d(*ends)
        group = np.concatenate([np.searchsorted(cuts, e) for e in ends])
        assert len(set(terminal)) == len(cuts)
        assert len(set(zip(terminal.tolist(), group.tolist(), strict=True))) == len(cuts)
        begin = np.r_[0, ends[0][:-1]], np.r_[0, ends[1][:-1]]
        for k in range(len(ends[0])):
            over = [j for j in range(len(ends[1])) if begin[1][j] < ends[0][k] and begin[0][k] < ends[1][j]]
            assert (first[k], last[k]) == (over[0], over[-1])
