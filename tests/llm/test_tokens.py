"""Token ids, counts, files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gaugeworks.llm import op4_token_files, op5_token_counts, op6_packing, op10_bpe
from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import shared_dir
from gaugeworks.llm.wordbpe import ChunkEncoder, default_path

END = (2).to_bytes(4, "little")


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def byte():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def odd_texts():
    rng = random.Random(5)
    pool = "abcdefgh  \n\t\r'ésS1234.,!? 　 \x85\x1c\x01日🙂<|>İΣς"
    out = ["", "  a  b\n\n c\t", "<|endoftext|>hi <|endoftext|> x<|startoftext|>'s <|ENDOFTEXT|>", "don't I'LL  go", "a" * 500, "\x01 \x01"]
    out += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    return out + ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(50, 2000))) for _ in range(10)]


def test_own_bpe_equals_the_library(word):
    texts = odd_texts()
    bpe = op10_bpe.BacktrackingBPE(default_path())
    got = bpe.encode(texts)
    assert got == [ids_of(word, t) for t in texts]
    assert [bpe.decode(g).decode() for g in got] == [word.decode(word.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_chunk_encoder_equals_the_library(word):
    texts = odd_texts()
    assert ChunkEncoder(default_path()).encode(texts) == [ids_of(word, t) for t in texts]


def test_token_counter_equals_the_library(byte):
    texts = odd_texts()
    counter = op5_token_counts.TokenCounter(default_path("byte_bpe_50k.json"))
    assert counter.count(texts) == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memo_is_bounded_and_starts_anew():
    memo = PieceMemo(lambda ps: [p.upper() for p in ps], entries=10)
    for k in range(100):
        pieces = [[f"p{k}-{i}" for i in range(7)], [], [f"p{k}-0", "x" * 100]]
        assert memo.values(pieces) == [[p.upper() for p in ps] for ps in pieces]
        assert len(memo.known) <= 10


def test_counts_of_awkward_rows(byte, awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    got = op5_token_counts.token_counts(awkward, default_path("byte_bpe_50k.json"), limit=100).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), len(byte.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    assert sorted(((g[0], g[1], g[2]) for g in got), key=repr) == want
    assert all(g["over_limit"] == (g["n_tokens"] > 100) for g in got)
    assert op5_token_counts.token_counts(empty, default_path("byte_bpe_50k.json")).count() == 0


def test_encoding_of_awkward_rows(word, awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    got = op10_bpe.encode_decode(awkward, default_path(), digests=True).collect()
    want = sorted(((r[0], len(ids_of(word, r[1])) // 4, hashlib.sha256(ids_of(word, r[1])).hexdigest()) for r in rows), key=repr)
    assert sorted(((g[0], g[1], g[2]) for g in got), key=repr) == want
    assert op10_bpe.encode_decode(empty, default_path()).count() == 0
    plain = op10_bpe.encode_decode(awkward.where("doc_id = 1"), default_path()).first()
    assert plain["decoded"] == word.decode(word.encode(rows[[r[0] for r in rows].index(1)][1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_files_hold_every_document_in_order(spark, word, awkward):
    written = op4_token_files.write_tokens(awkward, shared_dir(spark), default_path(), part_chars=40_000, shard_ids=5000)
    got = sorted(op4_token_files.read_tokens(spark, written).collect(), key=lambda r: r["start"])
    rows = sorted(((r[0], r[1] or "") for r in awkward.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["doc_id"], bytes(r["ids"])) for r in got] == [(d, ids_of(word, t) + END) for d, t in rows]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


def test_one_document_is_read_without_the_others(spark, word, sample):
    written = op4_token_files.write_tokens(sample, shared_dir(spark), default_path(), part_chars=100_000)
    assert written.dictionary
    file = spark.read.format("binaryFile").option("pathGlobFilter", "part-000001-*.tzd").load(written.folder).first()
    shard = op4_token_files.Shard(bytes(file["content"]), written.dictionary)
    text = sample.where(f"doc_id = {int(shard.ids[3])}").first()["text"]
    assert shard.document(3) == ids_of(word, text) + END
    with pytest.raises(ValueError):
        op4_token_files.Shard(bytes(file["content"]), b"another dictionary")


def test_no_documents_no_shards(spark, empty):
    written = op4_token_files.write_tokens(empty, shared_dir(spark), default_path())
    assert op4_token_files.read_tokens(spark, written, digests=True).count() == 0


@pytest.mark.parametrize("window", [8, 64])
def test_fullest_equals_brute_force(window):
    from itertools import product

    rng = random.Random(window)
    for _ in range(60):
        counts = {rng.randint(1, window): rng.randint(1, 3) for _ in range(4)}
        sums = (sum(k * n for k, n in zip(counts, pick, strict=True)) for pick in product(*(range(c + 1) for c in counts.values())))
        taken = op6_packing.fullest(counts, window)
        assert all(taken[k] <= counts[k] for k in taken)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= window)


def check_pieces(pieces, texts_of, word, window):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    total = 0
    for doc_id, own in by_doc.items():
        ids = ids_of(word, texts_of[doc_id]) + END
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own]).tolist()[:-1]]
        assert sum(p["length"] for p in own) == own[0]["doc_tokens"] == len(ids) // 4
        total += len(ids) // 4
        for p in own:
            assert zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own]).tolist()[:-1]]
        size = sum(p["length"] for p in own)
        assert size <= window and size & (size - 1) == 0
    return total


def test_packing_covers_every_id_once(word, sample):
    texts = {r[0]: r[1] for r in sample.select("doc_id", "text").collect()}
    pieces = op6_packing.pack_tokens(sample, default_path(), group_chars=100_000).collect()
    assert {p["doc_id"] for p in pieces} == set(texts)
    check_pieces(pieces, texts, word, 4096)


def test_partitions_go_through_many_groups(word, sample, monkeypatch):
    alone = op6_packing.pack_tokens(sample, default_path(), group_chars=50_000).collect()
    monkeypatch.setattr(op6_packing, "MAX_PARTS", 2)
    assert sorted(map(tuple, op6_packing.pack_tokens(sample, default_path(), group_chars=50_000).collect())) == sorted(map(tuple, alone))
    assert len({r["sequence_id"] >> 32 for r in alone}) > 2


def test_packing_of_awkward_rows(word, awkward, empty):
    once = awkward.where("doc_id is not null and doc_id != 10")
    texts = {r[0]: r[1] for r in once.select("doc_id", "text").collect()}
    check_pieces(op6_packing.pack_tokens(once, default_path()).collect(), texts, word, 4096)
    every = op6_packing.pack_tokens(awkward, default_path()).collect()
    assert sum(p["length"] for p in every) == sum(len(ids_of(word, r[0])) // 4 + 1 for r in awkward.select("text").collect())
    assert op6_packing.pack_tokens(empty, default_path()).count() == 0
