"""Packing token ids into windows by minimum bin slack.

Documents are dealt to packing groups by a hash of their number and text; groups
have a bounded expected amount of text, and their number follows the corpus,
while that of partitions is bounded: a partition goes through its groups one by
one. In a
group, documents longer than a window are cut into full windows; what is left
of each is a length in a multiset. For each window a subset-sum search over a
bitset (one bit for each sum up to the capacity, one step for each copy of a
length, longest first) finds the choice closest to the capacity, and the counts
are backtracked from the bitsets. Where the best choice still leaves slack, one
remaining document is cut to fill it. A group's last ids, fewer than a window,
go to sequences of power-of-two lengths, which need no padding; so no sequence
is padded at all.

Defined results: null and empty texts hold the end id alone; rows that repeat a
doc_id are packed each; ties of length go by number and ids; very long texts
are cut at windows; other columns are ignored; an empty table gives an
empty table. Sequence numbers hold the group above bit 32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.runtime import bound_batches, strings, table, text_of
from gaugeworks.llm.wordbpe import default_path, encoder

WINDOW, END_ID = 4096, 2
#: Text that a packing group is meant to hold.
GROUP_CHARS = 8 << 20
#: Partitions at most.
MAX_PARTS = 1 << 14
CALL = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fullest(counts: dict[int, int], window: int = WINDOW) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to the window.

    Bit s of ``reach`` says that some choice sums to s. The bitset before each
    step is kept, and the choice is read off backwards. The search ends as soon
    as the window can be filled.
    """
    steps: list[tuple[int, int]] = []
    reach, full, mask = 1, 1 << window, (2 << window) - 1
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length], window // length)):
            steps.append((length, reach))
            grown = (reach | reach << length) & mask
            if grown == reach:
                steps.pop()
                break
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def pack(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover each document once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    left: dict[int, list[tuple[int, int]]] = {}  # by remaining length: (document, start)
    total = 0
    for doc, size in enumerate(sizes):
        whole = size // window * window
        for start in range(0, whole, window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
        if size > whole:
            left.setdefault(size - whole, []).append((doc, whole))
            total += size - whole

    def put(doc: int, start: int, length: int, offset: int) -> None:
        pieces.append((doc, start, length, sequence, offset))

    def take(length: int) -> tuple[int, int]:
        got = left[length].pop()
        if not left[length]:
            del left[length]
        return got

    while total >= window:
        offset = 0
        for length, n in fullest({k: len(v) for k, v in left.items()}, window).items():
            for _ in range(n):
                put(*take(length), length, offset)
                offset += length
        if offset < window:  # slack: cut the longest that remains
            length = max(left)
            doc, start = take(length)
            cut = window - offset
            put(doc, start, cut, offset)
            left.setdefault(length - cut, []).append((doc, start + cut))
        sequence += 1
        total -= window
    tail = [(doc, start, length) for length in sorted(left, reverse=True) for doc, start in left[length]]
    room = offset = 0
    for doc, start, length in tail:
        while length:
            if not room:
                room, offset = 1 << (total.bit_length() - 1), 0
                total -= room
            got = min(length, room)
            put(doc, start, got, offset)
            start, length, room, offset = start + got, length - got, room - got, offset + got
            if not room:
                sequence += 1
    return pieces


def pack_tokens(docs: DataFrame, tokenizer: str, window: int = WINDOW, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The pieces of all documents, with the sequence and offset where each lies."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = 1 + chars // group_chars

    def packed(group: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: (x[0] is not None, x[0], x[1]))  # the same order whenever the task runs
        pieces = pack([len(a) // 4 for _, a in held], window)
        for at in range(0, len(pieces), 10_000):
            some = pieces[at : at + 10_000]
            crc = [zlib.crc32(held[d][1][4 * s : 4 * (s + n)]) for d, s, n, _, _ in some]
            cols = [[held[p[0]][0] for p in some], [p[1] for p in some], [p[2] for p in some], crc, [len(held[p[0]][1]) // 4 for p in some], [(group << 32) + p[3] for p in some], [p[4] for p in some]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", END_ID)
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            numbers, texts, of_group = batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()
            for at in range(0, len(texts), CALL):
                got = encoder(tokenizer).encode(texts[at : at + CALL])
                for number, ids, group in zip(numbers[at : at + CALL], got, of_group[at : at + CALL], strict=True):
                    if group != now and held:
                        yield from packed(now, held)
                        held = []
                    now = group
                    held.append((number, ids + end))
        if held:
            yield from packed(now, held)

    parts = min(groups, MAX_PARTS)
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    dealt = grouped.repartitionById(parts, (F.col("group") % parts).cast("int"))
    return dealt.sortWithinPartitions("group").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), default_path())
