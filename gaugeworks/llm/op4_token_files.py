"""Token ids in compressed shard files with per-document access.

Format of a shard (``part-PPPPPP-KKKKKK.tzd``), integers little-endian:

    8 bytes   magic ``GTOKZD01``
    32 bytes  SHA-256 of the shared dictionary
    u64       ids of the part before this shard
    u32       number of documents n
    n x i64   document numbers (a null number is the smallest i64)
    n x u32   ids of each document
    (n+1) x u64  offsets of the frames, from the first frame
    frames    each document's ids (u32 array) as one zstandard frame, by the dictionary

One document is read by its offset alone: seek, read a frame, decompress it
with ``dictionary.zdict`` of the same folder. The dictionary is trained on the
id arrays of a bounded sample (``SAMPLE_DOCS`` documents, of longer ones the
``SAMPLE_CHARS`` characters from a hashed place); it only affects sizes, never
contents.

Documents are dealt to at most ``MAX_PARTS`` parts by ranges of doc_id and a hash
of the text, and sorted in them, so parts in order hold ascending numbers and a
number that many rows share is split; a part is streamed, whatever its size. A task writes each shard to a name of its own and
renames it when complete, and contents depend on the rows alone: a task that
runs again leaves the same files. The ids before a document are those before
its part (a sum over parts), its shard in the part, and its place in the shard.

Defined results: null and empty texts hold the end id alone; a null doc_id
comes first; rows that repeat a doc_id are each written, in the order of their
texts' hashes; very long texts are one frame; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.runtime import bound_batches, shared_dir, strings, table, text_of
from gaugeworks.llm.wordbpe import default_path, encoder

MAGIC, END_ID, NULL_ID = b"GTOKZD01", 2, -(1 << 63)
#: Documents and characters of each that train the dictionary, and its size in bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2000, 4000, 64 << 10
#: A shard is closed once it holds this many ids; a part is meant to hold this much text.
SHARD_IDS, PART_CHARS = 4 << 20, 16 << 20
#: Parts at most, and so rows that the driver gets and the running sum over parts has.
MAX_PARTS = 1 << 14
LEVEL = 3
CALL = 64


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's address, for use inside tasks."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sample(docs: DataFrame, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """A bounded sample that depends on the rows alone: the smallest hashes of doc_id."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # n numbers at most: small enough to broadcast at any size.
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(text_of()) - chars + 1))
    rows = docs.select("doc_id", text_of().substr(start.cast("int"), F.lit(chars)).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.orderBy("doc_id", "text").limit(n).select("text")


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary of the sample's id arrays, trained in one task; only its bytes reach the driver."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        texts = [t for b in batches for t in b["text"]]
        arrays = [x for x in encoder(tokenizer).encode(texts) if x]
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes() if len(arrays) >= 16 else b""
        except zstandard.ZstdError:  # too little to learn from
            trained = b""
        yield pd.DataFrame({"dictionary": [trained]})

    got = [bytes(r[0]) for r in sample(docs).coalesce(1).mapInPandas(run, "dictionary binary").collect()]
    return max(got, key=len, default=b"")


@lru_cache(maxsize=4)
def _codec(dictionary: bytes) -> tuple:
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True),
        zstandard.ZstdDecompressor(dict_data=known),
    )


def pack_shard(before: int, ids: list[int], arrays: list[bytes], dictionary: bytes) -> bytes:
    """One shard file's bytes."""
    squeeze = _codec(dictionary)[0].compress
    frames = [squeeze(a) for a in arrays]
    offsets = np.r_[0, np.cumsum([len(f) for f in frames])].astype("<u8")
    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<QI", before, len(ids))
    index = np.array(ids, "<i8").tobytes() + np.array([len(a) // 4 for a in arrays], "<u4").tobytes() + offsets.tobytes()
    return head + index + b"".join(frames)


class Shard:
    """A shard file's bytes, opened for reading any of its documents."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC or data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        self.before, n = struct.unpack_from("<QI", data, 40)
        at = 52
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.sizes = np.frombuffer(data, "<u4", n, at + 8 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 12 * n)
        self.data, self.base, self.open = memoryview(data), at + 12 * n + 8 * (n + 1), _codec(dictionary)[1].decompress

    def document(self, k: int) -> bytes:
        """The ids of the k-th document, without touching the others."""
        return self.open(self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])])


class Written(NamedTuple):
    folder: str
    dictionary: bytes
    parts: DataFrame  # part, n_ids: one row for each part that has documents


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, part_chars: int = PART_CHARS, shard_ids: int = SHARD_IDS) -> Written:
    """Write all documents' ids in ascending doc_id order as shards in ``folder``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    dictionary = train_dictionary(rows, tokenizer)

    def write(name: str, data: bytes) -> None:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        own = f"{root}/_{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(data)
        system.move(own, f"{root}/{name}")

    write("dictionary.zdict", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", END_ID)
        part, shard, total, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int] = []
        arrays: list[bytes] = []

        def close() -> None:
            nonlocal shard, total, held, ids, arrays
            if ids:
                write(f"part-{part:06d}-{shard:06d}.tzd", pack_shard(total, ids, arrays, dictionary))
                shard, total, held, ids, arrays = shard + 1, total + held, 0, [], []

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for at in range(0, len(texts), CALL):
                for number, got in zip(numbers[at : at + CALL], encoder(tokenizer).encode(texts[at : at + CALL]), strict=True):
                    ids.append(NULL_ID if number is None else number)
                    arrays.append(got + end)
                    held += len(got) // 4 + 1
                    if held >= shard_ids:
                        close()
        close()
        if total:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total], pa.int64())], ["part", "n_ids"])

    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(min(MAX_PARTS, 1 + chars // part_chars), *order[:2])
    sums = dealt.sortWithinPartitions(*order).mapInArrow(run, "part int, n_ids long")
    found = [tuple(r) for r in sums.collect()]  # one small row a part, MAX_PARTS at most
    return Written(folder, dictionary, spark.createDataFrame(found, "part int, n_ids long"))


def read_tokens(spark: SparkSession, written: Written, digests: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens and its ids (or their CRC-32)."""
    dictionary = written.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(data, dictionary)
                sizes = shard.sizes.astype(np.int64)
                start = int(shard.before) + np.cumsum(sizes) - sizes
                arrays = [shard.document(k) for k in range(len(sizes))]
                if any(len(a) != 4 * n for a, n in zip(arrays, sizes.tolist(), strict=True)):
                    raise ValueError(f"{name}: a frame's length differs from the index")
                last = pa.array([zlib.crc32(a) for a in arrays], pa.int64()) if digests else pa.array(arrays, pa.binary())
                numbers = pa.array([None if i == NULL_ID else i for i in shard.ids.tolist()], pa.int64())
                part = int(name.rsplit("/", 1)[-1].split("-")[1])
                yield pa.record_batch([pa.array([part] * len(sizes), pa.int32()), numbers, pa.array(start), pa.array(sizes), last], ["part", "doc_id", "local", "n_tokens", "value"])

    kind = "value long" if digests else "value binary"
    schema = f"part int, doc_id long, local long, n_tokens long, {kind}"
    parts = written.parts
    if not parts.head(1):
        empty = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tzd").load(written.folder)
        empty = files.select("path", "content").mapInArrow(run, schema)
    # MAX_PARTS rows at most: a running sum over them is small at any size.
    before = parts.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("base"))
    name = "ids_crc32" if digests else "ids"
    return empty.join(before, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", F.col("value").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark), default_path())
    return read_tokens(spark, written, digests=True)
