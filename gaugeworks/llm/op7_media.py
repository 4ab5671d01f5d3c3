"""Media columns: texts stored as lossless WebP images, read back and described.

A payload is the text's UTF-8 bytes, padded with spaces to whole rows of 64 RGB
pixels. It becomes one image of at most ``ROWS`` rows, or several, one after
the other, for longer texts; so no image and no decoding step grows with a
text. The media column is written to a table and decoded from what was read.

Defined results: null and empty texts are one row of spaces; equal texts have
equal values; repeated rows are stored each; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.runtime import bound_batches, materialise, strings, table
from gaugeworks.llm.webp import read_images, split_images, write_images

WIDTH, ROWS = 64, 64
#: Texts that are encoded together.
GROUP = 128
#: Payload bytes that a task decodes in step.
GATHER = 12 << 20


def payload_of(text: str) -> bytes:
    """UTF-8 padded with spaces to a positive multiple of one row."""
    data = text.encode("utf-8", "surrogatepass")
    row = 3 * WIDTH
    return data.ljust(max(row, -(-len(data) // row) * row), b" ")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the ``media`` column."""
    bound_batches(docs.sparkSession)
    block = 3 * WIDTH * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at in range(0, len(texts), GROUP):
                some = texts[at : at + GROUP]
                pieces, owner = [], []
                for k, text in enumerate(some):
                    data = np.frombuffer(payload_of(text), np.uint8)
                    for b in range(0, len(data), block):
                        pieces.append(data[b : b + block])
                        owner.append(k)
                media = [b""] * len(some)
                for k, image in zip(owner, write_images(pieces, WIDTH), strict=True):
                    media[k] += image
                n = [len(t.encode("utf-8", "surrogatepass")) for t in some]
                yield pa.record_batch([batch.column(0).slice(at, len(some)), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(samples: np.ndarray) -> str:
    """Image features of RGB samples: size, channel means, spread, and the commonest value."""
    pixels = samples.reshape(-1, 3)
    means = samples.reshape(-1, 3).mean(0, dtype=np.float64)
    count = np.bincount(samples, minlength=256)
    return f"{WIDTH}x{len(pixels) // WIDTH};mean={means[0]:.3f},{means[1]:.3f},{means[2]:.3f};values={int((count > 0).sum())};mode={int(count.argmax())}"


def decode_media(media: DataFrame, payload: bool = False) -> DataFrame:
    """Each row's payload facts and features, computed from the stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def some(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        images, owner = [], []
        for k, (_, _, data) in enumerate(rows):
            for image in split_images(data):
                images.append(image)
                owner.append(k)
        parts: list[list[np.ndarray]] = [[] for _ in rows]
        for k, samples in zip(owner, read_images(images), strict=True):
            parts[k].append(samples)
        cols: list[list] = [[] for _ in names]
        raw = []
        for (doc_id, n, data), got in zip(rows, parts, strict=True):
            samples = np.concatenate(got) if len(got) > 1 else got[0]
            back = samples.tobytes()
            values = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(samples))
            for c, v in zip(cols, values, strict=True):
                c.append(v)
            raw.append(back)
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        return pa.record_batch([*arrays, pa.array(raw, pa.binary())], [*names, "payload"]) if payload else pa.record_batch(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(row)
                size += row[1] + 192
                if size >= GATHER:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (", payload binary" if payload else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(materialise(encode_media(table(spark, sf_dir, "documents"))))
