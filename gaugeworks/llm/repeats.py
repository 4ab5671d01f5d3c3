"""Which keys occur in two documents or more: a count-min sketch merged over partitions.

Estimates are never below the true counts, so no repeated key is lost; a few
others pass. The merged sketch is one bit a counter, at most
``2 * MAX_COUNTERS / 8`` bytes (64 MB) in all whatever the corpus, and is broadcast.
A corpus beyond that capacity gets a filter that lets more keys pass, up to all
of them, and the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gaugeworks.llm.runtime import strings, sweep
from gaugeworks.llm.shingles import mix

#: Counters of a sketch row at most, counters of a slice, keys counted before a partition sends its sketch.
MAX_COUNTERS, SLICE_BITS, FLUSH_KEYS = 1 << 28, 16, 2_000_000
#: Counters for each key that is expected.
ROOM = 2
#: Partitions whose sketches one task merges before slices are merged as a whole.
FAN_IN = 64
CALL = 64

_SKETCH = "row int, slice int, salt int, once binary, more binary"
_SCHEMA = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def counters(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's counter in each of the two rows."""
    m = np.uint64(size - 1)
    return mix(keys) & m, mix(keys ^ np.uint64(0x5851F42D4C957F2D)) & m


def _slices(counts: np.ndarray, row: int, salt: int) -> Iterator[dict]:
    """Sorted counters of one row, cut into slices: those counted once and those more often."""
    at, n = np.unique(counts, return_counts=True)
    part = at >> np.uint64(SLICE_BITS)
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(at)]
    low = (at & np.uint64((1 << SLICE_BITS) - 1)).astype("<u2")
    for b, e in zip(edges[:-1], edges[1:], strict=True):
        if e > b:
            yield {"row": row, "slice": int(part[b]), "salt": salt, "once": low[b:e][n[b:e] == 1].tobytes(), "more": low[b:e][n[b:e] > 1].tobytes()}


def build_filter(texts: DataFrame, keys_of: Callable[[list[str]], Iterator[np.ndarray]], expected: int) -> tuple[int, list[np.ndarray]]:
    """The merged sketch of a one-column table of texts: its size, and for each row a packed
    bit array of the counters above one. ``keys_of`` gives each text's distinct keys."""
    size = 1 << 16
    while size < MAX_COUNTERS and size < ROOM * expected:
        size <<= 1
    width = 1 << min(SLICE_BITS, size.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() // FAN_IN
        held: list[np.ndarray] = []
        total = 0

        def send() -> pa.RecordBatch:
            keys = np.concatenate(held)
            some = [s for row, at in enumerate(counters(keys, size)) for s in _slices(at, row, salt)]
            return pa.RecordBatch.from_pylist(some, _SCHEMA)

        for batch in batches:
            got = strings(batch.column(0))
            for at in range(0, len(got), CALL):
                for keys in keys_of(got[at : at + CALL]):
                    if len(keys):
                        held.append(keys)
                        total += len(keys)
                if total >= FLUSH_KEYS:
                    yield send()
                    held.clear()
                    total = 0
        if held:
            yield send()

    def first(group: pa.Table) -> dict[str, pa.Array | pa.ChunkedArray]:
        return {c: group.column(c).slice(0, 1) for c in ("row", "slice", "salt")}

    def merge(group: pa.Table) -> pa.Table:
        """Lists of counters as two bit arrays: counted once, and more often."""
        got = np.zeros(width, np.uint8)
        for once, more in zip(group.column("once").to_pylist(), group.column("more").to_pylist(), strict=True):
            i, j = np.frombuffer(once, "<u2"), np.frombuffer(more, "<u2")
            got[i] = np.minimum(got[i] + 1, 2)
            got[j] = 2
        once, more = (np.packbits(got == k, bitorder="little").tobytes() for k in (1, 2))
        return pa.table(first(group) | {"once": pa.array([once], pa.binary()), "more": pa.array([more], pa.binary())})

    def bits(group: pa.Table) -> pa.Table:
        once, more = np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
        for o, m in zip(group.column("once").to_pylist(), group.column("more").to_pylist(), strict=True):
            o, m = np.frombuffer(o, np.uint8), np.frombuffer(m, np.uint8)
            more |= m | (once & o)
            once |= o
        return pa.table({c: v for c, v in first(group).items() if c != "salt"} | {"bits": pa.array([more.tobytes()], pa.binary())})

    sent = texts.mapInArrow(count, _SKETCH)
    merged = sent.groupBy("row", "slice", "salt").applyInArrow(merge, _SKETCH)
    final = merged.groupBy("row", "slice").applyInArrow(bits, "row int, slice int, bits binary")
    out = [np.zeros(size // 8, np.uint8) for _ in range(2)]
    for row, part, packed in final.collect():  # size / 4 bytes in all, whatever the corpus
        begin = part * width // 8
        out[row][begin : begin + width // 8] = np.frombuffer(packed, np.uint8)
    sweep(texts.sparkSession)
    return size, out


def repeated(keys: np.ndarray, size: int, filters: list[np.ndarray]) -> np.ndarray:
    """Whether each key is estimated to be in two documents or more."""
    hit = np.ones(len(keys), bool)
    for at, packed in zip(counters(keys, size), filters, strict=True):
        hit &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


