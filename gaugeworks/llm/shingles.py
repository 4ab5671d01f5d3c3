"""Word hashing and rolling hashes of word sequences, vectorised for use inside tasks."""

from __future__ import annotations

import numpy as np

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import held

#: Fixed odd multipliers of the two rolling lanes, and a 64-bit mixer's constants.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = "\t\n\x0b\x0c\r"
#: Words that a worker keeps the hashes of, and words of a span that a sum over powers covers.
ENTRIES, PART = 200_000, 32


def words_of(text: str) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    for c in _SPACE:
        if c in text:
            text = text.replace(c, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, all else as it is."""
    # On bytes, lower() touches A-Z alone.
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multipliers and of their inverses modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in LANES]
        self.down = [np.ones(1, np.uint64) for _ in LANES]

    def ensure(self, n: int) -> None:
        if len(self.up[0]) < n:
            n = max(n, 2 * len(self.up[0]), 1 << 12)
            for k, m in enumerate(LANES):
                inverse = np.uint64(pow(int(m), -1, 1 << 64))
                for store, base in ((self.up, m), (self.down, inverse)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    store[k] = np.cumprod(steps, dtype=np.uint64)


class WordHasher:
    """Hashes words to 128 bits with a bounded memo, and rolls windows over them."""

    def __init__(self) -> None:
        import xxhash

        self.memo = PieceMemo(lambda ws: [xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in ws], ENTRIES)
        self.powers = Powers()

    def hashes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """An (n, 2) array of unsigned 64-bit hashes for each list of words."""
        return [np.frombuffer(b"".join(v), "<u8").reshape(-1, 2) for v in self.memo.values(texts)]

    def rolling(self, hashes: np.ndarray, width: int, lane: int) -> np.ndarray:
        """For each start, one hash of the ``width`` words from there; equal sequences, equal values.

        A sum over powers modulo 2**64: for short windows only. Over long sequences that swap two words in
        a Thue-Morse pattern, such sums agree whatever the words; ``spans`` are for these.
        """
        n = len(hashes) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        self.powers.ensure(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes[:, lane] * self.powers.up[lane][: len(hashes)], out=sums[1:])
        return (sums[width:] - sums[:-width]) * self.powers.down[lane][:n]


def spans(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span of words, of any length, which is part of them.

    A span is cut into parts of ``PART`` words from its start on. A part's words are summed over powers, and
    the sums are mixed with their places before they are added, so that no pattern of words over many parts
    makes differences cancel.
    """
    h = hasher()
    h.powers.ensure(len(words) + 1)
    parts = (length + PART - 1) // PART
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + place * PART
    end = np.minimum(begin + PART, np.repeat(start + length, parts))
    where = np.cumsum(parts) - parts
    out = []
    for lane in (0, 1):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words[:, lane] * h.powers.up[lane][: len(words)], out=sums[1:])
        part = (sums[end] - sums[begin]) * h.powers.down[lane][begin]
        mixed = mix(part + mix(place.astype(np.uint64) + np.uint64(1)))
        out.append(mix(np.add.reduceat(mixed, where) + length.astype(np.uint64)) if len(where) else np.zeros(0, np.uint64))
    return out[0], out[1]


def hasher() -> WordHasher:
    """The worker's word hasher."""
    return held("hasher", WordHasher)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values
