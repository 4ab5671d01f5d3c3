"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array. In each round
every sequence finds its lowest-rank adjacent pair, all sequences apply theirs
at once, and the symbols that survive are counted. Texts are cut before white
space where no pre-token can cross, and the counts of the pieces are kept in a
bounded memo, so that merging runs on distinct pieces only.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each for itself; other columns, whatever their names, are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import bound_batches, held, strings, table

#: The public byte-level BPE pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens above which a text counts as over the limit, and texts counted together.
LIMIT, CALL = 1024, 64
_RUNS = re.compile(r"[ \n][ \n]|\0")
#: White space other than the four plain ones: such texts are cut nowhere.
_ODD = re.compile(r"[^\S \t\n\r]")
_PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ArrayMerger:
    """Merges many symbol sequences at once by a BPE rank table."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each byte string."""
        size = np.array([len(p) for p in pieces], np.int64)
        out = size.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        while len(symbols) > 1:
            rank = self._ranks(symbols, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbols)])
            active = np.repeat(lowest < self.none, length)
            out[owner[starts]] = length
            if not active.any():
                break
            symbols, owner, rank = symbols[active], owner[active], rank[active]
            best = np.repeat(lowest[lowest < self.none], length[lowest < self.none])
            take = self._apart(rank == best)
            symbols[take] = self.made[rank[take]]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            out[owner[0]] = 1
        return out

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol; ``none`` where there is no merge."""
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
        return np.r_[np.where(found, self.ranks[at], self.none), self.none]

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of pairs that overlap (a run of equal symbols), every other one from the left."""
        at = np.flatnonzero(hit)
        new = np.r_[True, np.diff(at) != 1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - first) % 2 == 0]


class TokenCounter:
    """Counts tokens of texts as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = ArrayMerger(spec["model"]["vocab"], merges)
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo = PieceMemo(self._pieces)

    def pieces(self, text: str) -> list[str]:
        """Pieces whose token counts add up: every cut is before white space that follows other text."""
        if _ODD.search(text):
            return [text]
        if _RUNS.search(text) or "\t" in text or "\r" in text:
            return _PIECES.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece; their distinct pre-tokens are merged together."""
        found = [self.pattern.findall(p) for p in pieces]
        words = list(set().union(*found))
        count = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True))
        return [sum(map(count.__getitem__, parts)) for parts in found]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as its one token."""
        extra = [0] * len(texts)
        parts = []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                between = self.special.split(text)
                extra[i] = len(between) - 1
                parts.append([p for b in between for p in self.pieces(b)])
            else:
                parts.append(self.pieces(text))
        return [sum(v) + e for v, e in zip(self.memo.values(parts), extra, strict=True)]


def counter(path: str) -> TokenCounter:
    """The worker's counter for this file."""
    return held(("counter", path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``; one row for each input row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            n = [x for at in range(0, len(texts), CALL) for x in counter(path).count(texts[at : at + CALL])]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    light = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("doc_id"), "text")
    out = light.mapInArrow(run, "doc_id struct<doc_id:long,n_bytes:long>, n_tokens long")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
