"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes (a space and the text). Tokens of one that
overlap tokens of the other are linked, and the links' components are the groups
between those offsets where tokens of both end. Every token points to the
token farthest to the right among itself and those that overlap it: the one
that holds its last byte in the other tokenization, if that one reaches further
(where both end together, the second tokenizer's is the end). Doubling the
successors, in one array for all tokens of many pieces, leads each token to the
terminal token of its component, and terminal tokens number the groups.

A text is cut before white space that follows other text, where tokens of
neither tokenizer can cross, and distinct pieces are encoded and aligned together
and kept in a bounded memo. A piece whose bytes don't come back sends its text
to the libraries as a whole.

Counts over the corpus need the linked id pairs of each document. Documents are
taken in blocks of bounded text: a block has a table of its distinct pairs with
the number of its documents that hold each, and its documents refer to places
in that table. Only the tables are shuffled: summed by pair, compared within
each first id, and brought back to their blocks. So a pair that most documents
hold is one row a block, and no table of all pairs is sent anywhere.

Defined results: null and empty texts, and texts whose tokens don't give back
the bytes of space and text, have no tokens, zeros and an empty ``groups_sha256``;
repeated rows are documents of their own and count each; a null doc_id comes
back as null; of pairs with equal counts all are best; very long texts are
aligned whole and make a block of their own; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.op5_token_counts import byte_letters
from gaugeworks.llm.runtime import bound_batches, held, materialise, strings, table

#: Characters of text in a block, about, texts aligned in one call, and pieces that a worker keeps.
BLOCK_CHARS, CALL, ENTRIES = 12 << 20, 64, 200_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ODD = re.compile(r"[ \n\t\r][ \n\t\r]|[^\S \n]|\0")


class Side:
    """One tokenizer: ids of pieces that start with white space, and each id's bytes."""

    lengths: np.ndarray
    values: list[bytes]

    def _known(self, values: list[bytes]) -> None:
        self.values, self.lengths = values, np.array([len(v) for v in values], np.int64)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError


class BytePairs(Side):
    """A byte-level BPE file of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.library.get_vocab(with_added_tokens=True)
        values = [b""] * (1 + max(vocab.values()))
        for token, k in vocab.items():
            values[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self._known(values)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model, which puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        raw = re.compile(r"<0x([0-9A-F]{2})>")
        self._known([bytes([int(m[1], 16)]) if (m := raw.fullmatch(t)) else t.replace("▁", " ").encode() for t in names])
        self.space = self.library.piece_to_id("▁")

    def ids(self, pieces: list[str]) -> list[list[int]]:
        # The library's own space stands for that of a piece; before a line break it is a token by itself.
        spaced = [p[1:] if p.startswith(" ") else p for p in pieces]
        found = self.library.encode(spaced, num_threads=1)
        return [f if p.startswith(" ") else f[1:] if f[:1] == [self.space] else [] for p, f in zip(pieces, found, strict=True)]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the terminal token of its component (tokens of the second come after those of the first),
    and the first and last token of the second that each token of the first overlaps.

    ``end_a`` and ``end_b`` are the ends of two cuts of the same bytes.
    """
    n = len(end_a)
    first = np.searchsorted(end_b, np.r_[0, end_a[:-1]], "right")
    last = np.searchsorted(end_b, end_a, "left")
    back = np.searchsorted(end_a, end_b, "left")
    mine = np.arange(len(end_b))
    following = np.r_[n + last, np.where(end_a[back] > end_b, back, n + mine)]
    while True:
        doubled = following[following]
        if np.array_equal(doubled, following):
            return following, first, last
        following = doubled


class Aligner:
    """Aligns texts by two tokenizers; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePairs(path_a), Pieces(path_b)
        self.memo = PieceMemo(self._pieces, ENTRIES)

    def _pieces(self, pieces: list[str]) -> list[tuple | bool]:
        """For each piece (n_a, n_b, n_groups, links as bytes, groups as text), or False if its bytes don't come back."""
        ids_a, ids_b = self.a.ids(pieces), self.b.ids(pieces)
        good = []
        for k, piece in enumerate(pieces):
            raw = piece.encode("utf-8", "surrogatepass")
            if ids_a[k] and b"".join(map(self.a.values.__getitem__, ids_a[k])) == raw and b"".join(map(self.b.values.__getitem__, ids_b[k])) == raw:
                good.append(k)
        out: list[tuple | bool] = [False] * len(pieces)
        if good:
            for k, value in zip(good, self._aligned([ids_a[k] for k in good], [ids_b[k] for k in good]), strict=True):
                out[k] = value
        return out

    def _aligned(self, many_a: list[list[int]], many_b: list[list[int]]) -> Iterator[tuple]:
        """All pieces together as one text: both tokenizations end where a piece ends."""
        size_a, size_b = (np.array([len(x) for x in many]) for many in (many_a, many_b))
        a, b = (np.fromiter((i for x in many for i in x), np.int64) for many in (many_a, many_b))
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        terminal, first, last = terminals(end_a, end_b)
        # Links: each token of the first with all that it overlaps.
        width = last - first + 1
        to = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())
        links = np.repeat(a, width) << 32 | b[to]
        owner = np.repeat(np.arange(len(many_a)), size_a)
        per_piece = np.bincount(owner, weights=width, minlength=len(many_a)).astype(np.int64)
        new_a, new_b = (np.r_[True, t[1:] != t[:-1]] for t in (terminal[: len(a)], terminal[len(a) :]))
        at_a, at_b = np.cumsum(size_a), np.cumsum(size_b)
        groups = np.add.reduceat(new_b.astype(np.int64), at_b - size_b)
        link_end = np.cumsum(per_piece)
        text_a, text_b = self._text(a, new_a, at_a), self._text(b, new_b, at_b)
        for k in range(len(many_a)):
            both = ";".join(map("|".join, zip(text_a[k], text_b[k], strict=True)))
            yield int(size_a[k]), int(size_b[k]), int(groups[k]), links[link_end[k] - per_piece[k] : link_end[k]].tobytes(), both

    @staticmethod
    def _text(ids: np.ndarray, new: np.ndarray, ends: np.ndarray) -> list[list[str]]:
        """The ids of each group of each piece, in decimal."""
        out, begin = [], 0
        values, marks = ids.tolist(), new.tolist()
        for end in ends.tolist():
            groups: list[str] = []
            for k in range(begin, end):
                if marks[k]:
                    groups.append(str(values[k]))
                else:
                    groups[-1] += f",{values[k]}"
            out.append(groups)
            begin = end
        return out

    def pieces(self, text: str) -> list[str]:
        text = " " + text
        if _ODD.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, str]]:
        """For each text n_a, n_b, n_groups, its distinct links and how often each occurs, and the digest of its groups."""
        cut = [self.pieces(t) if t else [] for t in texts]
        distinct = list(set().union(*cut)) if cut else []
        values = dict(zip(distinct, self.memo.values([distinct])[0], strict=True))
        for text, pieces in zip(texts, cut, strict=True):
            found = list(map(values.__getitem__, pieces))
            if False in found:
                found = self._whole(text)
            if not found:
                yield 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
                continue
            n_a, n_b, n_groups, links, groups = zip(*found, strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), pairs, times, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def _whole(self, text: str) -> list[tuple]:
        """The text as one piece, as the libraries see it; nothing if its bytes don't come back."""
        got = self._pieces([" " + text])[0]
        return [got] if got else []


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for these files."""
    return held(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"
_FOUND = f"block long, pairs array<long>, held array<long>, {_DOC}"


def _block_rows(number: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A block's table of pairs, as one row, and its documents with places in that table."""
    table_, places = np.unique(np.concatenate([d[4] for d in docs]), return_inverse=True)
    counts = np.bincount(places, minlength=len(table_)).astype(np.int64)
    names = ["block", "pairs", "held", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    yield batch([[number], [table_], [counts], *[[None]] * 8])
    ends = np.cumsum([len(d[4]) for d in docs])
    for at in range(0, len(docs), 256):
        some = docs[at : at + 256]
        where = [places[e - len(d[4]) : e].astype("<u4").tobytes() for d, e in zip(some, ends[at : at + 256], strict=True)]
        times = [d[5].astype("<u4").tobytes() for d in some]
        yield batch([[number] * len(some), [None] * len(some), [None] * len(some), *[[d[i] for d in some] for i in (0, 1, 2, 3)], [int(d[5].sum()) for d in some], [d[6] for d in some], where, times])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks and their documents: see ``_FOUND``; a row has either ``pairs`` and ``held`` or a document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b).align
        number = TaskContext.get().partitionId() << 32
        block: list[tuple] = []
        chars = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for at in range(0, len(texts), CALL):
                some = texts[at : at + CALL]
                block += [(i, *got) for i, got in zip(ids[at : at + CALL], align(some), strict=True)]
                chars += sum(map(len, some))
                if chars >= block_chars:
                    yield from _block_rows(number, block)
                    number, block, chars = number + 1, [], 0
        if block:
            yield from _block_rows(number, block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def alignments(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    found = materialise(aligned_blocks(docs, path_a, path_b, block_chars))
    pairs = found.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "of"))
    pairs = pairs.select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.held").alias("held"))
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("docs"))
    # An id of the first tokenizer has no more pairs than the second has ids.
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = materialise(counts.withColumn("best", F.col("docs") == most))
    known = pairs.select("block", "place", "pair").join(counts.hint("merge"), "pair").select(F.col("block").alias("of_block"), "place", "docs", "best")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block with the sums of what its table says."""
        docs_of, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        docs_of[place], best[place] = right.column("docs").to_numpy(), right.column("best").to_numpy()
        sums = []
        for where, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist(), strict=True):
            where, times = np.frombuffer(where, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append((int(best[where] @ times), int(docs_of[where] @ times)))
        n_best, count_sum = (pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1))
        return pa.table({c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": left.column("groups_sha256")})

    rows = found.where("pairs is null").drop("pairs", "held")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_force(rows: list[tuple[int | None, str | None]], path_a: str, path_b: str) -> list[tuple]:
    """The result's rows from whole-text calls of the libraries and comparisons of all tokens, for tests on small tables."""
    a, b = BytePairs(path_a), Pieces(path_b)
    docs = []
    for doc_id, text in rows:
        ids_a = a.library.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.library.encode(text or "", num_threads=1)
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a.values[i] for i in ids_a) != raw or b"".join(b.values[i] for i in ids_b) != raw:
            docs.append((doc_id, [], [], []))
            continue
        spans = []
        for side, ids in ((a, ids_a), (b, ids_b)):
            ends = np.cumsum([len(side.values[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            parts = []
            for k, start in ((0, i), (1, j)):
                stop = start
                while stop < len(spans[k]) and spans[k][stop][1] <= cut:
                    stop += 1
                parts.append((start, stop))
            (i0, i), (j0, j) = parts
            groups.append(",".join(str(x[2]) for x in spans[0][i0:i]) + "|" + ",".join(str(x[2]) for x in spans[1][j0:j]))
        docs.append((doc_id, spans[0], spans[1], links, groups))
    count: dict[tuple[int, int], int] = {}
    for d in docs:
        for pair in set(d[3]):
            count[pair] = count.get(pair, 0) + 1
    top: dict[int, int] = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for d in docs:
        digest = hashlib.sha256(";".join(d[4]).encode()).hexdigest() if d[3] else ""
        out.append((d[0], len(d[1]), len(d[2]), len(d[4]) if d[3] else 0, len(d[3]), sum(count[p] == top[p[0]] for p in d[3]), sum(count[p] for p in d[3]), digest))
    return out
