"""BPE encoding by backtracking over longest matches; decoding by an offset table.

An Aho-Corasick automaton over the vocabulary lists, for each position of a
word, the longest token that starts there. The encoder takes longest matches
from the left; a token may follow another only if the pair is compatible, that
is if merging the two tokens' symbols by rank gives just these two tokens. When
nothing fits it steps back, and positions from which it has stepped back are
never tried again, so the work grows with the length. A sequence all of whose
neighbours are compatible is the one that merging by rank gives.

Decoding joins the tokens' strings with spaces, as the library does for a file
without a decoder: one gather through a table of offsets into all strings.

Defined results: null and empty texts have no ids and decode to an empty
string; repeated rows are encoded each for itself; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import bound_batches, strings, table
from gaugeworks.llm.wordbpe import chunks_of, default_path

#: Texts encoded together, and pairs kept in the compatibility table before it starts anew.
CALL, MEMO_PAIRS = 64, 1_000_000
#: The file's pre-tokenisation pattern over lower-case ASCII; other text goes to the library's own.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: ASCII letters whose byte-alphabet letter is the same letter.
PRINTABLE = re.compile(r"[!-~]+")


class BacktrackingBPE:
    """Exact BPE for a tokenizers file with word ends; built once in a worker.

    Symbols are single letters of the byte alphabet; the last of a word carries
    the word-end suffix and is shifted into a private range, so that every
    symbol is one character and every token a string over symbols.
    """

    END = 0xE000

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.symbols = {i: self._symbols(t) for t, i in self.vocab.items() if i not in self.special.values()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = self.vocab[a], self.vocab[b]
            self.rank[left, right] = r
            self.made_by[self.vocab[a + b]] = (r, left, right)
        self.automaton = ahocorasick.Automaton()
        for i, s in self.symbols.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.by_symbols = {s: i for i, s in self.symbols.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.prefix: dict[int, int | None] = {}
        self.memo = PieceMemo(self._chunks)
        strings_ = [n.encode() + b" " for n in self.names]
        self.offsets = np.r_[0, np.cumsum([len(s) for s in strings_])].astype(np.int64)
        self.buffer = np.frombuffer(b"".join(strings_), np.uint8)

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(self.END + ord(token[-1])) if token else ""
        return token

    def _boundary_holds(self, left: int, right: int, formed: bool) -> bool:
        """Whether no merge joins the two tokens' symbols across the boundary before both are complete.

        The two tokens' last steps are undone in turn, the later first; at each
        step the pair at the boundary must have no merge that comes before the
        step just undone. A merge of equal rank is applied from the left, so it
        goes to the left token's own pair but comes before the right token's.
        ``formed`` also asks whether the complete tokens stay apart.
        """
        until_left = until_right = 1 << 60
        first = not formed
        while True:
            joins = self.rank.get((left, right))
            if joins is not None and not first and joins < until_left and joins <= until_right:
                return False
            first = False
            a, b = self.made_by.get(left), self.made_by.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                until_left, _, left = a
            else:
                until_right, right, _ = b

    def _reachable(self, token: int) -> bool:
        """Whether a token's own symbols merge to it; others never appear in an encoding."""
        got = self.sound.get(token)
        if got is None:
            made = self.made_by.get(token)
            got = made is None or (self._reachable(made[1]) and self._reachable(made[2]) and self._boundary_holds(made[1], made[2], formed=False))
            self.sound[token] = got
        return got

    def _fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs are met."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self._boundary_holds(left, right, formed=True)
        return got

    def _shorter(self, token: int) -> int | None:
        """The next shorter token that is a prefix of this one."""
        if token not in self.prefix:
            s = self.symbols[token]
            self.prefix[token] = next((i for n in range(len(s) - 1, 0, -1) if (i := self.by_symbols.get(s[:n])) is not None), None)
        return self.prefix[token]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token given as letters of the byte alphabet."""
        if not word:
            return []
        text = word[:-1] + chr(self.END + ord(word[-1])) if self.suffix else word
        longest: list[int | None] = [None] * len(text)
        for end, token in self.automaton.iter(text):
            longest[end - len(self.symbols[token]) + 1] = token
        ids: list[int] = []
        at, token, dead = 0, longest[0], set()
        while at < len(text):
            while token is not None:
                end = at + len(self.symbols[token])
                if end not in dead and self._reachable(token) and (not ids or self._fits(ids[-1], token)):
                    break
                token = self._shorter(token)
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at] if at < len(text) else None
            else:
                dead.add(at)
                token = ids.pop()
                at -= len(self.symbols[token])
                token = self._shorter(token)
        return ids

    def _words(self, text: str) -> list[str]:
        """Pre-tokens as letters of the byte alphabet."""
        if PRINTABLE.fullmatch(text):
            return ASCII_WORDS.findall(text.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without spaces, special strings inside them included."""
        words: dict[str, list[int]] = {}
        out = []
        for chunk in chunks:
            ids: list[int] = []
            at = 0
            for m in [*(self.specials.finditer(chunk) if self.specials else ()), None]:
                if text := chunk[at : m.start() if m else len(chunk)]:
                    for word in self._words(text):
                        got = words.get(word)
                        if got is None:
                            got = words[word] = self.encode_word(word)
                        ids += got
                if m:
                    ids.append(self.special[m[0]])
                    at = m.end()
            out.append(np.asarray(ids, "<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        return list(map(b"".join, self.memo.values([chunks_of(t) for t in texts])))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: their strings, joined by a space."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        size = self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(size)
        at = np.repeat(self.offsets[i] - (ends - size), size) + np.arange(ends[-1])
        return self.buffer[at[:-1]].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> BacktrackingBPE:
    return BacktrackingBPE(path)


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """For each row doc_id, n_tokens and the ids and decoded text, or (``digests``) their SHA-256."""
    bound_batches(docs.sparkSession)
    kinds = (pa.string(), pa.string()) if digests else (pa.binary(), pa.string())
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            n, first, second = [], [], []
            texts = strings(batch.column(1))
            for ids in (i for at in range(0, len(texts), CALL) for i in bpe.encode(texts[at : at + CALL])):
                back = bpe.decode(ids)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                second.append(hashlib.sha256(back).hexdigest() if digests else back.decode())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_path(), digests=True)
