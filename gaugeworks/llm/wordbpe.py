"""Token ids of whole texts by the tokenizers library, with a bounded memo of chunks.

``word_bpe_49k.json`` drops white space and never lets a token cross it, so the
ids of a text are the ids of its space-separated chunks in order. Each distinct
chunk is encoded by the library once and then looked up.
"""

from __future__ import annotations

import os

import numpy as np

from gaugeworks.llm.memo import PieceMemo
from gaugeworks.llm.runtime import held

#: A character that texts hardly hold: as a word of its own it marks where one
#: chunk's ids end when many chunks are encoded in one call.
MARK = "\x01"
CALL = 200


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of(text: str) -> list[str]:
    """Space-separated chunks, lower-cased where that is what the library does to each character."""
    text = text.replace("\n", " ").replace("\t", " ")
    if "<|" not in text and plain_letters(text):
        text = text.lower()
    return text.split(" ")


def plain_letters(text: str) -> bool:
    """Whether all characters are Latin-1, whose composition and lower case have no exceptions."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self._ids([MARK])[0]
        self.memo = PieceMemo(self._chunks)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; many chunks share a call of the library."""
        alone = [c for c in chunks if MARK in c or any(s in c for s in self.special)] if len(self.mark) == 1 else chunks
        rest = [c for c in chunks if c not in set(alone)] if alone else chunks
        found = dict(zip(alone, (i.tobytes() for i in self._ids(alone)), strict=True))
        groups = [rest[i : i + CALL] for i in range(0, len(rest), CALL)]
        for group, ids in zip(groups, self._ids([f" {MARK} ".join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(ids == self.mark[0])
            flat = ids.tobytes()
            begin = [0, *(4 * cut + 4).tolist()]
            end = [*(4 * cut).tolist(), len(flat)]
            found.update((c, flat[b:e]) for c, b, e in zip(group, begin, end, strict=True))
        return [found[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        return list(map(b"".join, self.memo.values([chunks_of(t) for t in texts])))


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for this file."""
    return held(("encoder", path), lambda: ChunkEncoder(path))
