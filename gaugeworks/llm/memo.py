"""A bounded memo of values for pieces of text, for use inside a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

#: Pieces that a worker keeps, and the longest piece that is kept.
ENTRIES, CHARS = 500_000, 64


class _Known(dict):
    """The kept values; a piece that isn't kept is noted and stands as None for now."""

    absent: dict[str, None]

    def __missing__(self, key: str) -> None:
        self.absent[key] = None


class PieceMemo:
    """Values of pieces, each computed once while there is room; no value may be None.

    A full memo stays as it is (frequent pieces come early) and further pieces
    are computed for their batch only. It starts anew when many pieces miss, as
    when the language of the input changes. The values never depend on it.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable[Any]], entries: int = ENTRIES):
        self.compute, self.entries = compute, entries
        self.known = _Known()
        self.looked = self.missed = 0

    def values(self, lists: list[list[str]]) -> list[list[Any]]:
        """The values of each list's pieces, in order."""
        known = self.known
        known.absent = {}
        got = [list(map(known.__getitem__, pieces)) for pieces in lists]
        if known.absent:
            self._fill(got, lists)
        return got

    def _fill(self, got: list[list[Any]], lists: list[list[str]]) -> None:
        """Compute the absent pieces together and put them where they are missing."""
        new = list(self.known.absent)
        values = dict(zip(new, self.compute(new), strict=True))
        for mine, pieces in zip(got, lists, strict=True):
            at = -1
            while True:
                try:
                    at = mine.index(None, at + 1)
                except ValueError:
                    break
                mine[at] = values[pieces[at]]
        self.looked, self.missed = self.looked + sum(map(len, lists)), self.missed + len(new)
        if self.looked > 20 * self.entries:
            if self.missed > self.looked / 4:
                self.known = _Known()
            self.looked = self.missed = 0
        if len(self.known) + len(new) <= self.entries:
            self.known.update((k, v) for k, v in values.items() if len(k) <= CHARS)
