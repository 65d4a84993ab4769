"""Finding many names in texts at once: the time goes with the texts, not with the number of names.

A name is found at the start of a word, whatever its case, with at most ``TAIL``
more word characters up to the end of the word that it stops in; of several
names that start at one place the longest counts. Names are kept as sorted
hashes by length. A place in a text can only hold a name of those lengths that
end near the end of a word, so few hashes are looked up for each word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

TAIL = 4
LEAST = 3
#: Characters of text that are looked through at once.
TOGETHER = 1 << 20
#: No letter beyond has an upper and a lower case.
CASED = 0x20000

_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, whether it is a word character) of every code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(CASED):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    word[ord("_")] = True
    return lower, word


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _geometric(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of parts of one text."""

    def __init__(self, points: np.ndarray):
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _geometric(_FACTOR, len(points)), out=self.sums[1:])
        self.back = _geometric(_BACK, len(points) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


class NameIndex:
    """Names as sorted hashes for each length, and their proper spelling."""

    def __init__(self, names: Iterable[str]):
        lower, word = _letters()
        self.proper: dict[str, str] = {}
        for name in sorted({n.strip() for n in names if n and len(n.strip()) >= LEAST}):
            self.proper[self._low(name)] = name
        points = _points("".join(self.proper))
        ends = np.cumsum([len(n) for n in self.proper] or [0])[: len(self.proper)]
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        hashes, lengths = Hashes(points).of(starts, ends), ends - starts
        self.by_length = {int(n): np.sort(hashes[lengths == n]) for n in np.unique(lengths)}
        first = points[starts] if len(starts) else np.empty(0, np.uint32)
        #: Characters other than those of words that a name begins with.
        self.signs = np.unique(first[~word[first]])

    @staticmethod
    def _low(text: str) -> str:
        lower, _ = _letters()
        return lower[_points(text)].astype("<u4").tobytes().decode("utf-32-le")

    def _longest(self, points: np.ndarray, low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length of the longest name, end of its word) in texts that end at ``ends``, where they have a separator."""
        _, word = _letters()
        inside = word[points]
        after = np.where(inside, len(points), np.arange(len(points)))
        after = np.minimum.accumulate(after[::-1])[::-1]  # where the word that goes on here ends
        free = np.ones(len(points), bool)
        free[1:] = ~inside[:-1]
        start = np.flatnonzero(free & (inside | np.isin(points, self.signs) if len(self.signs) else inside))
        limit = ends[np.searchsorted(ends, start)]
        hashes, found = Hashes(low), np.zeros(len(start), np.int64)
        for n, known in self.by_length.items():  # a longer name replaces a shorter one
            some = np.flatnonzero(start + n <= limit)
            some = some[after[start[some] + n] - start[some] - n <= TAIL]
            wanted = hashes.of(start[some], start[some] + n)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            found[some[known[at] == wanted]] = n
        some = np.flatnonzero(found)
        return start[some], found[some], after[start[some] + found[some]]

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str]]:
        """(text, start, end with its tail, proper name) of the longest name at each place; overlaps stay."""
        lower, _ = _letters()
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= TOGETHER):
                size += len(texts[to] or "") + 1
                to += 1
            some = [t or "" for t in texts[at:to]]
            points = _points("\n".join(some) + "\n")
            ends = np.cumsum([len(t) + 1 for t in some]) - 1
            low = lower[points]
            starts, lengths, stops = self._longest(points, low, ends)
            of = np.searchsorted(ends, starts)
            begin = np.append(0, ends[:-1] + 1)[of]
            for k, s, n, e, b in zip(of.tolist(), starts.tolist(), lengths.tolist(), stops.tolist(), begin.tolist(), strict=True):
                name = self.proper.get(low[s : s + n].astype("<u4").tobytes().decode("utf-32-le"))
                if name is not None:
                    yield at + k, s - b, e - b, name
            at = to


def without_overlaps(hits: Iterable[tuple]) -> Iterator[tuple]:
    """Hits (text, start, end, ...) in order of text and start, the first of those that overlap; of one start the longest."""
    text, covered = None, 0
    for hit in sorted(hits, key=lambda h: (h[0], h[1], -h[2], -len(h[3]))):
        if hit[0] != text or hit[1] >= covered:
            text, covered = hit[0], hit[2]
            yield hit
