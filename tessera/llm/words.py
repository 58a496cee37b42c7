"""Words of many texts at once, as places in one buffer: no object a word."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Bytes whose words are hashed together.
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte; blanks count nothing.
LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
LETTER[32] = 0


class Words(NamedTuple):
    """``flat`` holds all words with one blank behind each; ``starts`` and ``ends`` are places there; ``counts`` is by text."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.flat) + SLICE, SLICE))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                low, starts = self.starts[a], self.starts[a:b] - self.starts[a]
                part = self.flat[low : self.ends[b - 1] + 1]
                place = np.arange(len(part)) - np.repeat(starts, np.diff(starts, append=len(part)))
                powers = np.cumprod(np.full(int(place.max()) + 1, FACTOR))
                out[a:b] = np.add.reduceat(LETTER[part] * powers[place], starts)
        return mixed(out)

    def numbers(self) -> np.ndarray:
        """Equal numbers for equal words and only for them: hashes are compared first, then the bytes."""
        _, first, number = np.unique(self.hashes(), return_index=True, return_inverse=True)
        size = self.ends - self.starts
        model = first[number]
        if (size != size[model]).any() or self._differ(model):
            ids: dict[bytes, int] = {}
            raw = self.flat.tobytes()
            return np.fromiter((ids.setdefault(raw[a:b], len(ids)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)), np.int64, len(size))
        return number

    def _differ(self, model: np.ndarray) -> bool:
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.flat) + SLICE, SLICE))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                low, high = self.starts[a], self.ends[b - 1] + 1
                size = self.ends[a:b] + 1 - self.starts[a:b]
                there = np.arange(low, high) + np.repeat(self.starts[model[a:b]] - self.starts[a:b], size)
                if (self.flat[there] != self.flat[low:high]).any():
                    return True
        return False


def words(texts: Sequence[bytes], lower: bool = False) -> Words:
    """Maximal runs of anything but space and \\t..\\r; with ``lower`` A-Z are lower-cased."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = SPACE[raw]
    after = np.ones(len(raw), bool)
    after[1:] = blank[:-1]
    # Blanks behind blanks go.
    kept = ~(blank & after)
    flat = raw[kept]
    flat[blank[kept]] = 32
    if lower:
        flat = LOWER[flat]
    upto = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begins = np.concatenate(([0], np.cumsum(~blank & after)))[upto]
    ends = np.flatnonzero(flat == 32)
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    return Words(flat, starts, ends, np.diff(begins))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * FACTOR + h[i : len(h) - n + 1 + i]
    return mixed(out)
