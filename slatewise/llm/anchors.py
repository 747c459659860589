"""Content-defined anchors: places in a text that every long enough string of it shares with its copies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from slatewise.llm.arrays import U64, mix, powers, prefix_hash

#: Windows of the concatenated bytes looked at together.
CHUNK = 1 << 20


@dataclass
class Anchors:
    """Runs of `window`-byte windows (starts low..high, inclusive) that choose the `gram` bytes at `place`."""

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    place: np.ndarray
    hash: np.ndarray

    def pick(self, which: np.ndarray) -> Anchors:
        return Anchors(self.row[which], self.low[which], self.high[which], self.place[which], self.hash[which])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """Every window of a row lies in exactly one run; equal windows choose the same place in themselves.

    A window chooses the leftmost of its grams with the least hash, which depends on its bytes alone.
    """
    grams = window - gram + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found: list[Anchors] = []
    for at in range(0, max(0, len(data) - window + 1), CHUNK):
        part = data[at : at + CHUNK + window - 1]
        p = prefix_hash(part)
        h = mix((p[gram:] - p[:-gram]) * powers(len(part))[1][: len(part) - gram + 1])
        # the upper 40 bits decide, then the place: 24 bits are enough for a chunk
        best = (h & ~U64(0xFFFFFF)) | np.arange(len(h), dtype=U64)
        step = 1
        while step * 2 <= grams:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        n = len(part) - window + 1
        best = np.minimum(best[:n], best[grams - step : grams - step + n])
        place = (best & U64(0xFFFFFF)).astype(np.int64)
        whole = at + np.arange(n) + window <= ends[at : at + n]
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1] | (rows[at + 1 : at + n] != rows[at : at + n - 1])
        low = np.flatnonzero(new & whole)
        stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        found.append(Anchors(rows[at + low], at + low, at + stop, at + place[low], h[place[low]]))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, np.zeros(0, U64))
    return Anchors(*(np.concatenate([getattr(x, f) for x in found]) for f in ("row", "low", "high", "place", "hash")))
