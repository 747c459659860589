"""A tree of OR-combined bitmaps and size ranges, and its join with itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FAN = 8
#: Node pairs looked at together.
FRONT = 4096


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """Bits of a set of hashes, folded to `width` (a power of two, 64 or more), as 64-bit words."""
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def wide_enough(n: int) -> int:
    return 1 << max(6, (2 * int(n) - 1).bit_length())


class SignatureTree:
    """Level 0 has a row per set; each row above covers FAN rows below.

    A row holds the OR of the bitmaps, the range of sizes, and the most elements that share a bit
    with another of their set. Two sets can't have more in common than the bits both have set plus
    the elements of one of them beyond its bits, so two rows whose best case is under the overlap that the
    smallest sizes call for are dropped with all below them.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, percent: int):
        self.percent = percent
        over = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, over)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, low, high, over = self.levels[level]
        fits = (100 * high[i] >= self.percent * low[j]) & (100 * high[j] >= self.percent * low[i])
        common = np.bitwise_count(b[i] & b[j]).sum(1).astype(np.int64) + np.minimum(over[i], over[j])
        # inter >= percent / (100 + percent) * (size + size)
        return fits & ((100 + self.percent) * common >= self.percent * (low[i] + low[j]))

    def pairs(self, labels: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of sets that may be similar and whose labels differ when they are reached.

        `labels()` gives the sets' present labels; rows that are of one and the same label need no visit.
        """
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONT:
                stack.append((level, i[FRONT:], j[FRONT:]))
                i, j = i[:FRONT], j[:FRONT]
            low = high = labels()
            for _ in range(level):
                at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            open_ = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            i, j = i[open_], j[open_]
            ok = self._possible(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            below = len(self.levels[level - 1][1])
            a = (i[:, None] * FAN + np.arange(FAN))[:, :, None] + np.zeros((1, 1, FAN), np.int64)
            b = (j[:, None] * FAN + np.arange(FAN))[:, None, :] + np.zeros((1, FAN, 1), np.int64)
            a, b = a.ravel(), b.ravel()
            good = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
            stack.append((level - 1, a[good], b[good]))
