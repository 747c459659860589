"""Sorted runs as front-coded blocks, and their merge by a loser tree that keeps common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix lengths, lengths of the rest, the rests) of sorted keys; lengths have 16 bits, longer keys are refused."""
    n = len(keys)
    if not n:
        return b"", b"", b""
    sizes = np.fromiter(map(len, keys), np.int64, n)
    if sizes.max() > 0xFFFF:
        raise ValueError(f"a key of {sizes.max()} bytes is longer than 65535")
    wide = int(sizes.max()) + 1
    grid = np.zeros((n, wide), np.uint8)
    flat = np.frombuffer(b"".join(keys), np.uint8)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(flat)) - np.repeat(begin, sizes)
    grid[np.repeat(np.arange(n), sizes), at] = flat
    common = np.zeros(n, np.int64)
    if n > 1:
        same = grid[1:] == grid[:-1]
        same[:, -1] = False
        common[1:] = np.minimum(np.argmin(same, axis=1), np.minimum(sizes[1:], sizes[:-1]))
    rest = flat[at >= np.repeat(common, sizes)]
    return common.astype("<u2").tobytes(), (sizes - common).astype("<u2").tobytes(), rest.tobytes()


def decode(common: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, length of the prefix shared with the key before)."""
    key, at = b"", 0
    for c, n in zip(np.frombuffer(common, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(), strict=True):
        key = key[:c] + rest[at : at + n]
        at += n
        yield key, c


def differ(a: bytes, b: bytes, known: int) -> int:
    """First place from `known` on where the keys differ; the bytes before it are known to be equal."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            for x_i, y_i in zip(x, y, strict=False):
                if x_i != y_i:
                    return known
                known += 1
            return known
        known += len(x)
    return n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, length of the prefix shared with the key put out before, run) of all keys in order.

    Every contender carries the length of the prefix it shares with the last winner. Of two with
    unequal lengths the longer is smaller and no byte is read; of two with equal lengths bytes are
    read from there on only, and the loser keeps the place where they parted. Equal keys come out
    one after another, each with its whole length as the shared prefix.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    keys: list[bytes | None] = [None] * k
    known = [0] * k
    nexts = [r.__next__ for r in runs]
    for i, step in enumerate(nexts):
        try:
            keys[i], _ = step()
        except StopIteration:
            keys[i] = None
    losers = [0] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        at = differ(x, y, p)
        if at == len(x) or (at < len(y) and x[at] < y[at]):
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, lo = duel(build(2 * node), build(2 * node + 1))
        losers[node] = lo
        return w

    winner = build(1) if k > 1 else 0
    while (key := keys[winner]) is not None:
        yield key, known[winner], winner
        try:
            keys[winner], known[winner] = nexts[winner]()
        except StopIteration:
            keys[winner] = None
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            y = keys[other]
            if y is not None:
                x = keys[winner]
                # unequal prefixes decide at once
                if x is None or known[other] > known[winner]:
                    losers[node], winner = winner, other
                elif known[other] == known[winner]:
                    winner, losers[node] = duel(winner, other)
            node >>= 1
