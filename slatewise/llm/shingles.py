"""Distinct word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from slatewise.llm.arrays import U64, mix, prefix_hash, span_hash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*range(9, 14), 32]] = True
_PLACES = np.random.default_rng(5).integers(1, 2**63, 64).astype(U64) * U64(2) + U64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, white space being the bytes 9 to 13 and 32; words of each row."""
    inside = ~_BREAK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = span_hash(prefix_hash(_LOWER[data]), begins, ends)
    return hashes, np.diff(np.searchsorted(begins, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as one, a row of none has none."""
    hashes, counts = words(data, offsets)
    n = max(0, len(hashes) - width + 1)
    whole = np.zeros(n, U64)
    for j in range(width):
        whole += hashes[j : j + n] * _PLACES[j]
    whole = mix(whole + U64(width))
    sets, at = [], 0
    for count in counts.tolist():
        if count >= width:
            sets.append(np.unique(whole[at : at + count - width + 1]))
        elif count:
            sets.append(mix(np.array([(hashes[at : at + count] * _PLACES[:count]).sum(dtype=U64) + U64(count)], U64)))
        else:
            sets.append(np.zeros(0, U64))
        at += count
    return sets


def set_name(s: np.ndarray) -> int:
    """64 bits that name a set, as a signed number."""
    return int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64))
