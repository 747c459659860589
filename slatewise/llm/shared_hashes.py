"""Which hashes of a set other sets hold too: hashes are dealt by range, in blocks of a batch each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.arrays import U64, ranges
from slatewise.session import shuffle_partitions

#: Bits of a hash that tell it from others of its range; a chance meeting only adds a candidate.
KEY_BITS = 32


def range_count(spark) -> int:
    """Ranges that hashes are dealt into: a power of two, as many as shuffle partitions or a few more."""
    return 1 << max(2, (shuffle_partitions(spark) - 1).bit_length())


def tokens_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The name a hash goes by: KEY_BITS bits and its range, as a signed number."""
    bits = parts.bit_length() - 1
    return ((hashes >> U64(20)) & U64(0xFFFFFFFF)).astype(np.int64) << bits | (hashes & U64(parts - 1)).astype(np.int64)


def _blobs(order: np.ndarray, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """The values of `order` (sorted) and, for each, the bytes of the columns' rows that have it."""
    values, at = np.unique(order, return_index=True)
    ends = np.append(at, len(order))[1:]
    return values, [pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for x in columns]


def _dealt(sets: DataFrame, parts: int) -> DataFrame:
    """(part, sets, counts, keys): per batch and range the batch's sets, each once however many copies, and their keys in order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(v, return_index=True)
            held = [np.frombuffer(batch.column(1)[int(i)].as_py(), U64) for i in first]
            owner = np.repeat(np.arange(len(first)), [len(x) for x in held])
            hashes = np.concatenate(held) if held else np.zeros(0, U64)
            part = (hashes & U64(parts - 1)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, owner = part[order], owner[order]
            key = ((hashes[order] >> U64(20)) & U64(0xFFFFFFFF)).astype(np.uint32)
            rows: dict[str, list] = {"part": [], "sets": [], "counts": [], "keys": []}
            bounds = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = bounds[p], bounds[p + 1]
                if a < b:
                    who, n = np.unique(owner[a:b], return_counts=True)
                    for c, x in zip(rows, (p, v[first[who]].tobytes(), n.astype(np.uint32).tobytes(), key[a:b].tobytes()), strict=True):
                        rows[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("sets", "counts", "keys"))], ["part", "sets", "counts", "keys"])

    return sets.mapInArrow(deal, "part int, sets binary, counts binary, keys binary")


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, key, df) of the tokens of one range; df is how many sets hold the key, and a set that came in several batches counts once."""
    v, keys, block = [], [], []
    for n, (s, c, k) in enumerate(zip(*(table.column(x).to_pylist() for x in ("sets", "counts", "keys")), strict=True)):
        own, count = np.frombuffer(s, np.int64), np.frombuffer(c, np.uint32)
        v.append(np.repeat(own, count))
        block.append(np.full(len(v[-1]), n, np.int64))
        keys.append(np.frombuffer(k, np.uint32))
    v, keys, block = (np.concatenate(x) for x in (v, keys, block))
    _, first, which = np.unique(v, return_index=True, return_inverse=True)
    once = block == block[first][which]
    v, keys, which = v[once], keys[once], which[once]
    order = np.lexsort((which, keys))
    new_key = np.append(True, keys[order][1:] != keys[order][:-1])
    new = new_key | np.append(True, which[order][1:] != which[order][:-1])
    group = np.cumsum(new_key) - 1
    df = np.empty(len(v), np.int64)
    df[order] = np.bincount(group, weights=new).astype(np.int64)[group]
    return v, keys, df


def _homes(v: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, home): rows by the group in which a set's parts come together again."""
    home = (v.view(U64) % U64(parts)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, home[order]


def shared_counts(sets: DataFrame, parts: int) -> DataFrame:
    """(v, hits): how many hashes of each set (v, hashes) another set holds; sets without one are absent."""

    def meet(table: pa.Table) -> pa.Table:
        v, _, df = _met(table)
        v, n = np.unique(v[df > 1], return_counts=True)
        order, home = _homes(v, parts)
        homes, (own, counts) = _blobs(home, (v[order], n[order].astype(np.uint32)))
        return pa.table({"home": pa.array(homes, pa.int64()), "sets": own, "counts": counts})

    def gather(table: pa.Table) -> pa.Table:
        v = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("sets").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        own, which = np.unique(v, return_inverse=True)
        return pa.table({"v": own, "hits": np.bincount(which, weights=n, minlength=len(own)).astype(np.int64)})

    met = _dealt(sets, parts).groupBy("part").applyInArrow(meet, "home long, sets binary, counts binary")
    return met.groupBy("home").applyInArrow(gather, "v long, hits long")


def shared_tokens(sets: DataFrame, parts: int) -> DataFrame:
    """(v, tokens): the names (`tokens_of`) of the hashes of each set that another set holds."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        v, keys, df = _met(table)
        v, keys = v[df > 1], keys[df > 1]
        token = keys.astype(np.int64) << (parts.bit_length() - 1) | key[0].as_py()
        order, home = _homes(v, parts)
        homes, (own, tokens) = _blobs(home, (v[order], token[order]))
        return pa.table({"home": pa.array(homes, pa.int64()), "sets": own, "tokens": tokens})

    def gather(table: pa.Table) -> pa.Table:
        v, token = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("sets", "tokens"))
        order = np.lexsort((token, v))
        own, (tokens,) = _blobs(v[order], (token[order],))
        return pa.table({"v": own, "tokens": tokens})

    met = _dealt(sets, parts).groupBy("part").applyInArrow(meet, "home long, sets binary, tokens binary")
    return met.groupBy("home").applyInArrow(gather, "v long, tokens binary")


def frequency_class(df: np.ndarray) -> np.ndarray:
    """0 for a hash that one set holds alone; above, eight classes for each doubling of the sets that hold it."""
    return np.where(df > 1, 1 + np.floor(8 * np.log2(np.maximum(df, 1))), 0).astype(np.uint8)


def with_classes(sets: DataFrame, parts: int, use: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Rows that `use(v, size, hashes, classes)` makes of many sets (v, hashes) at once.

    hashes are those of the sets one after another, `size` of each, in ascending order; classes are their `frequency_class`
    among all sets, which depends on the hash alone. Repeats of a set are passed once.
    """

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        v, _, df = _met(table)
        own, at, n = np.unique(v, return_index=True, return_counts=True)
        # a set's tokens are one run: they came in one block
        order, home = _homes(own, parts)
        per_set = frequency_class(df)[ranges(at[order], n[order])]
        ends = np.append(0, np.cumsum(n[order]))
        homes, first = np.unique(home, return_index=True)
        stops = np.append(first, len(home))[1:]
        blobs = [pa.array(x, pa.binary()) for x in zip(*[(own[order][a:b].tobytes(), n[order][a:b].astype(np.uint32).tobytes(), per_set[ends[a] : ends[b]].tobytes()) for a, b in zip(first, stops, strict=True)], strict=True)]
        return pa.table({"home": pa.array(homes, pa.int64()), "part": pa.array(np.full(len(homes), key[0].as_py()), pa.int32()), "sets": blobs[0], "counts": blobs[1], "classes": blobs[2]})

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        v, first = np.unique(left.column("v").to_numpy(), return_index=True)
        held = left.column("hashes")
        held = [np.frombuffer(held[int(i)].as_py(), U64) for i in first]
        size = np.array([len(x) for x in held], np.int64)
        hashes = np.concatenate(held) if held else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(v)), size)
        place = np.lexsort((hashes, hashes & U64(parts - 1), owner))
        told = [(np.repeat(np.frombuffer(s, np.int64), c := np.frombuffer(n, np.uint32)), np.full(int(c.sum()), p), np.frombuffer(k, np.uint8)) for s, n, k, p in zip(*(right.column(x).to_pylist() for x in ("sets", "counts", "classes", "part")), strict=True)]
        classes = np.zeros(len(hashes), np.uint8)
        if told:
            whose, part, kind = (np.concatenate(x) for x in zip(*told, strict=True))
            classes[place] = kind[np.lexsort((part, np.searchsorted(v, whose)))]
        return use(v, size, hashes, classes)

    met = _dealt(sets.select("v", "hashes"), parts).groupBy("part").applyInArrow(meet, "home long, part int, sets binary, counts binary, classes binary")
    # v modulo parts, v read as unsigned: parts is a power of two
    at_home = sets.select("v", "hashes", F.col("v").bitwiseAND(F.lit(parts - 1)).alias("home"))
    return at_home.groupBy("home").cogroup(met.groupBy("home")).applyInArrow(gather, schema)
