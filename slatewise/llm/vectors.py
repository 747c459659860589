"""Tiles of query and candidate vectors, and merging of per-query top lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import shuffle_partitions, workers_see

#: Most rows of a query block and of a candidate shard.
BLOCK_ROWS = 16_384
#: Lists merged at once in each level of the tree.
FAN_IN = 16
TOP = "query_id long, query_key long, shard long, vec_id long, score {score}"


def usable(rows: DataFrame, id_col: str, vec_col: str, allow_zero: bool = True) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector of finite components, which for some uses isn't zero."""
    x = F.col(vec_col)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows if allow_zero else rows.filter(F.exists("vec", lambda v: v != 0))


def matrix(column: pa.ChunkedArray, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by length: (row numbers, matrix) for each length."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    begin = np.cumsum(sizes) - sizes
    return [(rows := np.flatnonzero(sizes == d), flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def best_of_tile(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest finite scores; ties go to the earlier column."""
    wide = scores.shape[1]
    if wide > k:
        floor = np.partition(scores, wide - k, axis=1)[:, wide - k]
        rows, cols = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], cols[place < k]


def tiled(queries: DataFrame, candidates: DataFrame, top: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, score: str) -> tuple[DataFrame, int]:
    """Run `top(ids, vectors, query_ids, query_vectors) -> (query row, candidate row, score)` on each tile.

    Candidates are dealt into shards and queries into blocks by hash; each block meets each shard
    in one task. Returns the tiles' lists and the number of shards.
    """
    spark = candidates.sparkSession
    workers_see(spark)
    n, q = candidates.count(), queries.count()
    shards = max(1, -(-n // BLOCK_ROWS), min(shuffle_partitions(spark), -(-n // 512)))
    blocks = max(1, -(-q // BLOCK_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = queries.dropDuplicates().select("vec_id", "vec", F.xxhash64("vec_id", "vec").alias("query_key"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block")).withColumn("shard", every(shards))
    # own names: both sides may come from one table, and a cogroup needs their columns apart
    right = candidates.select(F.col("vec_id").alias("c_id"), F.col("vec").alias("c_vec"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long").alias("shard")).withColumn("block", every(blocks))

    def tile(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        q_ids, q_keys = a.column("vec_id").to_numpy(), a.column("query_key").to_numpy()
        b = b.sort_by("c_id")
        ids = b.column("c_id").to_numpy()
        by_size = {m.shape[1]: (rows, m) for rows, m in matrix(b.column("c_vec"), kind)}
        for rows, m in matrix(a.column("vec"), kind):
            if m.shape[1] in by_size:
                own, vectors = by_size[m.shape[1]]
                i, j, s = top(ids[own], vectors, q_ids[rows], m)
                for name, x in (("query_id", q_ids[rows][i]), ("query_key", q_keys[rows][i]), ("vec_id", ids[own][j]), ("score", s)):
                    out[name].append(x)
        cols = {name: np.concatenate(x) if x else np.zeros(0, np.float64 if name == "score" and score == "double" else np.int64) for name, x in out.items()}
        return pa.table({"query_id": cols["query_id"], "query_key": cols["query_key"], "shard": np.full(len(cols["vec_id"]), key[0].as_py(), np.int64), "vec_id": cols["vec_id"], "score": cols["score"]})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(tile, TOP.format(score=score))
    return found, shards


def merged(lists: DataFrame, shards: int, k: int, order: list[Column]) -> DataFrame:
    """Merge the tiles' lists level by level, FAN_IN at a time; adds `rank` from 1."""
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("long"))
        by = Window.partitionBy("query_id", "query_key", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if shards <= 1:
            return lists
