"""Operator 2: exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.vectors import best_of_tile, merged, tiled, usable

#: Scores held at once in a tile.
CELLS = 1 << 22


def quantised(rows: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): each component x as floor(scale * x), a long."""
    rows = usable(rows, id_col, vec_col)
    return rows.select("vec_id", F.transform("vec", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec"))


def exact_top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, all if fewer.

    Both frames hold (vec_id, vec of longs) as `quantised` gives them. Ties go to the smaller vec_id. A
    query isn't its own candidate. Vectors of unequal length have no product. Candidate rows
    repeated under one id are candidates each; a query id with two vectors is asked with each, and
    its lists then show by repeated ranks; equal query rows are asked once. Empty tables give an
    empty result.

    Each block of queries meets each shard of candidates in one task as a matrix product, which
    keeps k candidates a query; the lists are merged in a tree of fan-in 16. Products are taken in
    doubles where every sum stays below 2**53, and in longs otherwise, so they are exact.
    """

    def top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
        exact = np.float64 if most < 2**53 else np.int64
        right = vectors.T.astype(exact)
        out = []
        step = max(1, CELLS // max(len(ids), 1))
        for at in range(0, len(queries), step):
            scores = queries[at : at + step].astype(exact) @ right
            kept = scores.astype(np.float64) if exact is np.float64 else scores.astype(np.longdouble)
            kept[query_ids[at : at + step, None] == ids[None, :]] = -np.inf
            i, j = best_of_tile(kept, k)
            out.append((i + at, j, scores[i, j].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    found, shards = tiled(queries, candidates, top, "int64", "long")
    best = merged(found, shards, k, [F.desc("score"), F.asc("vec_id")])
    return best.select("query_id", "rank", "vec_id", "score")
