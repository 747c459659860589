"""Operator 6: approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.vectors import merged, tiled, usable

LEAF = 32
#: Levels of the tree that are opened in one step, and rows that are verified in one step.
LEVELS = 4
VERIFIED = 256


def chi_square(x: float, m: int) -> float:
    """Distribution function of chi-square with m degrees of freedom, m even."""
    half = x / 2
    if half > 700:
        return 1.0
    term = total = 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


class Tree:
    """A kd-tree over projected points: boxes of nodes, and rows of leaves."""

    def __init__(self, points: np.ndarray):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.rows: list[np.ndarray] = []
        self.opened: dict[int, np.ndarray] = {}
        if len(points):
            self._add(points, np.arange(len(points)))

    def _add(self, points: np.ndarray, rows: np.ndarray) -> int:
        me, own = len(self.low), points[rows]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append((-1, -1))
        self.rows.append(rows)
        spread = self.high[me] - self.low[me]
        if len(rows) > LEAF and spread.max() > 0:
            half = len(rows) // 2
            order = np.argpartition(own[:, spread.argmax()], half)
            self.rows[me] = rows[:0]
            self.children[me] = (self._add(points, rows[order[:half]]), self._add(points, rows[order[half:]]))
        return me

    def below(self, node: int) -> np.ndarray:
        """The nodes LEVELS under a node, and leaves that come earlier."""
        if node not in self.opened:
            nodes = [node]
            for _ in range(LEVELS):
                nodes = [c for n in nodes for c in (self.children[n] if self.children[n][0] >= 0 else (n,))]
            self.opened[node] = np.array(nodes)
        return self.opened[node]


def nearest(queries: DataFrame, candidates: DataFrame, *, k: int = 10, dims: int = 8, confidence: float = 0.98, seed: int = 6, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by Euclidean distance, nearest first.

    Vectors are projected to `dims` (even) dimensions by a seeded Gaussian, that is 2-stable, matrix and
    each shard indexes its projected candidates in a kd-tree. A search takes leaves in the order of
    projected distance and verifies their rows, some leaves at a time, by the true distance. It ends when the chi-square
    test holds: a row as near as the present k-th would, with probability `confidence`, have been
    projected nearer than every leaf left. There is no cap on leaves, so each true neighbour is
    missed with probability 1 - confidence at most.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id; a query isn't its own candidate; only vectors of its length are. Ties go to the
    smaller vec_id. Repeated candidate rows count each; equal query rows are asked once. Empty
    tables give an empty result.
    """

    def top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        draw = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], dims))
        points, starts = vectors @ draw, asked @ draw
        tree = Tree(points)
        low, high = (np.array(x).reshape(-1, dims) for x in (tree.low, tree.high))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def far(nodes: np.ndarray, start: np.ndarray) -> list[float]:
            """Squared projected distances from the start to the nodes' boxes."""
            gap = np.maximum(np.maximum(low[nodes] - start, start - high[nodes]), 0)
            return (gap * gap).sum(1).tolist()

        root = np.zeros(1, np.int64)
        for q in range(len(asked) if len(ids) else 0):
            heap = [(far(root, starts[q])[0], 0)]
            rows, dist = np.zeros(0, np.int64), np.zeros(0)
            waiting: list[np.ndarray] = []
            many = 0
            while True:
                # what waits didn't pass the test; verifying it brings the k-th nearer, so a test that holds goes on holding
                ends = not heap or (len(rows) == k and heap[0][0] > 0 and (dist[-1] == 0 or chi_square(heap[0][0] / dist[-1], dims) >= confidence))
                if waiting and (ends or many >= VERIFIED):
                    new = np.concatenate(waiting)
                    new = new[ids[new] != query_ids[q]]
                    delta = vectors[new] - asked[q]
                    apart = np.einsum("ij,ij->i", delta, delta)
                    if len(rows) == k:
                        near = apart <= dist[-1]
                        new, apart = new[near], apart[near]
                    rows, dist = np.concatenate([rows, new]), np.concatenate([dist, apart])
                    best = np.lexsort((ids[rows], dist))[:k]
                    rows, dist = rows[best], dist[best]
                    waiting, many = [], 0
                    if not ends:
                        continue
                if ends:
                    break
                node = heapq.heappop(heap)[1]
                if tree.children[node][0] < 0:
                    waiting.append(tree.rows[node])
                    many += len(tree.rows[node])
                    continue
                boxes = tree.below(node)  # a box's distance is taken when what holds it is opened
                for box in zip(far(boxes, starts[q]), boxes.tolist(), strict=True):
                    heapq.heappush(heap, box)
            out.append((np.full(len(rows), q), rows, np.sqrt(dist)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    queries, candidates = (usable(x, id_col, vec_col, allow_zero=False) for x in (queries, candidates))
    found, shards = tiled(queries, candidates, top, "float64", "double")
    best = merged(found, shards, k, [F.asc("score"), F.asc("vec_id")])
    return best.select("query_id", "rank", "vec_id", "score")
