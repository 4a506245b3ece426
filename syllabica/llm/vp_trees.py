"""Nearest neighbours by vantage-point trees, one per shard.

Unit vectors are compared by distance, whose order is that of the cosine. A tree
splits rows at the median distance from a vantage point; a side that the
triangle inequality places further away than the k-th neighbour so far is left
out. ``factor`` scales that distance: 1 is exact, less leaves out more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, searched, usable

_SLACK = 1e-7


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal vectors give equal results."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component below 1: cosines stay, squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class VantagePointTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 128, factor: float = 1) -> None:
        self.ids, self.raw, self.leaf, self.factor = ids, levelled(vectors), leaf, factor
        self.unit = self.raw / np.linalg.norm(self.raw, axis=1, keepdims=True)
        self.root = self._build(np.argsort(ids, kind="stable"))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        centre = self.unit[rows].mean(axis=0)
        vantage = self.unit[rows[np.argmin(self.unit[rows] @ centre)]]
        distance = self._distance(self.unit[rows], vantage[None])[:, 0]
        rows, distance = rows[order := np.argsort(distance, kind="stable")], distance[order]
        half = len(rows) // 2
        bounds = [(float(d[0]), float(d[-1])) for d in (distance[:half], distance[half:])]
        return vantage, bounds, [self._build(rows[:half]), self._build(rows[half:])]

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Query ids, row ids and cosines of the k nearest rows of each query; none has the query's id."""
        self.q_ids, self.q_raw, self.k = query_ids, levelled(queries), k
        self.q = self.q_raw / np.linalg.norm(self.q_raw, axis=1, keepdims=True)
        n = len(queries)
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(n))
        at, _ = np.nonzero(self.score > -np.inf)
        hit = self.score > -np.inf
        return [query_ids[at], self.found[hit], self.score[hit]]

    def _visit(self, node: tuple, asking: np.ndarray) -> None:
        if not len(asking):
            return
        if len(node) == 1:
            return self._look(node[0], asking)
        vantage, bounds, sides = node
        distance = self._distance(self.q[asking], vantage[None])[:, 0]
        gap = np.stack([np.maximum(0, np.maximum(low - distance, distance - high)) for low, high in bounds])
        nearer = gap.argmin(axis=0)
        for turn in (0, 1):
            for side in (0, 1):
                here = nearer == side if turn == 0 else nearer != side
                reach = np.sqrt(np.maximum(0, 2 - 2 * self.score[asking, -1])) * self.factor + _SLACK
                self._visit(sides[side], asking[here & (gap[side] <= reach)])

    def _look(self, rows: np.ndarray, asking: np.ndarray) -> None:
        near = self.q[asking] @ self.unit[rows].T
        q, r = np.nonzero(near >= self.score[asking, -1][:, None] - _SLACK)
        q, r = asking[q], rows[r]
        other = self.q_ids[q] != self.ids[r]
        q, r = q[other], r[other]
        q = np.concatenate([q, np.repeat(asking, self.k)])
        score = np.concatenate([cosine(self.q_raw[q[: len(r)]], self.raw[r]), self.score[asking].ravel()])
        ids = np.concatenate([self.ids[r], self.found[asking].ravel()])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.found[q[keep], rank[keep]] = score[keep], ids[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 0.25, leaf: int = 128, per_shard: int = 8192,
            per_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: k near neighbours of each query by cosine.

    ``is_query`` is a condition on ``id``; a query never finds its own id; ties go
    to the smaller id. Every row is indexed. Null or zero vectors and vectors that
    hold null or non-finite components take no part; vectors of another length
    than a query's aren't its candidates. ``factor`` 1 gives the exact neighbours.
    Rows repeated with one id are one candidate each; query rows repeated with one id
    are ranked together, so a candidate is listed once for each of them. ``per_shard`` bounds the
    rows of a tree on average, ``per_block`` the queries that search it at a time.
    """
    rows = usable(vectors, id_col, vector_col).where(F.exists("vec", lambda x: x != 0))
    return best(searched(rows, is_query, k, per_shard, per_block, lambda ids, values: VantagePointTree(ids, values, leaf, factor), "double"), k)
