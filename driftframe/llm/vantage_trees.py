"""Approximate nearest neighbours by inner product, with vantage-point trees.

Rows are dealt out to shards; each shard has a tree of its own. A shard's vectors get one more component so that all have the norm of
the longest, and a query is scaled to it: then the largest inner product is the least Euclidean distance, and the triangle inequality
holds. A node divides its rows by their distance from a vantage point and keeps the range of distances of either side; a side is
left out for a query if FACTOR times the least distance that the inequality allows there exceeds the query's so far last neighbour.
Factor one leaves out nothing that could count, so it searches exactly; larger ones leave out more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import grid, matrix, numbers, one_size, usable

#: Queries have an id that QUERY_STEP divides; so many neighbours of each.
QUERY_STEP = 20
NEIGHBOURS = 20
#: By how much the pruning is relaxed; one searches exactly.
FACTOR = 1.5
#: Rows of a leaf. Rows of which a vantage point is chosen, the one that spreads the others most, and on how many of these that is measured.
LEAF = 256
CANDIDATES, SPREAD = 4, 64
#: Queries that go through a tree at once.
QUERIES_AT_ONCE = 1_024
#: Part of a norm by which products of matrices may be off; what lies so near the last neighbour is computed anew.
SLACK = 1e-9

RESULT = "query_id long, vec_id long, score double"


class Tree:
    """A vantage-point tree of the rows of one shard, in arrays: a row range for each node, and two child nodes for inner ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.radius = float(np.sqrt(squares.max(initial=0)))
        raised = np.sqrt(np.maximum(self.radius**2 - squares, 0))
        self.points = np.hstack([vectors, raised[:, None]])
        self.vantage: list[np.ndarray | None] = []
        self.children: list[tuple[int, int]] = []
        self.spans: list[tuple[int, int]] = []
        self.ranges: list[tuple[float, float, float, float]] = []
        self.order = order
        self._grow(0, len(order), np.random.default_rng(len(order)))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        del self.points

    def _away(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.points[rows] - point, axis=1)

    def _grow(self, begin: int, end: int, rng: np.random.Generator) -> int:
        node = len(self.spans)
        self.spans.append((begin, end))
        self.vantage.append(None)
        self.children.append((-1, -1))
        self.ranges.append((0.0, 0.0, 0.0, 0.0))
        rows = self.order[begin:end]
        if len(rows) <= LEAF:
            return node
        some = rng.choice(rows, min(SPREAD, len(rows)), replace=False)
        best = max(rng.choice(rows, CANDIDATES, replace=False), key=lambda r: self._away(some, self.points[r]).std())
        point = self.points[best]
        away = self._away(rows, point)
        by = np.argsort(away, kind="stable")
        self.order[begin:end] = rows[by]
        away, half = away[by], len(rows) // 2
        self.vantage[node] = point
        self.ranges[node] = (away[0], away[half - 1], away[half], away[-1])
        self.children[node] = (self._grow(begin, begin + half, rng), self._grow(begin + half, end, rng))
        return node

    def search(self, ids: np.ndarray, queries: np.ndarray, factor: float, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the n nearest of each query, nearest first, a place that stays empty with -inf; and how often a row was compared."""
        norms = np.linalg.norm(queries, axis=1)
        lifted = np.hstack([queries * (self.radius / norms)[:, None], np.zeros((len(queries), 1))])
        found = _Found(len(queries), n)
        compared = 0

        def away(node: int, active: np.ndarray) -> np.ndarray:
            return np.linalg.norm(lifted[active] - self.vantage[node], axis=1)

        def scan(node: int, active: np.ndarray) -> None:
            nonlocal compared
            begin, end = self.spans[node]
            compared += len(active) * (end - begin)
            found.add(active, ids, queries, norms, self.ids[begin:end], self.vectors[begin:end], self.radius)

        home = np.zeros(len(queries), dtype=np.int64)

        def descend(node: int, active: np.ndarray) -> None:
            """Each query to the leaf where it would lie itself."""
            if not len(active):
                return
            if self.vantage[node] is None:
                home[active] = node
                scan(node, active)
                return
            inner = away(node, active) <= (self.ranges[node][1] + self.ranges[node][2]) / 2
            descend(self.children[node][0], active[inner])
            descend(self.children[node][1], active[~inner])

        def visit(node: int, active: np.ndarray) -> None:
            """Queries that may have neighbours below a node, but for the leaves where they have been."""
            if not len(active):
                return
            if self.vantage[node] is None:
                scan(node, active[home[active] != node])
                return
            d = away(node, active)
            for side, (least, most) in enumerate((self.ranges[node][:2], self.ranges[node][2:])):
                bound = np.maximum(np.maximum(least - d, d - most), 0)
                # the last neighbour's score as a distance on the sphere
                last = np.sqrt(np.maximum(2 * self.radius * (self.radius - found.last[active] / norms[active]), 0))
                visit(self.children[node][side], active[factor * bound <= last + SLACK * self.radius])

        every = np.arange(len(queries))
        descend(0, every)
        visit(0, every)
        return found.scores, found.ids, compared


class _Found:
    """The nearest rows so far of each query."""

    def __init__(self, queries: int, n: int) -> None:
        self.scores = np.full((queries, n), -np.inf)
        self.ids = np.full((queries, n), np.iinfo(np.int64).max)
        self.last = np.full(queries, -np.inf)

    def add(self, active: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, norms: np.ndarray, ids: np.ndarray, vectors: np.ndarray, radius: float) -> None:
        if not len(active) or not len(ids):
            return
        rough = queries[active] @ vectors.T
        slack = SLACK * norms[active] * radius
        n = self.scores.shape[1]
        floor = self.last[active]
        if len(ids) > n:  # no row below the n-th of the leaf counts either; one more, as a query's own row is no neighbour of it
            floor = np.maximum(floor, -np.partition(-rough, n, axis=1)[:, n] - slack)
        q, r = np.nonzero((rough >= (floor - slack)[:, None]) & (query_ids[active][:, None] != ids[None, :]))
        if not len(q):
            return
        score = exact(queries[active[q]], vectors[r])
        width = np.bincount(q, minlength=len(active))
        place = np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width)
        s = np.full((len(active), n + width.max()), -np.inf)
        k = np.full(s.shape, np.iinfo(np.int64).max)
        s[:, :n], k[:, :n] = self.scores[active], self.ids[active]
        s[q, n + place], k[q, n + place] = score, ids[r]
        by = np.lexsort((k, -s), axis=1)[:, :n]
        self.scores[active], self.ids[active] = np.take_along_axis(s, by, 1), np.take_along_axis(k, by, 1)
        self.last[active] = self.scores[active, -1]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed up component by component, so that equal vectors have equal scores wherever they lie."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _neighbours(size: int, factor: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The nearest rows of a cell of each of its queries."""
        out: list[list] = [[], [], []]
        if len(rows) and len(queries):
            tree = Tree(numbers(rows, "vec_id"), matrix(rows, size))
            ids, vectors = numbers(queries, "vec_id"), matrix(queries, size)
            for k in range(0, len(ids), QUERIES_AT_ONCE):
                own = ids[k : k + QUERIES_AT_ONCE]
                scores, found, _ = tree.search(own, vectors[k : k + QUERIES_AT_ONCE], factor, NEIGHBOURS)
                filled = scores > -np.inf
                for column, x in zip(out, (np.repeat(own, filled.sum(axis=1)), found[filled], scores[filled]), strict=True):
                    column.append(x)
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.table([pa.array(np.concatenate([np.zeros(0, t), *c]), type=pa.from_numpy_dtype(t)) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)], names=names)

    return run


def nearest_neighbours(embeddings: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``embeddings`` (vec_id, embedding) with the largest inner products with each query.

    Rows without an id or vector, with an empty or zero vector or a null or non-finite component take no part. Ties go to the smaller vec_id.
    Of rows with equal vectors, those of the smallest ids stand for all, one more than there are neighbours, so that a query is never among
    its own; no other can be a neighbour. Rows that repeat an id are one row, that of the least vector. A table of fewer rows than neighbours
    gives all; an empty one gives none. Vectors of any length are compared whole; several lengths in one table are an error.
    Other columns are ignored, whatever their names. ``factor`` (1 or more) relaxes the pruning; 1 is exact.
    """
    if factor < 1:
        raise ValueError("a factor below 1 prunes less than the exact search")
    rows = usable(embeddings).where(F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = materialize(rows, "vectors", compact=False)
    size = one_size(rows)
    equal = Window.partitionBy("vector").orderBy("vec_id")
    index = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= NEIGHBOURS + 1).drop("copy")
    left, right = (t.groupBy("shard", "band") for t in grid(index, rows.where(F.col("vec_id") % QUERY_STEP == 0), size))
    found = left.cogroup(right).applyInArrow(_neighbours(size, factor), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
