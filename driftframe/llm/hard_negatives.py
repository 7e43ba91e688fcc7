"""Hard negatives by exact integer products in a residue number system.

Components are integers. For each of a few small primes both matrices are reduced to remainders around zero, and multiplied in float32:
the products of up to ``CHUNK`` components sum up exactly there. Chinese remaindering (Garner's mixed radix) puts the exact signed scores
together again; as many primes are taken as the norms of the rows ask for. Rows meet anchors in the cells of a grid; a first pass finds each
anchor's positives, a second one the negatives in the windows that these set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import grid, matrix, numbers, one_size, usable

#: Anchors have an id that ANCHOR_STEP divides; so many positives of each, and negatives of each positive.
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies within these parts, in percent, of the positive's.
LOWEST, HIGHEST = 30, 90
#: Components are floor(SCALE * x).
SCALE = 256
#: Labels of rows whose id NOISE_STEP divides become the next of LABELS.
NOISE_STEP, LABELS = 7, 10
#: Scores beyond this size can't be told apart in 64 bits.
MOST = 1 << 59
#: Anchors that are multiplied with a shard at once: with 16 384 rows, 16 MB of scores a prime.
ANCHORS_AT_ONCE = 128


def _primes_below(n: int) -> Iterator[int]:
    for p in range(n - 1, 2, -1):
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            yield p


#: Remainders around zero are below 2**9, so their products are below 2**18, and float32 sums CHUNK of them exactly, to 2**24.
LARGEST_PRIME = 1 << 10
CHUNK = (1 << 24) // (LARGEST_PRIME // 2) ** 2


def moduli(bound: int) -> list[int]:
    """The largest primes whose product exceeds the number of integers from -bound to bound."""
    out, product = [], 1
    for p in _primes_below(LARGEST_PRIME):
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    return out


def _remainders(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders modulo p from -(p-1)/2 to (p-1)/2, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residues(x: np.ndarray, bound: int) -> list[tuple[int, np.ndarray]]:
    """The component matrix of each prime."""
    return [(p, _remainders(x, p)) for p in moduli(bound)]


def product(a: np.ndarray, b: list[tuple[int, np.ndarray]], bound: int) -> np.ndarray:
    """The exact integer products of the rows of a with those whose residues are b, none of which is beyond ``bound``."""
    out, radix = np.zeros((len(a), len(b[0][1])), dtype=np.int64), 1
    for p, right in b:
        left, total = _remainders(a, p), np.zeros(out.shape, dtype=np.int64)
        for k in range(0, a.shape[1], CHUNK):
            total += (left[:, k : k + CHUNK] @ right[:, k : k + CHUNK].T).astype(np.int64)
        total += bound % p  # remainders of score + bound, which is not negative
        total -= out % p  # Garner: the next mixed-radix digit is what the digits so far leave modulo p
        total %= p
        total *= pow(radix, -1, p)
        total %= p
        total *= radix
        out += total
        radix *= p
    out -= bound
    return out


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label with the stated noise, vector of integers) of the rows that take part."""
    rows = usable(embeddings, F.col("label").cast("long").alias("label")).where("label is not null")
    noisy = F.when(F.col("vec_id") % NOISE_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", noisy.alias("label"), F.transform("vector", lambda x: F.floor(x * float(SCALE)).cast("double")).alias("vector"))


def _bound(rows: DataFrame) -> int:
    """No score is beyond it: the largest squared norm, with room for its rounding (Cauchy and Schwarz)."""
    most = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"] or 0.0
    if most >= MOST:
        raise ValueError(f"scores up to {most:.3g} don't fit a 64-bit integer")
    return int(most * 1.001) + 1


def _scores(rows: pa.Table, anchors: pa.Table, size: int, bound: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of anchors with their scores of all rows."""
    a, b = matrix(anchors, size), residues(matrix(rows, size), bound)
    for k in range(0, len(a), ANCHORS_AT_ONCE):
        yield slice(k, k + ANCHORS_AT_ONCE), product(a[k : k + ANCHORS_AT_ONCE], b, bound)


POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def _table(schema: str, columns: list) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    whole = [np.concatenate([np.zeros(0, np.int64), *own]) for own in columns]
    return pa.table([pa.array(c, pa.int64()) for c in whole], names=names)


def _positives(size: int, bound: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        """The first rows of the anchor's label in this cell."""
        out: list[list] = [[], [], []]
        if len(rows) and len(anchors):
            rows = rows.sort_by("vec_id")
            ids, labels = numbers(rows, "vec_id"), numbers(rows, "label")
            for part, scores in _scores(rows, anchors, size, bound):
                for anchor, label, own in zip(numbers(anchors, "vec_id")[part], numbers(anchors, "label")[part], scores, strict=True):
                    same = np.flatnonzero((labels == label) & (ids != anchor))
                    first = same[np.argsort(-own[same], kind="stable")[:POSITIVES]]
                    for column, x in zip(out, (np.full(len(first), anchor), ids[first], own[first]), strict=True):
                        column.append(x)
        return _table(POSITIVE, out)

    return run


def _windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative, exactly, without a product that could overflow."""
    q, r = np.divmod(positive, 100)
    return q * LOWEST + -(-(r * LOWEST) // 100), q * HIGHEST + r * HIGHEST // 100


def _negatives(size: int, bound: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        """The first rows of other labels in each positive's window in this cell."""
        out: list[list] = [[], [], [], [], []]
        if len(rows) and len(anchors):
            rows = rows.sort_by("vec_id")
            ids, labels = numbers(rows, "vec_id"), numbers(rows, "label")
            positives = anchors.column("positives").to_pylist()
            for part, scores in _scores(rows, anchors, size, bound):
                for anchor, label, found, own in zip(numbers(anchors, "vec_id")[part], numbers(anchors, "label")[part], positives[part], scores, strict=True):
                    other = np.flatnonzero(labels != label)
                    other = other[np.argsort(-own[other], kind="stable")]
                    falling = -own[other]
                    least, most = _windows(np.array([p["positive_score"] for p in found], dtype=np.int64))
                    begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    for p, a, b in zip(found, begin, end, strict=True):
                        first = other[a : min(b, a + NEGATIVES)]
                        for column, x in zip(out, (np.full(len(first), anchor), np.full(len(first), p["positive_id"]), ids[first], np.full(len(first), p["positive_score"]), own[first]), strict=True):
                            column.append(x)
        return _table(NEGATIVE, out)

    return run


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    """With ``rank``, the first n rows of each key; each partition drops what can't be among them before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive of ``embeddings`` (vec_id, embedding, label).

    Rows without an id, label or vector, with an empty vector or a null or non-finite component take no part. Ties go to the smaller
    vec_id; rows that repeat one are rows of their own, except as anchors, where the one of the least label and vector counts, and none of
    them is its anchor's positive. A positive with an empty window gives no rows,
    nor does an empty table; a zero vector has scores of 0. Vectors of any length are multiplied whole; vectors of several lengths in
    one table, or scores beyond 2**59, are an error. Other columns are ignored, whatever their names.
    """
    rows = integer_rows(embeddings)
    size, bound = one_size(rows), _bound(rows)
    anchors = rows.where(F.col("vec_id") % ANCHOR_STEP == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    cells = lambda a: [t.groupBy("shard", "band") for t in grid(rows, a, size)]
    left, right = cells(anchors)
    positives = _first(left.cogroup(right).applyInArrow(_positives(size, bound), POSITIVE), ["anchor_id"], "positive_score", "positive_id", POSITIVES)
    found = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # POSITIVES at most
    ready = materialize(anchors.join(found, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors")
    left, right = cells(ready)
    out = _first(left.cogroup(right).applyInArrow(_negatives(size, bound), NEGATIVE), ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
 FROM r a JOIN r ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
