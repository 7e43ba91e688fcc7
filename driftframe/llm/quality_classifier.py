"""Compression quality classifier.

Zstandard dictionaries are trained on good and on bad labelled text. A document is compressed in blocks
with either dictionary; the difference of the two sizes over the text's size, so that a long text counts as a short one,
goes through a logistic calibration that is fitted on labelled documents the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import texts

#: Labelled documents of each class that a fit reads at most, the part of them that trains dictionaries, and bytes of each of these
#: that it keeps, in blocks from all over the text.
SAMPLE_DOCS = 1500
DICTIONARY_PART = 0.6
SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Texts are compressed in blocks, as a dictionary helps only near a block's start.
BLOCK = 1024

SCHEMA = "doc_id long, score double, predicted int"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for d in (good, bad):
        own = zstandard.ZstdCompressionDict(d)
        own.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(made)


def difference(raw: bytes, good: bytes, bad: bytes) -> float:
    """What the bad dictionary's compressed size exceeds the good one's by, over the size; 0 without text."""
    by_good, by_bad = _compressors(good, bad)
    more = 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        more += len(by_bad.compress(block)) - len(by_good.compress(block))
    return more / len(raw) if len(raw) else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighing the same."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _blocks(raw: bytes, seed: int) -> list[bytes]:
    """Blocks of at most SAMPLE_BYTES in all, from places of ``raw`` that the seed chooses."""
    starts = np.arange(0, len(raw), BLOCK)
    if len(starts) > SAMPLE_BYTES // BLOCK:
        starts = np.sort(np.random.default_rng(seed & (2**63 - 1)).choice(starts, SAMPLE_BYTES // BLOCK, replace=False))
    return [raw[a : a + BLOCK] for a in starts.tolist()]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [_blocks(t.encode(), h) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), batch.column("doc_id"), pa.array(kept, pa.list_(pa.binary()))], names=["quality", "h", "doc_id", "blocks"])


def _differences(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch of (doc_id, text, ...) with the differences of its whole texts."""
    m = shared.value
    for batch in batches:
        data, offsets = K.buffers(batch.column("text").fill_null(""))
        raw = memoryview(data)
        yield batch, np.array([difference(raw[a:b], m.good, m.bad) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] if m.good else [0.0] * len(batch), dtype=float)
    K.release()


def _dictionary(blocks: list[bytes]) -> bytes:
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit(documents: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """Fit on at most SAMPLE_DOCS documents of each class of ``labels`` (doc_id, quality), chosen by a hash of doc_id.

    Rows with a null doc_id or quality are left out; of several labels of a document the largest counts, of several texts the least;
    a document without text is none. Dictionaries read SAMPLE_BYTES of a text, the calibration whole texts, in tasks. Where a class has one
    document, the calibration reads it too. Without a document of both classes the score is 0.5 everywhere.
    """
    spark = documents.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = None
    for quality in (0, 1):
        own = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE_DOCS)
        chosen = own if chosen is None else chosen.unionByName(own)
    labelled = texts(documents).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).where("text != ''")  # at most 2 * SAMPLE_DOCS rows
    rows = labelled.withColumn("h", F.xxhash64("doc_id", F.lit(seed + 1))).mapInArrow(_samples, "quality int, h long, doc_id long, blocks array<binary>").collect()
    by = {q: sorted(((r["h"], r["doc_id"], r["blocks"]) for r in rows if r["quality"] == q), key=lambda r: r[:2]) for q in (0, 1)}
    if not all(by.values()):
        return Model(b"", b"", (0.0, 0.0))
    cut = {q: max(1, int(len(by[q]) * DICTIONARY_PART)) for q in by}
    bad, good = (_dictionary([bytes(b) for _, _, blocks in by[q][: cut[q]] for b in blocks]) for q in (0, 1))
    model = Model(good, bad, (0.0, 0.0))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _differences(shared, batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(x)], names=["quality", "x"])

    unseen = spark.createDataFrame([(d,) for q in by for _, d, _ in by[q][cut[q] :] or by[q]], "doc_id long")
    held = labelled.join(F.broadcast(unseen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "quality int, x double").collect()
    weights = calibrate(np.array([(1.0, r["x"]) for r in held]), np.array([r["quality"] for r in held]))
    return Model(model.good, model.bad, tuple(map(float, weights)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each whole text of ``documents`` (doc_id, text, ...).

    score is in [0, 1], higher for better; predicted is 1 from 0.5. A null or empty text has the difference 0; a very long one is read
    block by block. Rows are scored each for itself, so rows that tie or repeat get the same score, one without a doc_id too; other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, slope = shared.value.weights
        for batch, x in _differences(shared, batches):
            out = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(documents).mapInArrow(run, SCHEMA)


def keep_predicted(documents: DataFrame, model: Model) -> DataFrame:
    """Rows of ``documents`` (text, ...), with all their columns, whose whole text is scored 0.5 or more; no shuffle. Odd rows as in ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, slope = shared.value.weights
        for batch, x in _differences(shared, batches):
            yield batch.filter(pa.array(bias + slope * x >= 0))

    return documents.mapInArrow(run, documents.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the training folds: all but those whose crc32 of the id's text is 1 modulo 3."""
    return labels.where(~held_out("doc_id"))


def held_out(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): ``score`` with a model fitted on the training folds."""
    scored = score(documents, fit(documents, training_labels(labels)))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
