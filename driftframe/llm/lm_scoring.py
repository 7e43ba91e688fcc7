"""Cross-entropy difference of matched n-gram models.

The target model is counted on documents of the wanted kind, the background model on all documents; they share one vocabulary, all words
of these. Both have exact counts of all words and bigrams, by 64-bit hash, so the models grow with the corpus and never lie in one
place: each group of documents sends its distinct keys with their counts, a range of keys is summed at once, and each group gets the
sums of its own keys back. A key comes once from a group however common it is. A document's score is the mean over its tokens of the
background's loss less the target's, in nats: higher is nearer to the target.

The models are matched. Each document is scored by models without it: its own counts are taken out of both, so that having been counted
is no merit. The background's counts are scaled to the target's number of tokens, as if it were an even sample of that size, and both
models back off alike, from bigrams to words to the uniform, so that what neither has seen says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import group_count, is_small, partitions, text_bytes, texts
from .run_length_index import _column, cuts

#: Added to the count of each word; occurrences of a word that its model of what follows it is backed off by.
WORD_PRIOR = 0.5
BIGRAM_PRIOR = 5.0

#: Ids (8 bytes each) of target documents that are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

SCHEMA = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token and of it with the one before, whether it has a token before it, and the first token of each document."""
    lowered = K.LOWER[data]
    start, end, first = K.words(lowered, offsets)
    word = K.range_hash(K.prefix_hash(lowered), start, end)
    after = np.ones(len(word), dtype=bool)
    after[first[:-1][np.diff(first) > 0]] = False
    pair = np.zeros(len(word), dtype=np.uint64)
    pair[1:] = K.mix(word[:-1] * K.U64(3) + K.mix(word[1:]))
    return word, pair, after, first


def _marked(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, wanted) of all documents."""
    ids = wanted.select("doc_id").where("doc_id is not null").distinct().withColumn("wanted", F.lit(True))
    joined = texts(documents).join(F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids, "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))


def _group(table: pa.Table) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """A group's tokens by pieces, and its distinct words and pairs in order with how often target and all documents hold them."""
    data, offsets = K.buffers(table.column("text"))
    wanted = np.asarray(table.column("wanted").to_numpy(), dtype=bool)
    parts, keys, own = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i, j, part, offs in K.pieces(data, offsets):
        word, pair, after, first = _hashes(part, offs)
        mask = np.repeat(wanted[i:j], np.diff(first))
        parts.append((i, j, word, pair, after, first))
        keys += [word, pair[after]]
        own += [word[mask], pair[mask & after]]
    known, background = np.unique(np.concatenate(keys), return_counts=True)
    held, times = np.unique(np.concatenate(own), return_counts=True)
    target = np.zeros(len(known), dtype=np.int64)
    target[np.searchsorted(known, held)] = times
    return parts, known, target, background.astype(np.int64)


def _numbers(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x.as_py()), dtype=np.int64) for c in table.column(name).chunks for x in c]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


_USES = ("bucket long, g long, keys binary, target binary, background binary", ("bucket", "g", "keys", "target", "background"), (pa.int64(), pa.int64(), *[pa.binary()] * 3))
_SUMS = ("bucket long, g long, target binary, background binary", ("bucket", "g", "target", "background"), (pa.int64(), pa.int64(), *[pa.binary()] * 2))


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=list(names))


def _uses(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """For each bucket of the key space, the group's distinct keys and their counts."""
        _, known, target, background = _group(table)
        g = table.column("g")[0].as_py()
        return _rows([(b, g, known[s].tobytes(), _pack(target[s]), _pack(background[s])) for b, s in cuts(known, buckets)], *_USES[1:])

    return run


def _sums(table: pa.Table) -> pa.Table:
    """For each group, the counts of its keys over all groups, in the order of its keys; a key that no other group holds has 0."""
    keys = _column(table, "keys")
    size = np.cumsum([0] + [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    width = np.diff(np.append(head, len(key)))
    out = []
    for name in ("target", "background"):
        total = np.add.reduceat(np.concatenate(_numbers(table, name))[order], head)
        own = np.empty(len(key), dtype=np.int64)
        own[order] = np.repeat(np.where(width > 1, total, 0), width)
        out.append([_pack(own[a:b]) for a, b in zip(size[:-1], size[1:], strict=True)])
    return _rows(list(zip(table.column("bucket").to_pylist(), table.column("g").to_pylist(), *out, strict=True)), *_SUMS[1:])


def _within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token's document has it."""
    _, at, times = np.unique(K.keyed(hashes, doc), return_inverse=True, return_counts=True)
    return times[at]


def _losses(counts: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], total: np.ndarray, scale: float, vocabulary: int, after: np.ndarray) -> np.ndarray:
    """The loss of each token in a model without its document.

    counts: of the word, and of it with the one before, in all documents of the model; own: in the token's document, 0 if that is not of the
    model; total: tokens of the model's other documents; scale: by which all are multiplied.
    """
    words = scale * (counts[0] - own[0])
    single = (words + WORD_PRIOR) / (scale * total + WORD_PRIOR * max(1, vocabulary))
    before = np.zeros(len(words))
    before[1:] = words[:-1]
    pairs = np.where(after, scale * (counts[1] - own[1]), 0)
    both = (pairs + BIGRAM_PRIOR * single) / (before + BIGRAM_PRIOR)
    return -np.log(np.where(after, both, single))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each piece, with their counts."""
    for batch in batches:
        wanted = np.asarray(batch.column("wanted").to_numpy(zero_copy_only=False), dtype=bool)
        data, offsets = K.buffers(batch.column("text"))
        for i, j, part, offs in K.pieces(data, offsets):
            lowered = K.LOWER[part]
            start, end, first = K.words(lowered, offs)
            known, at = np.unique(K.range_hash(K.prefix_hash(lowered), start, end), return_inverse=True)
            own = np.repeat(wanted[i:j], np.diff(first))
            columns = [known.astype(np.int64), np.bincount(at[own], minlength=len(known)), np.bincount(at, minlength=len(known))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "target", "background"])


def scores(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of each document of ``documents`` (doc_id, text, ...), the target being those of ``wanted`` (doc_id).

    A document without a word, or null, has no tokens and losses and score 0; a very long one is scored whole. Rows that tie or repeat a
    doc_id, or have none, count and are scored each, each without itself only; other columns are ignored, whatever their names; an empty table
    gives no rows. Without target documents both models are uniform and all scores 0.
    """
    marked = _marked(documents, wanted)
    words = marked.select("text", "wanted").mapInArrow(_word_counts, "word long, target long, background long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    size = words.agg(F.count("*").alias("words"), F.sum("target").alias("target"), F.sum("background").alias("background")).first()
    vocabulary, totals = size["words"], (size["target"] or 0, size["background"] or 0)
    groups = group_count(text_bytes(texts(documents)))
    docs = marked.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")).repartition(partitions(groups), "g")
    by = lambda: docs.select(*(F.col(c).alias(c) for c in ("doc_id", "text", "wanted", "g"))).groupBy("g")
    sums = by().applyInArrow(_uses(groups), _USES[0]).groupBy("bucket").applyInArrow(_sums, _SUMS[0])

    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        parts, known, target, background = _group(docs)
        by_bucket = sums.sort_by("bucket")
        models = []
        for own, name in ((target, "target"), (background, "background")):
            models.append((own, np.concatenate([np.zeros(0, np.int64), *_numbers(by_bucket, name)])))
        shared = models[1][1] > 0  # else the group's own counts are all
        counts = [np.where(shared, everywhere, own) for own, everywhere in models]
        wanted = np.asarray(docs.column("wanted").to_numpy(), dtype=bool)
        scales = (1.0, totals[0] / max(1, totals[1]))
        out = []
        for i, j, word, pair, after, first in parts:
            n, doc, means = np.diff(first), K.owner(first), []
            at, both = np.searchsorted(known, word), np.zeros(len(word), dtype=np.int64)
            both[after] = np.searchsorted(known, pair[after])
            within = _within(word, doc), np.zeros(len(word), dtype=np.int64)
            within[1][after] = _within(pair[after], doc[after])
            for c, total, scale, counted in zip(counts, totals, scales, (wanted[i:j], np.ones(j - i, bool)), strict=True):
                of_model = counted[doc]
                loss = _losses((c[at], c[both]), tuple(np.where(of_model, x, 0) for x in within), total - np.where(of_model, n[doc], 0), scale, vocabulary, after)
                run_sum = np.concatenate([[0], np.cumsum(loss)])
                means.append((run_sum[first[1:]] - run_sum[first[:-1]]) / np.maximum(n, 1))
            out.append(pa.table([docs.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(means[0]), pa.array(means[1]), pa.array(means[1] - means[0])], names=names))
        return pa.concat_tables(out)

    return by().cogroup(sums.groupBy("g")).applyInArrow(run, SCHEMA)


def cross_entropy_difference(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents against a target of those labelled good."""
    return scores(documents, labels.where("quality = 1"))
