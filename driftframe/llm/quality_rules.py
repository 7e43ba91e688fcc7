"""Quality rules: fixed base rules, and divergence of a document's histograms from those of languages.

A document's character-class and common-word histograms are compared with language references, counted by the
lang column over all documents that pass the base rules, by Jensen-Shannon distance. A text is kept if some language is
near in both; the limits are wider for short texts, and the shortest, too coarse to judge, pass. Every language with enough documents and
words has a reference. A text of any other is not judged by what it resembles, as a few documents can't vouch for themselves and other languages
say nothing of them: the base rules alone decide, and ``judged`` says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

#: Base rules: least words; largest percent of words in repeated three-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Words of a language's reference; documents and words, of those that pass the base rules, that a language must have for one.
COMMON_WORDS = 100
MIN_REFERENCE_DOCUMENTS = 10
MIN_REFERENCE_WORDS = 2_000
#: Languages that are compared at once, which bounds a task's arrays, and in one step, which bounds what is on the driver and broadcast (about 3 KB each).
LANGUAGES = 64
STEP_LANGUAGES = 8_192
#: Documents that are compared at once: with LANGUAGES * COMMON_WORDS counts of each, 26 MB.
PIECE_ROWS = 512
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of an endless text; what the root of the number of words, which shortens it, adds; least sizes.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.18, 0.6
MAX_WORD_DISTANCE, WORD_SLACK = 0.25, 2.0
MIN_CHARS = 200
MIN_COUNTED_WORDS = 60

#: Character classes: lower, upper, digit, white, sentence marks, symbols, other ASCII, all beyond ASCII; -1 continues a character.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[K.WHITE] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in SYMBOLS]] = 5
_CLASS[0x80:0xC0] = -1
_CLASS[0xC0:] = 7
CLASSES = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, judged boolean"
WORD = r"[^\x20\x09-\x0D]+"


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicates(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one earlier in their document, and which have one anywhere in it."""
    key = K.keyed(hashes, doc)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, shared = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return later, shared


def _lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, counted for each document."""
    breaks = np.flatnonzero(data == 10)
    filled = offsets[:-1][np.diff(offsets) > 0]
    start = np.sort(np.concatenate([filled, breaks + 1]))
    start = start[start < len(data)]
    start = start[np.concatenate([[True], start[1:] != start[:-1]])] if len(start) else start
    doc = np.searchsorted(offsets, start, side="right") - 1
    stop = np.append(breaks, len(data))[np.searchsorted(breaks, start)] if len(start) else start
    stop = np.minimum(stop, offsets[doc + 1])  # the next break or its own document's end, which may be where the line begins
    worded = np.searchsorted(word_start, stop) > np.searchsorted(word_start, start)
    start, stop, doc = start[worded], stop[worded], doc[worded]
    later, _ = _duplicates(K.range_hash(prefix, start, stop), doc)
    return np.bincount(doc[later], minlength=len(offsets) - 1)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def limits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest character and word distance of texts of n words."""
    root = np.sqrt(np.maximum(n, 1))
    return MAX_CHAR_DISTANCE + CHAR_SLACK / root, MAX_WORD_DISTANCE + WORD_SLACK / root


class Base:
    """Words of a run of documents, and the base rules' counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, self.first = K.words(data, offsets)
        prefix = K.prefix_hash(data)
        self.hashes = K.range_hash(prefix, start, end)
        self.n = np.diff(self.first)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.word_chars = _per_document(lead[end] - lead[start], self.first)
        self.symbols = _per_document(_SYMBOL[data], offsets)
        self.lines = _lines(data, offsets, start, prefix)
        windows, at, starts = K.shingles(self.hashes, self.first, 3, short=False)
        _, twice = _duplicates(windows, K.owner(starts))
        covered = np.zeros(len(start) + 1, dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        self.repeat = _per_document(covered[:-1], self.first)
        self.failed = (self.n < MIN_WORDS) | (100 * self.repeat > MAX_REPEAT_PERCENT * self.n)


class References:
    """Histograms of languages: character classes, and the commonest words with all others."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, dict[str, int]], totals: dict[str, int]) -> None:
        self.languages = sorted(k for k in chars if totals.get(k))
        raw = sorted({w for k in self.languages for w in words.get(k, {})})
        flat = "".join(raw).encode()
        edge = np.concatenate([[0], np.cumsum([len(w.encode()) for w in raw])]).astype(np.int64)
        data = np.frombuffer(flat, dtype=np.uint8)
        hashes = K.range_hash(K.prefix_hash(data), edge[:-1], edge[1:]) if raw else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, place = hashes[order], {raw[k]: n for n, k in enumerate(order)}
        self.chars = [chars[k] / max(1, chars[k].sum()) for k in self.languages]
        self.places = [np.array([place[w] for w in words.get(k, {})], dtype=np.int64) for k in self.languages]
        parts = [np.array(list(words.get(k, {}).values()), dtype=float) / totals[k] for k in self.languages]
        self.words = [np.append(p, max(0.0, 1 - p.sum())) for p in parts]

    def counts(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each document has each of the common words."""
        n, width = len(first) - 1, len(self.hashes)
        if not width:
            return np.zeros((n, 1))
        place = np.minimum(np.searchsorted(self.hashes, hashes), width - 1)
        known = self.hashes[place] == hashes
        return np.bincount((K.owner(first) * width + place)[known], minlength=n * width).reshape(n, width)

    def nearer(self, chars: np.ndarray, counts: np.ndarray, n: np.ndarray, c: np.ndarray, w: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character and word distance from the language that is nearest, against the limits of both; c, w and best are those so far."""
        char_limit, word_limit = limits(n)
        p = chars / np.maximum(1, chars.sum(axis=1, keepdims=True))
        for k in range(len(self.languages)):
            own = counts[:, self.places[k]] / np.maximum(1, n)[:, None]
            own = np.hstack([own, np.clip(1 - own.sum(axis=1, keepdims=True), 0, 1)])
            dc, dw = _distance(p, self.chars[k]), _distance(own, self.words[k])
            worst = np.maximum(dc / char_limit, dw / word_limit)
            near = worst < best
            c, w, best = np.where(near, dc, c), np.where(near, dw, w), np.minimum(best, worst)
        return c, w, best


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language: characters of each class, then documents, then words, of those that pass the base rules."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        language = batch.column("lang").to_pylist()
        data, offsets = K.buffers(batch.column("text"))
        for i, j, part, offs in K.pieces(data, offsets):
            base = Base(part, offs)
            rows = np.hstack([_histogram(part, offs), np.ones((j - i, 1), dtype=np.int64), base.n[:, None]])
            for d in np.flatnonzero(~base.failed):
                sums[language[i + d]] = sums.get(language[i + d], 0) + rows[d]
    for lang, row in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(row)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["lang", "class", "n"])


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that pass the base rules."""
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        passed = [~Base(part, offs).failed for _, _, part, offs in K.pieces(data, offsets)]
        yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *passed])))


def _histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * CLASSES
    return np.bincount((doc + kind)[kind >= 0], minlength=(len(offsets) - 1) * CLASSES).reshape(-1, CLASSES)


def references(documents: DataFrame) -> Iterator[list[References]]:
    """Of all documents that pass the base rules by lang, null as a language of its own: for each step, References of LANGUAGES languages each."""
    docs = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.mapInArrow(_char_counts, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("n"))
    counted = materialize(counted.where((F.col("n")[CLASSES] >= MIN_REFERENCE_DOCUMENTS) & (F.col("n")[CLASSES + 1] >= MIN_REFERENCE_WORDS)), "languages")
    words = docs.mapInArrow(_sound, docs.schema).select("lang", F.explode(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = words.join(counted.select("lang"), "lang", "left_semi").withColumn("at", F.row_number().over(rank)).where(F.col("at") <= COMMON_WORDS)
    table = common.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("words")).join(counted, "lang")
    steps = max(1, -(-counted.count() // STEP_LANGUAGES))
    table = materialize(table.withColumn("step", F.pmod(F.xxhash64("lang"), F.lit(steps))), "references")
    for step in range(steps):
        rows = sorted(table.where(F.col("step") == step).collect(), key=lambda r: r["lang"])  # about STEP_LANGUAGES
        out = []
        for at in range(0, len(rows), LANGUAGES):
            own = rows[at : at + LANGUAGES]
            chars = {r["lang"]: np.array([r["n"].get(k, 0) for k in range(CLASSES)], dtype=float) for r in own}
            out.append(References(chars, {r["lang"]: r["words"] for r in own}, {r["lang"]: r["n"][CLASSES + 1] for r in own}))
        yield out


CARRIED = "doc_id long, text string, lang string, judged boolean, c double, w double, best double"


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts and verdicts of each document of ``documents`` (doc_id, text, lang, ...).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier one),
    n_repeat_words (words in three-word windows that come twice or more, the first included), base_failed, kept, and the
    distances from the nearest language, 1 where no language has a reference; judged says whether the row's lang has one, else the base rules
    alone decide. A null or empty text has no words and fails; a very long one is
    judged whole. Rows that tie or repeat a doc_id, or have none, are judged each; a null lang is a language; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """

    def step(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = K.buffers(batch.column(1))
                language = np.array(batch.column(2).to_pylist(), dtype=object)
                judged = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) | np.isin(language, [k for refs in shared.value for k in refs.languages])
                for i, j, part, offs in K.pieces(data, offsets, rows=PIECE_ROWS):
                    base, chars = Base(part, offs), _histogram(part, offs)
                    n = base.n
                    found = tuple(batch.column(k).slice(i, j - i).to_numpy() for k in (4, 5, 6))
                    for refs in shared.value:
                        found = refs.nearer(chars, refs.counts(base.hashes, base.first), n, *found)
                    if not last:
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1, 2)), pa.array(judged[i:j]), *map(pa.array, found)], names=[c.split()[0] for c in CARRIED.split(", ")])
                        continue
                    by_char, by_word, _ = found
                    char_limit, word_limit = limits(n)
                    near = ~judged[i:j] | ((by_char <= char_limit) | (chars.sum(axis=1) < MIN_CHARS)) & ((by_word <= word_limit) | (n < MIN_COUNTED_WORDS))
                    columns = [n, base.word_chars, base.symbols, base.lines, base.repeat]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(base.failed), pa.array(~base.failed & near), pa.array(by_char), pa.array(by_word), pa.array(judged[i:j])], names=[c.split()[0] for c in SCHEMA.split(", ")])

        return run

    one = F.lit(1.0)
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.lit(False).alias("judged"), one.alias("c"), one.alias("w"), F.lit(float("inf")).alias("best"))
    context, before = documents.sparkSession.sparkContext, None
    for refs in references(documents):  # each step's are of bounded size
        if before is not None:
            out = out.mapInArrow(step(before, False), CARRIED)
        before = context.broadcast(refs)
    return out.mapInArrow(step(before, True), SCHEMA)
