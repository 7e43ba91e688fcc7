"""Vector bin packing of tokenised documents into training sequences.

Each sequence has simultaneous limits on tokens, segments and loss-bearing tokens: instruction data says which bytes of a text, such as
its answers, bear loss; plain documents bear it everywhere. Whole sequences are
cut from long documents first; the rests wait in a bounded pool, and the open sequence takes the one
whose demand has the largest dot product with what the sequence has left. Where nothing fits whole,
a piece is cut to fill the gap, so only the end of a task's input is short, and that end goes into
sequences whose lengths are powers of two. Each task packs what it reads: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LENGTH = 2048
MAX_SEGMENTS = 128
END_ID = 1
#: Rests that wait at once for a place.
POOL = 256
#: Words whose ids a worker keeps (about 40 bytes each); beyond them it starts anew.
CACHED_WORDS = 1_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True  # contractions begin with '

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of texts by a tokenizer that never joins what white space parts: each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, new: np.ndarray, words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total = int(count.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in got for i in x), dtype=np.uint32, count=total)
        first = self.used + np.cumsum(count) - count
        self.used += total
        at = np.searchsorted(self.known, new)
        self.known, self.first, self.count = (np.insert(old, at, x) for old, x in ((self.known, new), (self.first, first), (self.count, count)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, the first of each document (with one more), and the byte at which each id's word begins."""
        data = K.LOWER[data]  # as the tokenizer does first
        start, end, _ = K.words(data, offsets)
        cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1  # a letter and a mark are never in one token
        begins, stops = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
        begins[start] = begins[cuts] = stops[end] = stops[cuts] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(stops)
        first = np.searchsorted(start, offsets)
        hashes = K.range_hash(K.prefix_hash(data), start, end)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.known, unique)
        missing = np.ones(len(unique), dtype=bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != unique[inside]
        if missing.any():
            raw = data.tobytes()
            self._learn(unique[missing], [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[index[missing]].tolist(), end[index[missing]].tolist(), strict=True)])
            at = np.searchsorted(self.known, unique)
        count = self.count[at][inverse]
        edge = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.first[at][inverse] - edge[:-1], count) + np.arange(edge[-1])
        return self.ids[source], edge[first], np.repeat(start, count)


@lru_cache(maxsize=2)
def encoder(name: str) -> WordTokens:
    """One for each worker process."""
    return WordTokens(public_tokenizers.path(name))


def bearing(places: np.ndarray, spans: list | None) -> np.ndarray:
    """Whether each id of a document bears loss, with the end id: those whose word begins in one of the byte ``spans``, all if there are none given."""
    out = np.ones(len(places) + 1, dtype=bool)
    if spans is not None:
        edges = np.zeros((int(places[-1]) if len(places) else 0) + 2, dtype=np.int64)
        for span in spans:
            a, b = (min(max(0, int(span[k] or 0)), len(edges) - 1) for k in ("start", "stop"))
            if a < b:
                edges[a] += 1
                edges[b] -= 1
        out[:-1] = np.cumsum(edges)[places] > 0
        out[-1] = out[-2] if len(places) else False
    out[0] = False  # nothing precedes it
    return out


def sequences(documents: Iterator[tuple[int, np.ndarray, np.ndarray]], base: int, length: int, max_segments: int, max_loss: int) -> Iterator[tuple]:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    documents: id, token ids, and whether each bears loss.
    """
    number = base
    limits = np.array([length, max_segments, max_loss], dtype=np.float64)
    pool: list[list] = []  # [doc_id, ids, start, loss before each id]
    demand = np.zeros((POOL, 3))
    source, over = iter(documents), False

    def piece(item: list, start: int, size: int, sequence: int, offset: int) -> tuple:
        return item[0], start, size, zlib.crc32(item[1][start : start + size].tobytes()), len(item[1]), sequence, offset

    def loss(item: list, size: int) -> int:
        return int(item[3][item[2] + size] - item[3][item[2]])

    def note(k: int) -> None:
        left = len(pool[k][1]) - pool[k][2]
        demand[k] = left, 1, loss(pool[k], left)

    def drop(k: int) -> None:
        pool[k] = pool[-1]
        demand[k] = demand[len(pool) - 1]
        pool.pop()

    def cut(item: list, tokens: float, bearing: float) -> int:
        """Ids of the item's rest that stay within both."""
        within = np.searchsorted(item[3], item[3][item[2]] + bearing, side="right") - 1 - item[2]
        return int(min(len(item[1]) - item[2], tokens, within))

    while True:
        while not over and len(pool) < POOL:
            doc = next(source, None)
            if doc is None:
                over = True
                break
            item = [doc[0], doc[1], 0, np.concatenate([[0], np.cumsum(doc[2])])]
            while len(item[1]) - item[2] >= length and loss(item, length) <= max_loss:
                yield piece(item, item[2], length, number, 0)
                item[2] += length
                number += 1
            if item[2] < len(item[1]):
                pool.append(item)
                note(len(pool) - 1)
        if not pool:
            return
        room, offset, taken = limits.copy(), 0, []
        while pool and room[:2].min() >= 1:
            need = demand[: len(pool)]
            fits = (need <= room).all(axis=1)
            if room[1] == 1:  # the last segment: what fills the rest
                fits &= need[:, 0] == room[0]
            if fits.any():
                k = int(np.argmax(np.where(fits, ((need / limits) * (room / limits)).sum(axis=1), -1)))
                size = int(need[k, 0])
            else:
                k = int(np.argmax(need[:, 0]))
                size = cut(pool[k], room[0], room[2])
                if size < min(need[k, 0], room[0]):  # its loss is in the way: another may fill more
                    sizes = [cut(item, room[0], room[2]) for item in pool]
                    k = int(np.argmax(sizes))
                    size = sizes[k]
                if not size:
                    break
            taken.append((pool[k], pool[k][2], size))
            room -= (size, 1, loss(pool[k], size))
            pool[k][2] += size
            if pool[k][2] == len(pool[k][1]):
                drop(k)
            else:
                note(k)
            offset += size
        total = offset
        if over and not pool and total < length:
            bits = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        else:
            bits = [total]
        left, at = bits.pop(0), 0
        for item, start, size in taken:
            while size:
                step = min(size, left)
                yield piece(item, start, step, number, at)
                start, size, left, at = start + step, size - step, left - step, at + step
                if not left:
                    number += 1
                    at = 0
                    left = bits.pop(0) if bits else 0


def pack_sequences(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = LENGTH, loss: str | None = None) -> DataFrame:
    """One row for each piece of each document of ``documents`` (doc_id, text, ...), packed into sequences of ``length`` tokens at most.

    tokenizer: name of a public vocabulary whose ids never cross white space. A document's ids end with
    the id 1; a null or empty text has that id alone. Every id lies in exactly one piece; offset counts from 0 without gaps in a sequence.
    loss: a column of array<struct<start, stop>>, the ranges of bytes of the text that bear loss; null is everywhere, empty nowhere, and
    a document's first id never bears it. A sequence has at most max_loss such ids; where a limit stops it short of ``length``, the rest is padding.
    Ids in sequence_id begin with the number of the task. A very long text is cut into many pieces; rows that tie or repeat a doc_id, or have
    none, are packed as documents of their own; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    if min(length, max_segments, max_loss) < 1:
        raise ValueError("limits are 1 at least")
    spans = F.col(loss) if loss else F.lit(None)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), spans.cast("array<struct<start:long,stop:long>>").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)

        def tokenised() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                ids, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                data, offsets = K.buffers(batch.column(1))
                for i, j, part, offs in K.pieces(data, offsets):
                    flat, edge, places = encode(part, offs)
                    for d in range(i, j):
                        own = slice(edge[d - i], edge[d - i + 1])
                        out = np.empty(own.stop - own.start + 1, dtype="<u4")
                        out[:-1], out[-1] = flat[own], END_ID
                        yield ids[d], out, bearing(places[own] - offs[d - i], spans[d])

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        made: list[tuple] = []
        for row in sequences(tokenised(), TaskContext.get().partitionId() << 36, length, max_segments, max_loss):
            made.append(row)
            if len(made) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=names)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)
