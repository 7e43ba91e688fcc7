"""Long repeats by matching statistics over run-length compressed Burrows-Wheeler indexes of a corpus's repetitive part.

A byte is removed if a string of ``width`` bytes that covers it also starts in a document with a smaller
doc_id. Every such string has one anchor, its smallest hashed ``ANCHOR``-gram, so equal strings meet by their
anchor: only stretches whose anchor occurs in two documents at least are gathered, and a group of documents sends a distinct one once.
For a range of anchors the distinct stretches of smaller documents are one text, indexed by its run-compressed Burrows-Wheeler
transform with sampled run ends. Those of other documents are streamed through it, from their ends to their starts: each step
follows a run or jumps to the end of the nearest run that goes on, whose sampled place tells how much of the match is left. The
matching statistics, the longest match at each byte and one of its places, mark strings of ``width`` bytes, and the place's interval in
the suffix order has the smallest document that holds it.

An anchor with very many distinct stretches is split by the bytes around it: its strings meet by 49 of their 50 bytes, so that
no index depends on how often an anchor comes. A group of documents has a row for each range of anchors it holds, so a row for each
of its anchors at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import group_count, partitions, text_bytes, texts

WIDTH = 50
ANCHOR = 20
SYMBOLS = 7  # of nine bits each in the first sort key
_STEP = 8  # symbols that are compared at once
#: Strings in a stretch, and strings or stretches that are compared at once.
LONGEST = 200
PLACES = 1 << 17


@dataclass(frozen=True)
class Sizes:
    """What a task holds at once.

    slice: bytes of text. index: bytes of distinct stretches, of whole anchors; an anchor with more than hot_texts is split, so
    that one has 65 536 of 51 bytes at most: two bytes beside the 49 that they meet by. hot_kinds: of 16 marks of what groups have of
    an anchor, how many it has at most where the same stretches make it common.
    """

    slice: int = 256 << 10
    index: int = 512 << 10
    hot_texts: int = 4_096
    hot_kinds: int = 4


OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BIG = np.iinfo(np.int64).max


def _windows(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Slices of documents of about ``most`` bytes: first document, past last, bytes, offsets, bytes of the first document before the slice.

    A longer document comes in slices that overlap by WIDTH - 1 bytes, so that each string starts in one of them.
    """
    for i, j, part, offs in K.pieces(data, offsets, most):
        if len(part) <= 2 * most:
            yield i, j, part, offs, 0
            continue
        for at in range(0, len(part) - WIDTH + 1, most):
            cut = part[at : at + most + WIDTH - 1]
            yield i, j, cut, np.array([0, len(cut)]), at


_LANES = np.random.default_rng(7).integers(0, 2**32, (2, 256), dtype=np.uint32)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of each ANCHOR-gram, from two 32-bit lanes that double their reach."""
    n = len(data) - ANCHOR + 1
    out = np.zeros(n, dtype=np.uint64)
    for lane, (table, factor) in enumerate(zip(_LANES, (0x9E3779B1, 0x85EBCA77), strict=True)):
        reach, done, total, step = 1, 0, None, table[data]
        while reach <= ANCHOR:
            if ANCHOR & reach:  # the gram is the sum of its powers of two
                part = step[done : done + n]
                total = part.copy() if total is None else total * np.uint32(pow(factor, reach, 2**32)) + part
                done += reach
            if 2 * reach <= ANCHOR:
                step = step[:-reach] * np.uint32(pow(factor, reach, 2**32)) + step[reach:]
            reach *= 2
        total ^= total >> np.uint32(16)
        total *= np.uint32(0x7FEB352D)
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x846CA68B)
        total ^= total >> np.uint32(16)
        out |= total.astype(np.uint64) << K.U64(32 * (1 - lane))
    return out


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of WIDTH-byte strings with one anchor, at most LONGEST: first start, number of strings, anchor's key, document, hash of the bytes."""
    n, span = len(data), WIDTH - ANCHOR + 1
    none = np.zeros(0, dtype=np.int64)
    if n < WIDTH:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    gram = best = _grams(data)
    reach = 1
    while reach * 2 <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < span:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    inside = np.ones(n - WIDTH + 1, dtype=bool)
    for stop in offsets[1:-1].tolist():
        inside[max(0, stop - WIDTH + 1) : stop] = False
    differs = best[1:] != best[:-1]
    change, last = inside.copy(), inside.copy()
    change[1:] &= ~inside[:-1] | differs
    last[:-1] &= ~inside[1:] | differs
    start, count = np.flatnonzero(change), np.flatnonzero(last)
    count -= start - 1
    if len(count) and count.max() > LONGEST:  # a gram that comes again and again
        parts = -(-count // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * LONGEST
        count = np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
    value = K.mix(gram[start] + count.astype(np.uint64))  # from grams side by side, and the last one
    reach = ANCHOR
    at = np.arange(len(start))
    while len(at):
        size = count[at] + WIDTH - 1
        value[at] = K.mix(value[at] * K.U64(0x9E3779B97F4A7C15) + gram[start[at] + np.minimum(reach, size - ANCHOR)])
        at = at[size - ANCHOR > reach]
        reach += ANCHOR
    return start, count, K.mix(best[start]), np.searchsorted(offsets, start, side="right") - 1, value


def split(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of hot anchors as runs of one or two strings: first start, number of strings, key, hash of the bytes.

    The key is that of the 49 bytes that two neighbouring strings share, which are chosen by the place of the anchor in the string.
    """
    edge = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(edge[-1]) - np.repeat(edge[:-1] - start, count)
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(np.uint64)
    gram = _grams(data)
    place = np.concatenate([np.argmin(gram[part[:, None] + np.arange(WIDTH - ANCHOR + 1)], axis=1) for part in np.array_split(at, -(-len(at) // PLACES))])
    anchor, pair = at + place, place >> 1
    head = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(head)
    own, size = at[first], np.diff(np.append(first, len(at)))
    prefix = K.prefix_hash(data)
    core = anchor[first] - 2 * pair[first]
    key = K.mix(K.range_hash(prefix, core, core + WIDTH - 1) + pair[first].astype(np.uint64))
    return own, size, key, K.range_hash(prefix, own, own + size + WIDTH - 1)


def _with_split(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """``stretches`` with those of the sorted ``hot`` anchors split."""
    start, count, key, doc, value = found
    is_hot = _has(hot, key)
    if not is_hot.any():
        return found
    parts = split(data, offsets, start[is_hot], count[is_hot])
    own = np.searchsorted(offsets, parts[0], side="right") - 1
    return tuple(np.concatenate([a[~is_hot], b]) for a, b in zip(found, (*parts[:3], own, parts[3]), strict=True))


def _column(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=np.uint64) for c in table.column(name).chunks for x in c]


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = K.buffers(table.column("text"))
    return np.asarray(table.column("doc_id").to_numpy(), dtype=np.int64), data, offsets


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets of equal shares of the key space that sorted keys lie in, each with its run of keys; work and memory are in the keys, not in the buckets."""
    bucket = ((keys >> K.U64(32)) * K.U64(buckets)) >> K.U64(32)
    head = _heads(bucket)
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(head, np.append(head, len(keys))[1:], strict=True)]


def _small(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.uint16).tobytes(), 1)


def _smalls(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x.as_py()), dtype=np.uint16) for c in table.column(name).chunks for x in c]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    differs = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], differs]))


def _rows(rows: list[tuple], names: list[str], kinds: tuple) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def _anchor_rows(buckets: int, sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        """For each bucket, the group's distinct anchors with two bytes each.

        Their bits: whether several documents have the anchor, the logarithm of how many distinct stretches it has (five bits, enough for any), four
        bits of a hash of all these.
        """
        ids, data, offsets = _group(table)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for i, _, part, offs, _ in _windows(data, offsets, sizes.slice):
            _, _, key, doc, value = stretches(part, offs)
            parts.append((key, value, ids[doc + i]))
        key, value, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((value, key))
        key, value, doc = key[order], value[order], doc[order]
        head, texts = _heads(key), _heads(key, value)
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head) if len(head) else np.zeros(0, bool)
        held = np.searchsorted(texts, np.append(head, len(key)))
        mark = K.mix(np.add.reduceat(value[texts], held[:-1]) if len(head) else value) & K.U64(15)
        power = np.ceil(np.log2(np.maximum(np.diff(held), 1)))
        said, key = several + 2 * power.astype(np.int64) + 64 * mark.astype(np.int64), key[head]
        g = table.column("g")[0].as_py()
        rows = [(b, g, key[s].tobytes(), _small(said[s])) for b, s in cuts(key, buckets)]
        return _rows(rows, ["bucket", "g", "keys", "said"], (pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    return run


def _has(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in the sorted ``values``."""
    if not len(values):
        return np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(values, wanted)
    return values[np.minimum(at, len(values) - 1)] == wanted


def _repeated(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        """For each group, those of its anchors that two documents at least hold, and which of them are hot."""
        keys, said = _column(table, "keys"), _smalls(table, "said")
        size = np.cumsum([0] + [len(k) for k in keys])
        key, told = np.concatenate(keys), np.concatenate(said)
        order = np.argsort(key, kind="stable")
        head = _heads(key[order])
        width = np.diff(np.append(head, len(key)))
        own = 1 << ((told[order] >> 1) & 31).astype(np.int64)
        held, most = np.add.reduceat(own, head), np.maximum.reduceat(own, head)
        kinds = np.bitwise_count(np.bitwise_or.reduceat(1 << (told[order] >> 6).astype(np.int64), head))  # one where all groups have the same stretches
        shared, hot = np.empty(len(key), dtype=bool), np.empty(len(key), dtype=bool)
        shared[order] = np.repeat((width > 1) | (np.maximum.reduceat(told[order] & 1, head) > 0), width)
        hot[order] = np.repeat((most > sizes.hot_texts) | (held > sizes.hot_texts) & (kinds > sizes.hot_kinds), width)
        rows = []
        for g, a, b in zip(table.column("g").to_pylist(), size[:-1], size[1:], strict=True):
            own = shared[a:b]
            if own.any():
                rows.append((g, key[a:b][own].tobytes(), key[a:b][own & hot[a:b]].tobytes()))
        return _rows(rows, ["g", "anchors", "hot"], (pa.int64(), pa.binary(), pa.binary()))

    return run


_STRETCHES = ("bucket", "g", "key", "hash", "doc", "several", "size", "bytes")


def _stretch_rows(buckets: int, sizes: Sizes):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """For each bucket, the group's distinct stretches at shared anchors: key, hash, smallest document, whether several hold it, length and bytes.

        The bucket -1 - g keeps the group's hot anchors for its last step.
        """
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
        if not docs.num_rows or not shared.num_rows:
            return _rows([], list(_STRETCHES), kinds)
        anchors, hot = (np.sort(np.concatenate(_column(shared, c))) for c in ("anchors", "hot"))
        ids, data, offsets = _group(docs)
        parts = []
        for i, _, part, offs, _ in _windows(data, offsets, sizes.slice):
            found = stretches(part, offs)
            at = np.flatnonzero(_has(anchors, found[2]))
            start, count, key, doc, value = _with_split(part, offs, hot, tuple(x[at] for x in found))
            size = count + WIDTH - 1
            edge = np.concatenate([[0], np.cumsum(size)])
            parts.append((key, value, ids[doc + i], size, part[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])]))
        key, value, doc, size, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((doc, value, key))
        first = (np.cumsum(size) - size)[order]
        key, value, doc, size = key[order], value[order], doc[order], size[order]
        head = _heads(key, value)
        several = (np.maximum.reduceat(doc, head) != doc[head]) if len(head) else np.zeros(0, bool)
        key, value, doc, size, first = (x[head] for x in (key, value, doc, size, first))
        g, rows = docs.column("g")[0].as_py(), []
        if len(hot):
            rows.append((-1 - g, g, hot.tobytes(), *[b""] * 5))
        for b, s in cuts(key, buckets):
            total = np.concatenate([[0], np.cumsum(size[s])])
            own = raw[np.repeat(first[s] - total[:-1], size[s]) + np.arange(total[-1])]
            rows.append((b, g, key[s].tobytes(), value[s].tobytes(), doc[s].astype(np.uint64).tobytes(), several[s].tobytes(), size[s].astype(np.uint8).tobytes(), zstandard.compress(own.tobytes(), 3)))
        return _rows(rows, list(_STRETCHES), kinds)

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a set of strings, with sampled run ends and the smallest document of each match.

    Strings end with a terminator of their own; equal suffixes stand in the order of the strings.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> None:
        count = len(size)
        ends = np.cumsum(size + 1) - 1  # terminators
        symbol = np.zeros(len(text) + count, dtype=np.int64)
        body = np.ones(len(symbol), dtype=bool)
        body[ends] = False
        symbol[body] = text.astype(np.int64) + 1
        n = len(symbol)
        owner = np.repeat(np.arange(count), size + 1)
        rest = ends[owner] - np.arange(n)  # bytes to the terminator

        # ranks of all suffixes by their first 7, 14, 28, ... bytes
        rank = np.zeros(n, dtype=np.int64)
        alive = np.ones(n, dtype=bool)
        padded = np.concatenate([symbol, np.zeros(SYMBOLS, dtype=np.int64)])
        for j in range(SYMBOLS):
            here = padded[j : j + n]
            alive &= here > 0
            rank = (rank << 9) | np.where(alive, here, 0)
        reach, order, tier = SYMBOLS, np.argsort(rank), None

        def ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
            own, out = key[order], np.empty(n, dtype=np.int64)
            step = np.zeros(n, dtype=np.int64)
            np.cumsum(own[1:] != own[:-1], out=step[1:])
            out[order] = step
            return out

        def ahead(by: int) -> np.ndarray:
            out = np.zeros(n, dtype=np.int64)
            out[: n - by] = np.where(rest[: n - by] >= by, rank[by:] + 1, 0)
            return out

        rank, longest = ranked(rank, order), int(size.max(initial=0))
        while reach <= longest:
            if reach <= width <= 3 * reach:
                tier = (rank, reach)
            if (n + 2) ** 3 < 1 << 63 and 2 * reach < n:  # three ranks fit in a key
                key = (rank * (n + 2) + ahead(reach)) * (n + 2) + ahead(2 * reach)
                reach *= 3
            else:
                key = rank * (n + 2) + ahead(reach)
                reach *= 2
            order = np.argsort(key)
            rank = ranked(key, order)
        own = rank[order]  # ties are whole suffixes: in the order of strings
        tied = np.zeros(n + 1, dtype=bool)
        tied[1:-1] = own[1:] == own[:-1]
        tied = np.flatnonzero(tied[1:] | tied[:-1])
        order[tied] = order[tied][np.lexsort((order[tied], own[tied]))]
        before = np.concatenate([[0], symbol[:-1]])[order]  # the transform; 0 where a string begins
        before[rest[order] == size[owner[order]]] = 0
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.run, self.run_of = np.flatnonzero(head), (np.cumsum(head) - 1).astype(np.int32)
        self.letter = before[self.run]
        length = np.diff(np.concatenate([self.run, [n]]))
        self.last = self.run + length - 1
        self.sample_first, self.sample_last = order[self.run], order[self.last]  # text places at the ends of each run
        below = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=257))])  # rows of smaller letters
        self.by = np.argsort(self.letter, kind="stable")
        seen = np.cumsum(length[self.by]) - length[self.by]
        group = np.searchsorted(self.letter[self.by], self.letter[self.by], side="left")
        self.base = np.empty(len(self.run), dtype=np.int64)
        self.base[self.by] = below[self.letter[self.by]] + seen - seen[group]
        self.runs, self.n = len(self.run), n
        self.place = self.letter[self.by] * (self.runs + 1) + self.by  # runs by letter, then in order
        self.symbol = np.concatenate([symbol, np.full(_STEP, -1, dtype=np.int64)]).astype(np.int16)

        # rows that share their first ``width`` bytes are an interval, with the smallest document of its strings
        self.interval = np.zeros(n, dtype=np.int32)
        if tier is None:
            self.least = np.full(1, BIG)
        else:
            tier, reach = tier
            full = rest[order] >= width
            same = full[1:] & full[:-1]
            for shift in sorted({0, min(reach, width - reach), width - reach}):
                own = tier[np.minimum(order + shift, n - 1)]
                same &= own[1:] == own[:-1]
            head = np.concatenate([[True], ~same])
            self.interval[order] = np.cumsum(head) - 1
            self.least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(head))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from the text places a and b on are the same, ``most`` at most."""
        out = np.zeros(len(a), dtype=np.int64)
        left = np.flatnonzero(most > 0)
        while len(left):
            k = out[left, None] + np.arange(_STEP)
            last = len(self.symbol) - 1
            same = (self.symbol[np.minimum(a[left, None] + k, last)] == self.symbol[np.minimum(b[left, None] + k, last)]) & (k < most[left, None])
            got = np.where(same.all(axis=1), _STEP, np.argmin(same, axis=1))
            out[left] += got
            left = left[got == _STEP]
        return out

    def matching_statistics(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the strings in ``text``: length of the longest match that begins there, within its string, and a place of it in the index."""
        lengths, places = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        if not self.n:
            return lengths, places
        stop = np.cumsum(size)
        who = np.argsort(-size, kind="stable")
        row, place, held = (np.full(len(size), x, dtype=np.int64) for x in (0, self.sample_first[0], 0))
        for done in range(1, int(size.max(initial=0)) + 1):
            active = int(np.searchsorted(-size[who], -done, side="right"))
            who, row, place, held = who[:active], row[:active], place[:active], held[:active]
            letter = text[stop[who] - done].astype(np.int64) + 1
            run = self.run_of[row].astype(np.int64)
            away = np.flatnonzero(self.letter[run] != letter)
            if len(away):  # to the nearest runs of the letter, whichever keeps more of the match
                wanted = letter[away]
                nth = np.searchsorted(self.place, wanted * (self.runs + 1) + run[away])
                best, to, sampled = np.full(len(away), -1, dtype=np.int64), row[away], place[away]
                for at, rows, sample in ((nth - 1, self.last, self.sample_last), (nth, self.run, self.sample_first)):
                    inside = np.clip(at, 0, self.runs - 1)
                    near = self.by[inside]
                    good = np.flatnonzero((inside == at) & (self.letter[near] == wanted))
                    kept = self.common(place[away[good]], sample[near[good]], held[away[good]])
                    better = kept > best[good]
                    near, good = near[good], good[better]
                    best[good] = kept[better]
                    to[good], sampled[good] = rows[near[better]], sample[near[better]]
                row[away], place[away] = to, sampled
                held[away] = best
                run = self.run_of[row].astype(np.int64)
            step = held >= 0
            row[step] = self.base[run[step]] + row[step] - self.run[run[step]]
            place[step] -= 1
            held += 1  # a letter that the index lacks leaves 0
            lengths[stop[who] - done], places[stop[who] - done] = held, place
        return lengths, places


def _match_rows(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        """For each group, its stretches with a smaller document that holds them whole, or with the starts of those of their strings that one holds."""
        names, kinds = ["g", "key", "hash", "least", "start"], (pa.int64(), *[pa.binary()] * 4)
        groups = table.column("g").to_pylist()
        if table.column("bucket")[0].as_py() < 0:  # the hot anchors of one group
            return _rows([(groups[0], _column(table, "key")[0].tobytes(), b"", b"", b"")], names, kinds)
        key, value, doc = (_column(table, c) for c in ("key", "hash", "doc"))
        several = [np.frombuffer(x.as_py(), dtype=bool) for c in table.column("several").chunks for x in c]
        size = [np.frombuffer(x.as_py(), dtype=np.uint8) for c in table.column("size").chunks for x in c]
        raw = [np.frombuffer(zstandard.decompress(x.as_py()), dtype=np.uint8) for c in table.column("bytes").chunks for x in c]
        group = np.repeat(np.arange(len(groups)), [len(k) for k in key])
        key, value, doc, several, size, raw = (np.concatenate(x) for x in (key, value, doc, several, size, raw))
        size, doc = size.astype(np.int64), doc.astype(np.int64)
        first = np.cumsum(size) - size
        order = np.lexsort((doc, value, key))
        head = _heads(key[order], value[order])
        width = np.diff(np.append(head, len(order)))
        rep = order[head]  # one of each distinct stretch, from its smallest document
        least = np.repeat(doc[rep], width)
        for copies in np.array_split(np.arange(len(order)), -(-len(order) // PLACES)):
            one, other = order[copies], np.repeat(rep, width)[copies]
            copied = one != other
            one, other = one[copied], other[copied]
            place = np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
            if (size[one] != size[other]).any() or (raw[np.repeat(first[one], size[one]) + place] != raw[np.repeat(first[other], size[one]) + place]).any():
                raise ValueError("two stretches have the same key and hash")
        alike = np.diff(np.append(_heads(key[rep]), len(rep)))
        rep = rep[np.repeat(alike > 1, alike)]  # an anchor with one stretch has nothing else to match
        rep = rep[np.lexsort((doc[rep], key[rep]))]
        of_key = np.append(_heads(key[rep]), len(rep))
        is_first, is_last = np.zeros(len(rep), dtype=bool), np.zeros(len(rep), dtype=bool)
        is_first[of_key[:-1]] = is_last[of_key[1:] - 1] = True
        matched, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, edge = 0, np.cumsum(size[rep])

        def bytes_of(which: np.ndarray) -> np.ndarray:
            total = np.cumsum(size[which]) - size[which]
            return raw[np.repeat(first[which] - total, size[which]) + np.arange(size[which].sum())]

        while at < len(rep):
            goal = np.searchsorted(edge, (edge[at - 1] if at else 0) + sizes.index)
            stop = int(of_key[min(np.searchsorted(of_key, max(goal, at + 1)), len(of_key) - 1)])
            # of an anchor's stretches, none is in a document before the first one's, and none matches what only comes last
            held, asked = rep[at:stop][~is_last[at:stop]], rep[at:stop][~is_first[at:stop]]
            held = held[np.argsort(doc[held], kind="stable")]
            index = RunLengthIndex(bytes_of(held), size[held], doc[held])
            length, place = index.matching_statistics(bytes_of(asked), size[asked])
            long = np.flatnonzero(length >= WIDTH)
            begin = np.cumsum(size[asked]) - size[asked]
            who = np.searchsorted(begin, long, side="right") - 1
            hit = index.least[index.interval[place[long]]] < doc[asked[who]]
            matched.append(asked[who[hit]])
            starts.append(long[hit] - begin[who[hit]])
            at = stop
        matched, starts = np.concatenate(matched), np.concatenate(starts)
        rows = []
        by_group = np.argsort(group[order], kind="stable")
        bounds = np.searchsorted(group[order][by_group], np.arange(len(groups) + 1))
        least_of = np.empty(len(order), dtype=np.int64)
        least_of[order] = least
        by_match = np.argsort(group[matched], kind="stable")
        of_match = np.searchsorted(group[matched][by_match], np.arange(len(groups) + 1))
        for g in range(len(groups)):
            own = order[by_group[bounds[g] : bounds[g + 1]]]
            whole = own[(doc[own] > least_of[own]) | several[own]]
            mine = by_match[of_match[g] : of_match[g + 1]]
            which = np.concatenate([whole, matched[mine]])
            begin = np.concatenate([np.full(len(whole), 255), starts[mine]]).astype(np.uint8)
            if len(which):
                rows.append((groups[g], key[which].tobytes(), value[which].tobytes(), least_of[which].tobytes(), begin.tobytes()))
        return _rows(rows, names, kinds)

    return run


def _remove(sizes: Sizes):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        """Digest of each document of the group after removal."""
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        ids, data, offsets = _group(docs)
        told = found.column("hash").to_pylist()
        named = _column(found, "key")
        hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(k for k, h in zip(named, told, strict=True) if not h)]))
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, h in zip(named, told, strict=True) if h)])
        hashes = np.concatenate([np.zeros(0, np.uint64), *_column(found, "hash")])
        lows = np.concatenate([np.zeros(0, np.uint64), *_column(found, "least")]).astype(np.int64)
        begin = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), dtype=np.uint8) for c in found.column("start").chunks for x in c)]).astype(np.int64)
        order = np.lexsort((begin, keys, hashes))
        keys, hashes, lows, begin = keys[order], hashes[order], lows[order], begin[order]
        head = _heads(hashes)
        edge = np.append(head, len(hashes))
        known = hashes[head]
        spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(hashes):
            for i, _, part, offs, before in _windows(data, offsets, sizes.slice):
                start, count, key, doc, value = _with_split(part, offs, hot, stretches(part, offs))
                at = np.flatnonzero(_has(known, value))
                entry = np.searchsorted(known, value[at])
                real = keys[edge[entry]] == key[at]
                at, entry = at[real], entry[real]
                low, own, place = lows[edge[entry]], ids[doc[at] + i], int(offsets[i]) + before
                later = own > low
                spans.append((start[at[later]] + place, start[at[later]] + count[at[later]] + WIDTH - 1 + place))
                rest, entry = at[own == low], entry[own == low]
                width = edge[entry + 1] - edge[entry]
                one = np.repeat(edge[entry] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                begun = (np.repeat(start[rest], width) + begin[one])[begin[one] < 255] + place
                spans.append((begun, begun + WIDTH))
        start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(start)
        start, stop = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
        owner = np.searchsorted(offsets, start, side="right")
        fresh = np.flatnonzero(np.concatenate([[True], (start[1:] > stop[:-1]) | (owner[1:] != owner[:-1])])) if len(start) else np.zeros(0, np.int64)
        start, stop = start[fresh], stop[np.concatenate([fresh[1:], [len(stop)]]) - 1] if len(start) else stop
        bounds = np.searchsorted(start, offsets)
        rows = []
        for d in range(len(ids)):
            a, b = int(offsets[d]), int(offsets[d + 1])
            own = slice(bounds[d], bounds[d + 1])
            gaps = zip([a, *stop[own].tolist()], [*start[own].tolist(), b], strict=True)
            digest = hashlib.sha256()
            for lo, hi in gaps:
                digest.update(data[lo:hi])
            rows.append((int(ids[d]), b - a, int((stop[own] - start[own]).sum()), int(bounds[d + 1] - bounds[d]), digest.hexdigest()))
        columns = list(zip(*rows, strict=True))
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(documents: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document of ``documents`` (doc_id, text, ...).

    Texts are UTF-8 bytes; each byte covered by a string of 50 bytes that also starts in a document with a smaller
    doc_id is removed, judged on the input. Null and empty texts have no bytes; a text under 50 bytes keeps all; a very long one is
    worked on in overlapping slices. A row without a doc_id keeps its text: no document is smaller, and it removes from none.
    Rows with one doc_id tie: they get a row each and don't remove from each other; other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    every = texts(documents)
    docs, lost = every.where("doc_id is not null"), every.where("doc_id is null")
    groups = group_count(text_bytes(docs))
    docs = docs.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long")).repartition(partitions(groups), "g")
    by = lambda: docs.select(*(F.col(c).alias(c) for c in ("doc_id", "text", "g"))).groupBy("g")
    anchors = docs.groupBy("g").applyInArrow(_anchor_rows(groups, sizes), "bucket long, g long, keys binary, said binary")
    shared = anchors.groupBy("bucket").applyInArrow(_repeated(sizes), "g long, anchors binary, hot binary")
    rows = by().cogroup(shared.groupBy("g")).applyInArrow(_stretch_rows(groups, sizes), "bucket long, g long, key binary, hash binary, doc binary, several binary, size binary, bytes binary")
    found = rows.groupBy("bucket").applyInArrow(_match_rows(sizes), "g long, key binary, hash binary, least binary, start binary")
    zero = F.lit(0).cast("long")
    kept = lost.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return by().cogroup(found.groupBy("g")).applyInArrow(_remove(sizes), OUT_SCHEMA).unionByName(kept)
