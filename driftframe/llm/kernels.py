"""Array helpers that run inside Spark tasks on Arrow string buffers: words, hashes, repeats."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that are worked on at once; arrays of eight bytes for each of these stay within a worker's memory.
PIECE_BYTES = 1 << 20

_BASE = (0x9E3779B97F4A7C15 & ~7) | 5  # 5 modulo 8: its powers have the longest period modulo 2**64

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def release() -> None:
    """Give free memory back to the system, so that an idle worker, which Spark keeps for other tasks, holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, 2**64))
        have += step
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size, pow(_BASE, -1, 2**64) if inverse else _BASE)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``range_hash`` takes any range's hash from it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end), wherever it lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, without copying where it is one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents (first, past last, bytes, offsets from 0) of about ``limit`` bytes, and ``rows`` at most; a longer document comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, i + rows if rows else n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and the number of the first word of each document (with one more)."""
    ink = ~WHITE[data]
    before = np.empty_like(ink)
    before[:1] = False
    before[1:] = ink[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    after = np.empty_like(ink)
    after[-1:] = False
    after[:-1] = ink[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def owner(first: np.ndarray) -> np.ndarray:
    """For each item, the number of its document, where first[d] is the first item of document d."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_SHINGLE = [U64(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(word: np.ndarray, first: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay in a document, the word each begins at, and the first shingle of each document.

    ``short``: a document of fewer words, but at least one, gives its whole sequence as one shingle.
    """
    count = np.diff(first)
    per = np.where(count >= size, count - size + 1, np.where((count > 0) & short, 1, 0))
    starts = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], per) + np.repeat(first[:-1], per)
    long = np.repeat(count >= size, per)
    out = np.zeros(len(at), dtype=np.uint64)
    whole = at[long]
    total = np.zeros(len(whole), dtype=np.uint64)
    for j in range(size):
        total += word[whole + j] * _SHINGLE[j]
    out[long] = mix(total)
    for k in np.flatnonzero(~long):  # at most one for a document of fewer words
        d = np.searchsorted(starts, k, side="right") - 1
        own = word[first[d] : first[d + 1]]
        value = sum(int(w) * int(_SHINGLE[j]) for j, w in enumerate(own)) + len(own)
        out[k] = mix(np.array([value % (1 << 64)], dtype=np.uint64))[0]
    return out, at, starts


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document."""
    return mix(hashes + doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
