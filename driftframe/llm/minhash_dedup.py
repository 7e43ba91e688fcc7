"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 2**32 shingle universe make the whole signature: the first scatters the
shingles once, the second is shifted circularly by k positions for coordinate k. Coordinates are
banded; documents that share a band are candidates, and every link is confirmed on the full
shingle sets. No bucket is expanded into all its pairs: exact copies are one class, each bucket
first links its members to one pivot, and only members that are still in different components
are compared further, by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, is_small, look_up, materialize, texts

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Rounds in which each bucket has one pivot, before the exact way for members of different components.
PIVOT_ROUNDS = 2
#: Shingles on either side of a cell in which documents are compared.
CELL = 200_000
#: Ids (8 bytes each) that are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hash_a long, set_hash_b long, bands array<long>"
U32 = np.uint32


def _permute(x: np.ndarray, c1: int, c2: int, spare: np.ndarray) -> np.ndarray:
    """In place: a permutation of the 32-bit universe."""
    for shift, factor in ((16, c1), (13, c2), (16, None)):
        np.right_shift(x, U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, U32(factor), out=x)
    return x


def signatures(shingle: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates) of circulant MinHash; first: first shingle of each document, each with one at least."""
    scattered = _permute((shingle >> K.U64(32)).astype(U32), 0x85EBCA6B, 0xC2B2AE35, np.empty(len(shingle), U32))
    out = np.empty((len(first), coordinates), dtype=U32)
    moved, spare = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(coordinates):
        np.subtract(scattered, U32(k + 1), out=moved)  # wraps: a circular shift of the second permutation
        out[:, k] = np.minimum.reduceat(_permute(moved, 0x7FEB352D, 0x846CA68B, spare), first)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = K.mix(key * K.U64(0x9E3779B97F4A7C15) + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = key
    return out


def document_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ordered by document, and the first of each document (with one more)."""
    lowered = K.LOWER[data]
    start, end, first = K.words(lowered, offsets)
    word = K.range_hash(K.prefix_hash(lowered), start, end)
    hashes, _, starts = K.shingles(word, first, size, short=True)
    _, index = np.unique(K.keyed(hashes, K.owner(starts)), return_index=True)
    index.sort()
    return hashes[index], np.searchsorted(index, starts)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        for i, j, part, offs in K.pieces(data, offsets):
            sets, starts = document_sets(part, offs)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            keys = np.zeros((0, BANDS), dtype=np.uint64)
            a, b = np.zeros(j - i, dtype=np.uint64), np.zeros(j - i, dtype=np.uint64)
            if len(full):
                keys = band_keys(signatures(sets, starts[full], BANDS * ROWS), BANDS, ROWS)
                a[full] = np.add.reduceat(K.mix(sets + K.U64(1)), starts[full])
                b[full] = np.add.reduceat(K.mix(sets ^ K.U64(0x5851F42D4C957F2D)), starts[full])
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands], names=["doc_id", "n_shingles", "set_hash_a", "set_hash_b", "bands"])
    K.release()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the links among them, on the full sets."""
    for batch in batches:
        pairs = pa.Table.from_batches([batch])
        sides = [K.buffers(pairs.column(c)) for c in ("text_a", "text_b")]
        both = np.maximum(np.cumsum(np.diff(sides[0][1])), np.cumsum(np.diff(sides[1][1]))) if len(batch) else np.zeros(0, np.int64)
        keep = np.zeros(len(batch), dtype=bool)
        i = 0
        while i < len(batch):
            base = both[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(both, base + K.PIECE_BYTES)))
            found = []
            for data, offsets in sides:
                sets, starts = document_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found.append((K.keyed(sets, K.owner(starts)), np.diff(starts)))
            common = np.isin(found[0][0], found[1][0], assume_unique=True)
            shared = np.bincount(np.repeat(np.arange(j - i), found[0][1])[common], minlength=j - i)
            keep[i:j] = (100 * shared >= PERCENT * (found[0][1] + found[1][1] - shared)) & (shared > 0)
            i = j
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])
    K.release()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each of ``nodes`` over the undirected ``links`` (a, b).

    Alternates star steps: every node passes the smallest neighbour to its larger ones, then to all, until
    nothing changes. Per-node minima are sums that Spark combines before its shuffle; no neighbour lists are built, and the
    edges of a star's centre, however many, stay in the tasks that hold them.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return nodes.select("id", F.col("id").alias("component"))
    before = None
    while True:
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")), "least")
        large = materialize(look_up(both.where("v > u"), least, ["u"], "degree").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its smaller neighbours are linked to the smallest of them
        smallest = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "smallest")
        joined = look_up(large, smallest, ["u"], "degree")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = materialize(small, "stars")
        discard(edges, least, large, smallest)
        edges = after
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    return nodes.join(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids`` (id); sent to every executor while they are few, else joined by shuffle."""
    ids = ids.withColumnRenamed("id", "doc_id")
    return docs.join(F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among candidate ``pairs`` (a, b), each confirmed on both whole texts."""
    some = _only(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = lambda c: some.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return materialize(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "confirmed")


def _may_link(a: str, b: str) -> F.Column:
    """Sets so different in size can't reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        for i, j, part, offs in K.pieces(data, offsets):
            sets, starts = document_sets(part, offs)
            kept = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("component").slice(i, j - i), kept], names=["id", "component", "shingles"])
    K.release()


def _compare_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of documents with their sets, of different components."""
    rows = [{c: t.column(c).to_numpy() for c in ("id", "component")} | {"sets": t.column("shingles").combine_chunks()} for t in (left, right)]
    flat = [np.asarray(r["sets"].flatten()) for r in rows]
    n = [np.asarray(r["sets"].value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64) for r in rows]
    doc = [np.repeat(np.arange(len(k)), k) for k in n]
    order = np.argsort(flat[1], kind="stable")
    value, held = flat[1][order], doc[1][order]
    found_a, found_b = [], []
    edge = np.concatenate([[0], np.cumsum(n[0])])
    for d in range(len(n[0])):
        own = flat[0][edge[d] : edge[d + 1]]
        lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
        width = hi - lo
        hits = held[np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
        shared = np.bincount(hits, minlength=len(n[1]))
        link = (100 * shared >= PERCENT * (n[0][d] + n[1] - shared)) & (rows[1]["component"] != rows[0]["component"][d])
        found_b.append(rows[1]["id"][link])
        found_a.append(np.full(len(found_b[-1]), rows[0]["id"][d]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _rest_links(docs: DataFrame, now: DataFrame) -> DataFrame:
    """All links (a, b) among bucket members whose components still differ: an exact way for what pivots left.

    Sets with the similarity share one of their rarest shingles (a quarter of the set and one more, in one global
    order by frequency), so a passage that many documents hold joins nobody. Documents that meet there are gathered
    by the largest component at their shingle and compared on full sets in cells of bounded size; no pair is a row.
    """
    split = materialize(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"), "split")
    rest = look_up(now, split, ["key"], "size").select("id", "component").distinct()
    some = _only(docs, rest.select("id")).join(rest.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "component", "text")
    sets = materialize(some.mapInArrow(_set_rows, "id long, component long, shingles array<long>"), "rest")
    rows = sets.select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    met = materialize(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "met")
    own = Window.partitionBy("id")
    # of a set, the shingles that others hold too must suffice; the rest of the rarest ones come first in the order
    ranked = look_up(rows, met, ["key"], "members").withColumn("common", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("members", "key")))
    prefix = ranked.where(F.col("at") <= F.col("common") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("key", "id", "component", "n")
    prefix = materialize(prefix, "prefix")
    hub = prefix.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("hub"), F.count("*").alias("parts"), F.sum("size").alias("size")).where("parts > 1")
    hub = materialize(hub.select("key", "hub", "size"), "hubs")
    held = materialize(look_up(prefix, hub, ["key"], "size").select("hub", "id", "component", "n").distinct(), "held")
    outside = F.when(F.col("component") != F.col("hub"), F.col("n"))
    cells = materialize(held.groupBy("hub").agg(F.ceil(F.sum(outside) / CELL).alias("down"), F.ceil(F.sum("n") / CELL).alias("across"), F.count("*").alias("size")), "cells")
    laid = look_up(held, cells, ["hub"], "size").join(sets.select("id", "shingles"), "id")
    place = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("long")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = laid.where("component != hub").withColumn("i", place("down")).withColumn("j", every("across"))
    right = laid.select(*(F.col(c).alias(c) for c in laid.columns)).withColumn("j", place("across")).withColumn("i", every("down"))
    columns = ["hub", "i", "j", "id", "component", "shingles"]
    return left.select(columns).groupBy("hub", "i", "j").cogroup(right.select(columns).groupBy("hub", "i", "j")).applyInArrow(_compare_cell, "a long, b long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document of ``documents`` (doc_id, text, ...).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct runs of five
    words, with fewer words the whole sequence. Documents are linked from a Jaccard similarity of 0.75;
    component_id is the smallest doc_id reachable and kept marks it. A null or empty text has no set
    and stays alone; a very long one is a set like any other. Rows with one doc_id get a row each, by their own text. A row without a doc_id
    gets its set's size and kept, and is linked with nothing. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = texts(documents).where("doc_id is not null")
    sketch = materialize(docs.mapInArrow(_sketch, SKETCH_SCHEMA), "sketch", compact=False)
    full = sketch.where("n_shingles > 0")
    sets = ["n_shingles", "set_hash_a", "set_hash_b"]
    classes = materialize(full.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    # each row with the smallest doc_id of its class; only those rows are looked up further
    rep = F.coalesce("rep", "doc_id")
    reps = materialize(look_up(full, classes, sets, "copies", "left").select("doc_id", "n_shingles", rep.alias("rep"), F.when(rep == F.col("doc_id"), F.col("bands")).alias("bands")), "classes", compact=False)
    alone = reps.where("doc_id = rep")
    rows = alone.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    buckets = materialize(look_up(rows, shared, ["key"], "members"), "buckets", compact=False)
    nodes = buckets.select("id").distinct()

    links = tried = None
    comps = nodes.select("id", F.col("id").alias("component"))
    for turn in range(PIVOT_ROUNDS):
        now = buckets.join(comps, "id")
        order = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), "id")
        split = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("id", "n", "component"), order).alias("pivot"), F.count("*").alias("size")).where("lo < hi")
        split = materialize(split.select("key", "pivot", "size"), "pivots")
        pairs = look_up(now, split, ["key"], "size").where(F.col("component") != F.col("pivot.component")).where(_may_link("n", "pivot.n")).select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs.distinct(), "candidates")
        discard(split)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _confirmed(pairs, docs)
        links = found if links is None else links.unionByName(found)
        comps = materialize(components(links, nodes), "components")
    found = materialize(_rest_links(docs, buckets.join(comps, "id")), "rest-links")
    if not found.isEmpty():
        comps = materialize(components(found if links is None else links.unionByName(found), nodes), "components")

    copies = classes.select("rep", "copies")
    near = materialize(comps.select(F.col("id").alias("rep"), "component").join(copies, "rep", "left").withColumn("copies", F.coalesce("copies", F.lit(1))), "near")
    every = reps.select("doc_id", "n_shingles", "rep").unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep")))
    out = look_up(every, near, ["rep"], "copies", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = texts(documents).where("doc_id is null").mapInArrow(_sketch, SKETCH_SCHEMA)
    return out.unionByName(lost.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, steps.y FROM reach JOIN steps ON steps.x = reach.b),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT f.doc_id, coalesce(n, 0) AS n_shingles, component_id, f.doc_id = component_id AS kept FROM found f LEFT JOIN sizes USING (doc_id)
"""
