"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets. An item's sketch is its smallest hashed shingles, as many
as its partition's upper size calls for: a document that contains the wanted part of any item of the partition
holds one of them at least, however long the document is. Documents are looked up by their shingles, and candidates are
verified by exact containment of the shingles' text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_small, materialize

SHINGLE_WORDS = 5
#: Percent of an item's shingles that a document must hold.
PERCENT = 75
#: Rows of sketches, items or candidate ids (under 100 bytes each) that are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _words(text: str) -> F.Column:
    white = F.lit(" \t\n\x0b\f\r")
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), white)
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _runs(width: int | F.Column, make) -> F.Column:
    """``make`` of each run of ``width`` words of the column w."""
    count = F.size("w") - width + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: make(F.slice("w", i, width)))).otherwise(F.array())


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df, BROADCAST_ROWS) else df


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents that hold 75 percent of an item's distinct five-word shingles, lower-cased.

    An item of fewer words is one shingle, its whole sequence; one without words, or null, is in no document. Null and empty
    documents hold nothing. Rows with one doc_id, or one item_id, count as one document or item; those without are left out; other columns are ignored.
    """
    docs = documents.where("doc_id is not null").select("doc_id", _words("text").alias("w"))
    items = benchmark.where("item_id is not null").select("item_id", _words("text").alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    items = items.select("item_id", "width", F.explode(_runs(F.col("width"), lambda r: F.array_join(r, " "))).alias("shingle")).distinct()
    size = Window.partitionBy("item_id")
    items = materialize(items.withColumn("h", F.xxhash64(F.split("shingle", " "))).withColumn("n_item", F.count("*").over(size)), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 1 to 5
    if not widths:
        return documents.select("doc_id").limit(0).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "n_item", "n_shared")))

    # partitions of sizes from 2**p; what may be missing of the largest set in it, and one more
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    keep = F.least(F.floor(upper * (100 - PERCENT) / 100) + 1, F.col("n_item"))
    sketch = items.withColumn("at", F.row_number().over(size.orderBy(F.xxhash64("h"), "shingle"))).where(F.col("at") <= keep)
    sketch = _few(sketch.select("width", "h").distinct())

    def looked_up(frame: DataFrame, make) -> DataFrame:
        out = None
        for width in widths:
            own = frame.select("doc_id", F.explode(_runs(width, make)).alias("found")).withColumn("width", F.lit(width))
            out = own if out is None else out.unionByName(own)
        return out

    hits = looked_up(docs, F.xxhash64).join(sketch.withColumnRenamed("h", "found"), ["width", "found"], "left_semi")
    candidates = materialize(hits.select("doc_id").distinct(), "candidates")
    verified = docs.join(_few(candidates), "doc_id", "left_semi")
    exact = looked_up(verified, lambda r: F.array_join(r, " ")).join(_few(items.select("item_id", "n_item", "width", F.col("shingle").alias("found"))), ["width", "found"])
    shared = exact.groupBy("doc_id", "item_id", "n_item", "found").agg(F.lit(1).alias("one")).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT).select("doc_id", "item_id", "n_item", "n_shared")


DECONTAMINATION_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: list_slice(w, i, i + least(len(w), 5) - 1))) AS shingle
  FROM item_words WHERE len(w) > 0),
items AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM item_shingles),
doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, greatest(len(w) - width + 2, 1)), lambda i: list_slice(w, i, i + width - 1))) AS shingle
  FROM doc_words, (SELECT DISTINCT width FROM items))
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM doc_shingles JOIN items USING (width, shingle)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""
