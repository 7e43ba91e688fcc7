"""What the vector operators share: usable rows, and a grid of shards of rows and bands of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count

#: Bytes of doubles that a shard of rows, and a band of queries, holds in a task's memory, on average.
SHARD_BYTES = 8 << 20
BAND_BYTES = 4 << 20


def usable(embeddings: DataFrame, *columns: str) -> DataFrame:
    """(vec_id, vector as doubles, ``columns``) of rows with an id whose vector has components, all finite; other columns are left out."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), *columns).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~odd)


def one_size(rows: DataFrame) -> int:
    """Components of each vector, 0 for an empty table; vectors of several sizes have no inner products and are an error."""
    size = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if size["a"] != size["b"]:
        raise ValueError(f"vectors of {size['a']} to {size['b']} components in one table")
    return size["a"] or 0


def grid(rows: DataFrame, queries: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with (shard, band): each row lies in one shard and all bands, each query in one band and all shards.

    A cell of the grid is of bounded size, however many rows or queries there are, and each query meets each row in one cell. Equal vectors
    and equal labels are dealt out by vec_id.
    """
    shards = group_count(rows.count() * size * 8, SHARD_BYTES)
    bands = group_count(queries.count() * size * 8, BAND_BYTES)
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("shard", dealt(shards, 1)).withColumn("band", every(bands)), queries.withColumn("band", dealt(bands, 2)).withColumn("shard", every(shards))


def matrix(table: pa.Table, size: int) -> np.ndarray:
    """The vectors of a table, one row each."""
    column = table.column("vector").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)
