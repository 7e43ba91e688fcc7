"""One query over many sources in one scan, each source failing for itself while it is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from driftframe.operators.shared import few, written

HEAD = "server_id int, server_name string, error string, message string"
#: Characters of an error's message that are kept.
MOST_MESSAGE = 2_000
BATCH_ROWS = 8_192


@dataclass(frozen=True)
class Source:
    """A server with the places of its rows; each place is read by a task of its own."""

    server_id: int
    server_name: str
    paths: tuple[str, ...]


def parquet_batches(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of Parquet files in a file or folder, of a file system that Arrow knows."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    yield from ds.dataset(place, filesystem=store, format="parquet", partitioning=None).to_batches(columns=names, batch_size=BATCH_ROWS)


class _Place(InputPartition):
    def __init__(self, source: Source, path: str) -> None:
        super().__init__(None)
        self.source, self.path = source, path


class _Reader(DataSourceReader):
    def __init__(self, sources: list[Source], schema: pa.Schema, read: Callable[[str, list[str]], Iterator[pa.RecordBatch]]) -> None:
        self.sources, self.schema, self.open = sources, schema, read

    def partitions(self) -> list[_Place]:
        return [_Place(s, path) for s in self.sources for path in s.paths]

    def read(self, partition: _Place) -> Iterator[pa.RecordBatch]:
        """Rows of a place; what goes wrong at any row, at the first or the last, is a row too."""
        source, own = partition.source, list(self.schema)[4:]

        def batch(n: int, error: str | None, message: str | None, columns: list[pa.Array]) -> pa.RecordBatch:
            same = lambda x, t: pa.array([x] * n, t)
            head = [same(source.server_id, pa.int32()), same(source.server_name, pa.string()), same(error, pa.string()), same(message, pa.string())]
            return pa.RecordBatch.from_arrays([*head, *columns], schema=self.schema)

        try:
            for rows in self.open(partition.path, [f.name for f in own]):
                yield batch(rows.num_rows, None, None, [rows.column(f.name).cast(f.type) for f in own])
        except Exception as e:  # noqa: BLE001  the source's own failure is what is reported
            yield batch(1, type(e).__name__, str(e)[:MOST_MESSAGE], [pa.nulls(1, f.type) for f in own])


def fan_out(spark: SparkSession, sources: list[Source], schema: str, read: Callable[[str, list[str]], Iterator[pa.RecordBatch]] = parquet_batches) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the rows of every source that could be read to its end, with server_id and server_name, and (server_id, server_name, error, message) of each other.

    All sources are one scan, whose plan does not grow with them, and are read once: what was read is written, then the rows of sources
    with an error are left out, so that none counts in part. ``read`` gives the batches of a place, from files or a driver's cursor, in a
    task; it must be picklable. Of a source's errors the first by text is told.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = StructType.fromDDL(f"{HEAD}, {schema}")
    arrow = to_arrow_schema(whole)

    class Fleet(DataSource):
        @classmethod
        def name(cls) -> str:
            return "fleet"

        def schema(self) -> StructType:
            return whole

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(sources, arrow, read)

    spark.dataSource.register(Fleet)
    told = written(spark.read.format("fleet").load(), "fan-out")
    errors = told.where("error IS NOT NULL").groupBy("server_id", "server_name").agg(F.min(F.struct("error", "message")).alias("e")).select("server_id", "server_name", "e.error", "e.message")
    rows = told.where("error IS NULL").drop("error", "message").join(few(errors.select("server_id")), "server_id", "left_anti")
    return rows, errors


def error_digest(errors: DataFrame, name: str, error: str, shown: int) -> DataFrame:
    """(digest, n): the first ``shown`` of the distinct ``name: error`` texts, in order, and how many errors there are."""
    said = errors.select(F.concat(F.col(name), F.lit(": "), F.col(error)).alias("said"))
    first = said.distinct().orderBy("said").limit(shown)  # the shown ones alone are gathered
    digest = first.agg(F.array_join(F.array_sort(F.collect_list("said")), " | ").alias("digest"))
    return digest.crossJoin(said.agg(F.count("*").alias("n")))  # one row each
