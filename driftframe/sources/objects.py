"""Large cells as objects of their own: written in tasks, one file for each, that count once all are there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from driftframe.operators.lob import PREVIEW, display, is_text, sniff

#: File that names the folders of a write that has come to its end.
MANIFEST = "_objects.json"
INDEX = "index.parquet"
#: What is told of an object.
TOLD = {"row_id": "long", "column_name": "string", "source_type": "string", "id": "string", "label": "string", "ext": "string", "n_bytes": "long", "sha256": "string", "preview": "string", "place": "string"}
DDL = ", ".join(f"{c} {t}" for c, t in TOLD.items())
ARROW = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in TOLD.items()])


@dataclass
class _Folder(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task has a folder of its own; the manifest, one small file, names those that count."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"job-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Folder:
        import pyarrow.parquet as pq

        store, root = self._store()
        name = f"{self.job}/{uuid.uuid4().hex}"
        folder = f"{root}/{name}"
        store.create_dir(folder)
        try:
            with store.open_output_stream(f"{folder}/{INDEX}") as sink, pq.ParquetWriter(sink, ARROW) as index:
                for batch in iterator:
                    places = []
                    for key, ext, content in zip(batch.column("id"), batch.column("ext"), batch.column("bytes"), strict=True):
                        places.append(f"{name}/{key.as_py()}.{ext.as_py()}")
                        with store.open_output_stream(f"{root}/{places[-1]}", compression=None) as out:  # a name's ending must not compress it
                            out.write(content.as_buffer() or b"")
                    told = [batch.column(f.name).cast(f.type) for f in ARROW if f.name != "place"]
                    index.write_batch(pa.RecordBatch.from_arrays([*told, pa.array(places, pa.string())], schema=ARROW))
        except BaseException:
            store.delete_dir(folder)
            raise
        return _Folder(name)

    def commit(self, messages: list[_Folder | None]) -> None:
        """Folders of attempts that were lost or came second go; then the manifest is written, whole."""
        from pyarrow import fs

        store, root = self._store()
        kept = sorted(m.name for m in messages if m is not None)
        for found in store.get_file_info(fs.FileSelector(f"{root}/{self.job}", allow_not_found=True)):
            if f"{self.job}/{found.base_name}" not in kept:
                store.delete_dir(found.path)
        with store.open_output_stream(f"{root}/{MANIFEST}.{self.job}") as out:
            out.write(json.dumps(kept).encode())
        store.move(f"{root}/{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Folder | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class ObjectSink(DataSource):
    """``format("objects")`` with the option ``path``: rows of TOLD, but for the place, and ``bytes``."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def object_rows(cells: DataFrame, label: str) -> DataFrame:
    """Cells (row_id, column_name, source_type, bytes) with what their objects are called and hold; an object's id follows from its label and bytes."""
    name = F.concat_ws("-", F.lit(label), "column_name", F.concat(F.lit("row"), F.col("row_id")))
    own = cells.where("bytes is not null").withColumns({"label": name, "sha256": F.sha2("bytes", 256)})
    key = F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws(":", "label", "sha256"), 256), 1, 32))
    preview = F.when(is_text(), F.substring(display(), 1, PREVIEW))
    return own.select("row_id", "column_name", "source_type", key.alias("id"), "label", sniff().alias("ext"), F.octet_length("bytes").cast("long").alias("n_bytes"), "sha256", preview.alias("preview"), "bytes")


def write_objects(cells: DataFrame, path: str, label: str = "cells") -> DataFrame:
    """Write each cell that is not null as a file and give (row_id, column_name, source_type, id, label, ext, n_bytes, sha256, preview, place), place below ``path``.

    Files are written by the tasks that read the cells, without a shuffle, and a task holds one batch of them. Nothing counts before all
    tasks are done; a failed write leaves no object, and an attempt that was lost none either. Cells that repeat row, column and bytes in one
    task are one file. An empty table gives no rows.
    """
    spark = cells.sparkSession
    spark.dataSource.register(ObjectSink)
    object_rows(cells, label).write.format("objects").option("path", path).mode("append").save()
    return read_objects(cells, path)


def read_objects(like: DataFrame, path: str) -> DataFrame:
    """What the last write below ``path`` wrote."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        folders = json.loads(f.read())
    if not folders:
        return like.sparkSession.createDataFrame([], DDL)
    return like.sparkSession.read.schema(DDL).parquet(*(f"{path}/{folder}/{INDEX}" for folder in folders))


def referenced(objects: DataFrame) -> DataFrame:
    """(row_id, column_name, cell): what stands in a result for each cell that is an object."""
    return objects.select("row_id", "column_name", F.concat(F.lit("<"), "source_type", F.lit(" file "), "id", F.lit(">")).alias("cell"))


def contents(objects: DataFrame, path: str) -> DataFrame:
    """(id, bytes) of objects, read in tasks one by one, as they were written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for key, place in zip(batch.column("id").to_pylist(), batch.column("place").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{place}", compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([f.read()], pa.binary())], ["id", "bytes"])

    return objects.select("id", "place").mapInArrow(read, "id string, bytes binary")
