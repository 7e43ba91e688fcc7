"""What the corpus operators share: the cluster's shared folder, sizes, and the document table."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents holds in a task's memory, on average.
GROUP_BYTES = 12 << 20
#: Shuffle partitions that groups are dealt to at most.
MOST_PARTITIONS = 20_000
#: Files that a compact table has at most where the cluster is small.
FEWEST_FILES = 24
#: A key that has more than this part of the rows to join, and more rows than HOT_LEAST, is hot.
HOT_KEYS = 1_000
HOT_LEAST = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a new one where that is unset and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="driftframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str, compact: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    compact: three tasks a core, or an eighth of the shuffle partitions if that is more, write it, so that a small table isn't
    hundreds of files; tables as large as the input keep their partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftframe/{label}-{uuid.uuid4().hex}"
    files = max(FEWEST_FILES, 3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    out = df.coalesce(files) if compact else df
    out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "shared_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with the one row that ``table``, a written table, has for a key; no key is gathered in one task.

    weight: column of the number of rows of each key. Keys with more than one in HOT_KEYS of all rows, so HOT_KEYS at most, are sent
    to every executor; the others are joined by shuffle.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = table.where(F.col(weight) * HOT_KEYS > max(total, HOT_LEAST * HOT_KEYS))
    if hot.isEmpty():
        return rows.join(table, keys, how)
    apart = F.broadcast(hot.select(*(F.col(k).alias(f"__{k}") for k in keys)))
    cold = rows.join(apart, [F.col(k) == F.col(f"__{k}") for k in keys], "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one scan."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)


def group_count(total_bytes: int, each: int = GROUP_BYTES) -> int:
    """Groups so that each holds ``each`` bytes on average; grows with the input without a limit."""
    return max(1, math.ceil(total_bytes / each))


def partitions(groups: int) -> int:
    """Shuffle partitions that groups are dealt to, one for each group up to a bound; a task works on one group after the other."""
    return min(groups, MOST_PARTITIONS)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows
