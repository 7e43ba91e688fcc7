"""What the fleet operators share: checked broadcasts, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rule, server and connection tables of at most this many rows are sent to every executor; larger ones are left to the optimizer.
SMALL_ROWS = 10_000


def is_few(df: DataFrame) -> bool:
    """Whether a table has few rows; stops counting beyond them."""
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_few(df) else df


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a local one only where all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="driftframe-")
    return f"{base}/driftframe/{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = f"{scratch(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written in the total order of the columns, with ``place``, which increases in that order, and ``range``, of which none holds all rows.

    It is written as it comes first, as the bounds of ranges are found by a pass of their own, which would derive it twice.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df, "unordered").repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(placed, "ranges").withColumn("range", F.shiftright("place", 33))


def with_previous(placed: DataFrame, column: str, name: str) -> DataFrame:
    """With the value of ``column`` in the row before, over all ranges; ranges but the first row of each are looked at one by one."""
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    tails = placed.groupBy("range").agg(F.max_by(F.struct(column), "place").alias("tail")).withColumn("tail", F.last("tail").over(by_range))
    own = F.lag(F.struct(column)).over(Window.partitionBy("range").orderBy("place"))
    return placed.withColumn("own", own).join(F.broadcast(tails), "range").withColumn(name, F.coalesce("own", "tail")[column]).drop("own", "tail")


def with_running_sum(placed: DataFrame, column: str, name: str) -> DataFrame:
    """With the sum of ``column`` up to each row, over all ranges."""
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = placed.groupBy("range").agg(F.sum(column).alias("sum")).select("range", F.coalesce(F.sum("sum").over(by_range), F.lit(0)).alias("before"))
    own = F.sum(column).over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("own", own).join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("own")).drop("own", "before")
