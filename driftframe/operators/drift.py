"""Schema drift: every server's catalog against a reference server's, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators.shared import few, in_ranges, with_running_sum

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ATTRIBUTES = ("data_type", "data_length", "data_default", "comments", "index_name")
ELEMENTS = ("TABLE", "COLUMN", "COLUMN_NAME", *(a.upper() for a in ATTRIBUTES))


def ascii_lower(column: str | F.Column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def differs(a: F.Column, b: F.Column) -> F.Column:
    """Null-safe, and blind to the case of ASCII letters."""
    return ~ascii_lower(a).eqNullSafe(ascii_lower(b))


def labelled(df: DataFrame, servers: DataFrame) -> DataFrame:
    """With server_name, ``#id`` where the server is unknown."""
    names = few(servers.select("server_id", "server_name"))
    return df.join(names, "server_id", "left").withColumn("server_name", F.coalesce("server_name", F.concat(F.lit("#"), "server_id")))


def _others(servers: DataFrame, reference: int) -> DataFrame:
    """Ids of all servers but the reference, which must be one of them; a server counts even where its catalog is empty."""
    if servers.where(F.col("server_id") == reference).isEmpty():
        raise ValueError(f"the reference server {reference} is not in the server list")
    return servers.where(F.col("server_id") != reference).select("server_id").distinct()


def compare(columns: DataFrame, servers: DataFrame, reference: int, tables: bool = True, cols: bool = True, comments: bool = True, indexes: bool = True, key: str = "column_name") -> DataFrame:
    """(server_id, server_name, difference, element, table_name, column_name, details) of all differences from ``reference``.

    A table missing on one side gives one row and no column rows, a server without rows lacks all tables; two real index names never differ.
    Columns meet by ``key``; where that isn't column_name, names are compared too. Rows of the catalog are partitioned by server and table
    once, for the join and the windows over it.
    """
    by = ["server_id", "table_name", "key"]
    kept = columns.withColumn("key", F.col(key))
    fields = F.struct("column_name", *ATTRIBUTES)
    ref = kept.where(F.col("server_id") == reference).select("table_name", "key", fields.alias("r")).crossJoin(few(_others(servers, reference)))
    cur = kept.where(F.col("server_id") != reference).select(*by, fields.alias("c"))
    table = Window.partitionBy("server_id", "table_name")
    both = ref.join(cur, by, "full_outer")
    both = both.withColumn("has_ref", F.max(F.col("r").isNotNull()).over(table)).withColumn("has_cur", F.max(F.col("c").isNotNull()).over(table))
    both = both.withColumn("first", F.row_number().over(table.orderBy("key")) == 1)
    reference_name = servers.where(F.col("server_id") == reference).select(F.upper("server_name").alias("ref_name"))
    both = labelled(both, servers).crossJoin(F.broadcast(reference_name.limit(1)))
    here, there = F.upper("server_name"), F.col("ref_name")
    absent = F.concat(F.lit(" found in reference server "), there, F.lit(" but not in server "), here)
    extra = F.concat(F.lit(" found in server "), here, F.lit(" but not in reference server "), there)

    def row(on: bool, when: F.Column, difference: str, element: str, details: F.Column) -> F.Column:
        return F.when(F.lit(on) & when, F.struct(F.lit(difference).alias("difference"), F.lit(element).alias("element"), details.alias("details")))

    no_table = ~(F.col("has_ref") & F.col("has_cur"))
    paired = F.col("r").isNotNull() & F.col("c").isNotNull()
    null = lambda c: F.coalesce(c, F.lit("NULL"))
    rows = [
        row(tables, no_table & F.col("first"), "MISSING", "TABLE", F.when(F.col("has_ref"), F.concat(F.lit("Table"), absent)).otherwise(F.concat(F.lit("Table "), "table_name", extra))),
        row(cols, ~no_table & ~paired, "MISSING", "COLUMN", F.when(F.col("c").isNull(), F.concat(F.lit("Column"), absent)).otherwise(F.concat(F.lit("Column "), "key", extra))),
    ]
    for a in ATTRIBUTES if key == "column_name" else ("column_name", *ATTRIBUTES):
        r, c = F.col(f"r.{a}"), F.col(f"c.{a}")
        on, when = cols, paired & differs(r, c)
        details = F.concat(F.lit(f"{a.upper()}: "), null(r), F.lit(" != "), null(c))
        if a == "data_length":
            typed = lambda s: F.concat(F.coalesce(F.col(f"{s}.data_type"), F.lit("?")), F.lit("("), null(F.col(f"{s}.data_length")), F.lit(")"))
            details = F.concat(typed("r"), F.lit(" != "), typed("c"))
        if a == "comments":
            on = comments
        if a == "index_name":
            on = indexes
            real = lambda x: x.isNotNull() & (x != "") & (ascii_lower(x) != "none")
            when = when & ~(real(r) & real(c))
        rows.append(row(on, when, "DIFFERENT", a.upper(), details))
    found = both.select("server_id", "server_name", "table_name", "key", F.explode(F.array_compact(F.array(*rows))).alias("d"))
    column = F.when(F.col("d.element") == "TABLE", "").otherwise(F.col("key"))
    return found.select("server_id", "server_name", "d.difference", "d.element", "table_name", column.alias("column_name"), "d.details")


def missing_tables(columns: DataFrame, servers: DataFrame, reference: int) -> DataFrame:
    """(server_id, table_name, side): absent on the server, which may have no rows at all, or extra there."""
    tables = columns.select("server_id", "table_name").distinct()
    ref = tables.where(F.col("server_id") == reference).select("table_name")
    others = tables.where(F.col("server_id") != reference)
    expected = expected_tables(ref, _others(servers, reference))
    absent = expected.join(others, ["server_id", "table_name"], "left_anti").withColumn("side", F.lit("absent"))
    extra = others.join(ref, "table_name", "left_anti").select("server_id", "table_name", F.lit("extra").alias("side"))
    return absent.select("server_id", "table_name", "side").unionByName(extra)


def expected_tables(ref: DataFrame, servers: DataFrame) -> DataFrame:
    """Each reference table on each server; servers are few."""
    return ref.crossJoin(few(servers)).select("server_id", "table_name")


def missing_columns(columns: DataFrame, reference: int) -> DataFrame:
    """(server_id, table_name, column_name, side) within tables that both sides have."""
    key = ["server_id", "table_name", "column_name"]
    ref = columns.where(F.col("server_id") == reference).select("table_name", "column_name")
    cur = columns.where(F.col("server_id") != reference).select(*key)
    shared = cur.select("server_id", "table_name").distinct().join(ref.select("table_name").distinct(), "table_name", "left_semi")
    absent = ref.join(shared, "table_name").join(cur, key, "left_anti").select(*key, F.lit("absent").alias("side"))
    extra = cur.join(shared, ["server_id", "table_name"], "left_semi").join(ref, ["table_name", "column_name"], "left_anti").select(*key, F.lit("extra").alias("side"))
    return absent.unionByName(extra)


def numbered(discrepancies: DataFrame) -> DataFrame:
    """With id from 1 in the order of table, server, element and column.

    Ranges of that order are numbered each by itself, after the rows of the ranges before; no task sorts all rows, or all of a table.
    """
    rank = F.array_position(F.array(*map(F.lit, ELEMENTS)), F.col("element"))
    order = ["table_name", "server_id", "rank", "column_name"]
    placed = in_ranges(discrepancies.withColumn("rank", rank).withColumn("one", F.lit(1)), *order)
    return with_running_sum(placed, "one", "id").drop("range", "place", "rank", "one")
