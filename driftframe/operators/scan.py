"""Column catalogs of a fleet from the servers' own catalog tables, one shape for both engines.

Each operator takes the catalog tables of all servers of one engine, with server_id, and gives (server_id, table_name, column_name, data_type,
data_length, data_default, comments, index_name, index_position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("server_id", "table_name", "column_name", "data_type", "data_length", "data_default", "comments", "index_name", "index_position")
#: Types whose length is no part of a comparison, and kinds of relations that are base tables.
WITHOUT_LENGTH = ("DATE", "CLOB", "BLOB", "LONG RAW")
BASE_TABLE = "r"


def cleaned(c: str | Column) -> Column:
    """A catalog's text without line breaks and outer white space; what says nothing is null."""
    c = F.trim(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\n"), F.lit("")), F.lit(" \t\r\x0b\f"))
    return F.when((c != "") & (F.lower(c) != "null"), c)


def shown_length(data_type: str = "data_type") -> Column:
    """What counts as the length of a column: digits of numbers, characters of national text, none of large ones, else bytes."""
    kind = F.col(data_type)
    length = F.when(kind == "NUMBER", F.col("data_precision")).when(kind.isin(*WITHOUT_LENGTH), F.lit(None)).when(kind == "NVARCHAR2", F.col("char_length"))
    return length.otherwise(F.col("data_length")).cast("string")


def scan_oracle(columns: DataFrame, comments: DataFrame, index_columns: DataFrame, indexes: DataFrame, views: DataFrame, materialized: DataFrame, owners: DataFrame) -> DataFrame:
    """Columns of the tables of each server's owner (server_id, owner): no views, no materialized views, no columns without an entry in comments.

    columns (owner, table_name, column_name, data_type, data_length, data_precision, char_length, data_default); comments (owner, table_name,
    column_name, comments); index_columns (index_owner, index_name, table_name, column_name, column_position); indexes (owner, index_name);
    views and materialized (owner, name). Of a column's indexes the last by name and place counts, one without an entry in indexes
    after all others and without a name.
    """
    at = ["server_id", "owner", "table_name"]
    mine = columns.join(owners, ["server_id", "owner"], "left_semi")
    hidden = views.select("server_id", "owner", F.col("name").alias("table_name")).unionByName(materialized.select("server_id", "owner", F.col("name").alias("table_name")))
    tables = mine.join(hidden, at, "left_anti").join(comments, [*at, "column_name"])
    known = indexes.select("server_id", F.col("owner").alias("index_owner"), "index_name", F.lit(True).alias("known"))
    named = index_columns.join(known, ["server_id", "index_owner", "index_name"], "left").withColumn("index_name", F.when(F.col("known"), F.col("index_name")))
    order = F.struct(F.col("index_name").isNull().alias("a"), F.col("index_name").alias("b"), F.col("column_position").isNull().alias("c"), F.col("column_position").alias("d"))
    last = named.groupBy("server_id", F.col("index_owner").alias("owner"), "table_name", "column_name").agg(F.max_by(F.struct("index_name", "column_position"), order).alias("i"))
    rows = tables.join(last, [*at, "column_name"], "left")
    return rows.select("server_id", "table_name", "column_name", cleaned("data_type").alias("data_type"), cleaned(shown_length()).alias("data_length"), cleaned("data_default").alias("data_default"), cleaned("comments").alias("comments"), cleaned("i.index_name").alias("index_name"), F.col("i.column_position").cast("int").alias("index_position"))


def scan_postgres(attributes: DataFrame, classes: DataFrame, defaults: DataFrame, descriptions: DataFrame, indexes: DataFrame, schemas: DataFrame) -> DataFrame:
    """Columns of the base tables of each server's schema (server_id, nspname): no views, system or dropped columns; a column's first index by name.

    attributes (attrelid, attnum, attname, attisdropped, type_text); classes (oid, relname, relkind, nspname), those of indexes included;
    defaults (adrelid, adnum, default_text); descriptions (objoid, objsubid, description); indexes (indexrelid, indrelid, indkey: array of attnum). An
    index over an expression has 0 there, which is no column.
    """
    tables = classes.where(F.col("relkind") == BASE_TABLE).join(schemas, ["server_id", "nspname"], "left_semi").select("server_id", F.col("oid").alias("attrelid"), F.col("relname").alias("table_name"))
    own = attributes.where("attnum > 0 AND NOT attisdropped").join(tables, ["server_id", "attrelid"])
    texts = defaults.select("server_id", F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), "default_text")
    notes = descriptions.select("server_id", F.col("objoid").alias("attrelid"), F.col("objsubid").alias("attnum"), "description")
    keys = indexes.select("server_id", F.col("indrelid").alias("attrelid"), F.col("indexrelid").alias("oid"), F.explode(F.array_distinct("indkey")).alias("attnum"))
    first = keys.join(classes.select("server_id", "oid", "relname"), ["server_id", "oid"]).groupBy("server_id", "attrelid", "attnum").agg(F.min("relname").alias("index_name"))
    at = ["server_id", "attrelid", "attnum"]
    rows = own.join(texts, at, "left").join(notes, at, "left").join(first, at, "left")
    trimmed = F.trim("default_text", F.lit(" \t\n\r"))
    none = F.lit(None)
    said = F.when(F.trim("description", F.lit(" \t\n\r")) != "", F.col("description"))
    return rows.select("server_id", "table_name", F.col("attname").alias("column_name"), F.col("type_text").alias("data_type"), none.cast("string").alias("data_length"), F.when(trimmed != "", trimmed).alias("data_default"), said.alias("comments"), "index_name", none.cast("int").alias("index_position"))


def columns_of(catalog: DataFrame, server_id: int, table_name: str) -> DataFrame:
    """(column_name, column_id) of one table."""
    return catalog.where((F.col("server_id") == server_id) & (F.col("table_name") == table_name)).select("column_name", "column_id")
