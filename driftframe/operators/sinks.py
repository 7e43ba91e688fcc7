"""Sinks: fleet results as CSV, JSON lines and typed objects, file plans, deploy scripts; structured table queries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.operators.shared import few, in_ranges, with_running_sum

CELL_CHARACTERS = 32_767
NAME_CHARACTERS = 31


def write_csv(result: DataFrame, path: str) -> DataFrame:
    """Write a fleet result as CSV and read it back; ``Server`` leads only if several servers gave rows."""
    several = result.select("server_id").distinct().limit(2).count() > 1
    rows = result.withColumn("Server", F.col("server_name")) if several else result
    rows = rows.select(*(["Server"] if several else []), *(c for c in result.columns if c not in ("server_id", "server_name")))
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return result.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


#: Columns of the discrepancy report, in order.
REPORT = ("difference", "table_name", "column_name", "server_name", "details")


def severity(c: str = "difference") -> F.Column:
    """Class of a discrepancy in a report: missing, different, or null for others."""
    return F.when(F.col(c) == "MISSING", "missing").when(F.col(c) == "DIFFERENT", "different")


def write_discrepancies(discrepancies: DataFrame, path: str) -> DataFrame:
    """Write the report as files of fields between ``;``, with heads in capitals, nulls blank and empty texts in quotes, and read it back with its severity."""
    form = {"sep": ";", "header": True, "escape": '"', "multiLine": True}
    rows = discrepancies.select(*(F.col(c).alias(c.upper()) for c in REPORT))
    rows.write.options(**form).csv(path)
    # a blank field is read as the text that stands for null, which must not be the empty one
    back = discrepancies.sparkSession.read.schema(rows.schema).options(**form, nullValue="\0").csv(path)
    return back.select(*(F.col(c.upper()).alias(c) for c in REPORT)).withColumn("severity", severity())


def granted_rows(df: DataFrame, granted: Row, filters: Sequence[tuple] = (), order_by: Sequence[tuple] = ()) -> DataFrame:
    """Rows of a table under a request as ``rules.granted_queries`` judged it: its columns and limit, filters (name, operator, value) and order (name, direction) by the names they stand for.

    PermissionError where it was not granted, or for a name that was not judged.
    """
    if granted.reason is not None:
        raise PermissionError(granted.reason)
    unjudged = [c for c, *_ in (*filters, *order_by) if c.strip() not in granted.names]
    if unjudged:
        raise PermissionError(f"not judged: {unjudged[0]}")
    meant = lambda terms: [(granted.names[c.strip()], *rest) for c, *rest in terms]
    return table_query(df, granted.columns, meant(filters), meant(order_by), granted.row_limit)


def sheet_names(servers: DataFrame) -> DataFrame:
    """(server_id, sheet_name): names cut to 31 characters, with the id where two are the same."""
    cut = servers.select("server_id", F.substring("server_name", 1, NAME_CHARACTERS).alias("cut"))
    nth = F.row_number().over(Window.partitionBy(F.lower("cut")).orderBy("server_id"))
    suffix = F.concat(F.lit("_"), F.col("server_id").cast("string"))
    return cut.select("server_id", F.when(nth == 1, F.col("cut")).otherwise(F.concat(F.expr(f"left(cut, {NAME_CHARACTERS} - length(concat('_', server_id)))"), suffix)).alias("sheet_name"))


def write_per_server(result: DataFrame, path: str) -> DataFrame:
    named = result.join(few(sheet_names(result.select("server_id", "server_name").distinct())), "server_id")
    named.write.partitionBy("sheet_name").parquet(path)
    return result.sparkSession.read.parquet(path)


def write_combined(result: DataFrame, path: str) -> DataFrame:
    """All servers in one table, ``Server`` first; texts are clipped, and those that look like a number have it beside them."""
    clipped = []
    for c, t in result.dtypes:
        if c in ("server_id", "server_name"):
            continue
        clipped.append(F.substring(c, 1, CELL_CHARACTERS).alias(c) if t == "string" else F.col(c))
        if t == "string":
            clipped.append(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(f"{c}_number"))
    result.select(F.col("server_name").alias("Server"), *clipped).write.parquet(path)
    return result.sparkSession.read.parquet(path)


def json_lines(df: DataFrame, key: str, cap: int) -> DataFrame:
    """(seq, line): the column names, then a JSON array for each row in the order of ``key``, while ``cap`` bytes last.

    A row has four bytes at least, so no more than cap / 4 rows are sorted into one window.
    """
    array = F.to_json(F.array(*(F.col(c).cast("string") for c in df.columns)))
    first = df.orderBy(key).limit(cap // 4 + 1).select(key, array.alias("line"))
    order = Window.orderBy(key)
    rows = first.withColumn("seq", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = df.sparkSession.range(1).select(F.lit(0).alias("seq"), F.lit('{"columns":[' + ",".join(f'"{c}"' for c in df.columns) + "]}").alias("line"))
    return head.unionByName(rows.where(F.col("bytes") <= cap).select("seq", "line"))


def cells(customers: DataFrame, documents: DataFrame, pages: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """(row_id, column_name, source_type, bytes) of texts, pages, and names behind magic bytes, given in hex."""
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("c_custkey") % len(heads) + 1).cast("int"))
    binary = customers.select(F.col("c_custkey").alias("row_id"), F.lit("BLOB").alias("column_name"), F.lit("BLOB").alias("source_type"), F.concat(F.unhex(head), F.encode("c_name", "UTF-8")).alias("bytes"))
    text = documents.select(F.col("doc_id").alias("row_id"), F.lit("TEXT").alias("column_name"), F.lit("TEXT").alias("source_type"), F.encode("text", "UTF-8").alias("bytes"))
    html = pages.select(F.col("page_id").alias("row_id"), F.lit("CLOB").alias("column_name"), F.lit("CLOB").alias("source_type"), F.encode("html", "UTF-8").alias("bytes"))
    return text.unionByName(html).unionByName(binary)


def discrepancy_report(discrepancies: DataFrame, sample: int = 20, top: int = 50) -> DataFrame:
    """(part, key, line): every discrepancy as a JSON line, the first ``sample`` in order, and a summary: counts by difference, of tables, and of the ``top`` tables."""
    line = F.to_json(F.struct("difference", "element", F.col("table_name").alias("table"), F.col("column_name").alias("column"), "server_id", F.col("server_name").alias("server"), "details"))
    order = ["table_name", "server_id", "element", "column_name"]
    part = lambda df, name, key, value: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("line"))
    every = part(discrepancies, "lines", F.lit(None), line)
    first = part(discrepancies.orderBy(*order).limit(sample), "sample", F.lit(None), line)
    kinds = part(discrepancies.groupBy("difference").count(), "by difference", F.col("difference"), F.col("count"))
    tables = part(discrepancies.agg(F.count_distinct("table_name").alias("n")), "tables", F.lit(None), F.col("n"))
    most = part(discrepancies.groupBy("table_name").count().orderBy(F.desc("count"), "table_name").limit(top), "top tables", F.col("table_name"), F.col("count"))
    return every.unionByName(first).unionByName(kinds).unionByName(tables).unionByName(most)


def plan_files(objects: DataFrame, defaults: DataFrame, overrides: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, path, name, sha256, exists) of the files that definitions (schema_name, object_type, name, ddl) are saved as.

    Options are storage_mode (code, migration, else both), extension and folder, of ``defaults`` by object_type, and of ``overrides`` by schema, in lower
    case, and type, blank for all types; the most special one that is set counts. A migration's version follows the
    largest of its folder in ``existing`` (path, name).
    """
    rows = objects.withColumn("schema", F.lower("schema_name"))
    wide = few(defaults.select("object_type", *(F.col(c).alias(f"d_{c}") for c in ("storage_mode", "extension", "folder"))))
    own = few(overrides.where("object_type != ''").select(F.col("schema_name").alias("schema"), "object_type", *(F.col(c).alias(f"o_{c}") for c in ("storage_mode", "extension", "folder"))))
    every = few(overrides.where("object_type = ''").select(F.col("schema_name").alias("schema"), *(F.col(c).alias(f"s_{c}") for c in ("storage_mode", "extension", "folder"))))
    rows = rows.join(wide, "object_type", "left").join(own, ["schema", "object_type"], "left").join(every, "schema", "left")
    option = lambda c, usual: F.coalesce(*(F.nullif(F.trim(f"{k}_{c}"), F.lit("")) for k in "osd"), F.lit(usual))
    mode = option("storage_mode", "both")
    kinds = F.when(mode.isin("code", "migration"), F.array(mode)).otherwise(F.array(F.lit("code"), F.lit("migration")))
    rows = rows.withColumn("kind", F.explode(kinds)).withColumn("path", F.concat_ws("/", option("folder", "sql"), "schema", "kind"))
    version = F.regexp_extract("name", r"^V(\d+)__", 1).try_cast("int")
    top = existing.groupBy("path").agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("version"))
    rows = rows.join(few(top), "path", "left")
    ending = F.concat(F.lit("."), F.regexp_replace(option("extension", "sql"), r"^\.+", ""))
    name = F.concat(F.when(F.col("kind") == "migration", F.concat(F.lit("V"), F.coalesce("version", F.lit(1)).cast("string"), F.lit("__"), F.col("schema"), F.lit("_"))).otherwise(""), F.lower("name"), ending)
    named = rows.select("kind", "path", name.alias("name"), F.sha2("ddl", 256).alias("sha256"))
    return named.join(existing.select("path", "name").distinct().withColumn("exists", F.lit(True)), ["path", "name"], "left").select("kind", "path", "name", "sha256", F.coalesce("exists", F.lit(False)).alias("exists"))


def byte_capped(df: DataFrame, key: str, cap: int) -> DataFrame:
    """``df`` with running_bytes, rows in the order of ``key`` while their cells, with two bytes more each and four where null, stay within ``cap``; and truncated."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")) + 2, F.lit(4)) for c in df.columns), F.lit(0)).cast("long")
    placed = with_running_sum(in_ranges(df.withColumn("size", size), key), "size", "running_bytes")
    more = placed.agg((F.max("running_bytes") > cap).alias("truncated"))
    return placed.where(F.col("running_bytes") <= cap).drop("size", "place", "range").crossJoin(F.broadcast(more))  # one row


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]{0,127}")
OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v), "in": lambda c, v: c.isin(v), "is_null": lambda c, v: c.isNull(), "is_not_null": lambda c, v: c.isNotNull(),
}


def check_spec(df: DataFrame, columns: Sequence[str], filters: Sequence[tuple], order_by: Sequence[tuple], limit: int) -> None:
    """Raise ValueError for what a structured query must not ask."""
    for c in [*columns, *(f[0] for f in filters), *(o[0] for o in order_by)]:
        if not IDENTIFIER.fullmatch(c) or c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    if len(filters) > 20 or not 1 <= limit <= 10_000:
        raise ValueError("too many filters, or a limit out of range")
    for _, op, value in filters:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        if (op == "in") != isinstance(value, (list, tuple)) or (op == "in" and not 1 <= len(value) <= 100):
            raise ValueError(f"{op} has a value of the wrong shape")
        if isinstance(value, str) and (len(value) > 4000 or "\0" in value):
            raise ValueError("value too long, or with a NUL")
    if any(d not in ("asc", "desc") for _, d in order_by):
        raise ValueError("order is asc or desc")


def table_query(df: DataFrame, columns: Sequence[str], filters: Sequence[tuple] = (), order_by: Sequence[tuple] = (), limit: int = 200) -> DataFrame:
    """Chosen columns under ANDed filters, in order, one row more than the limit to show truncation."""
    check_spec(df, columns, filters, order_by, limit)
    for c, op, value in filters:
        df = df.where(OPERATORS[op](F.col(c), value))
    if order_by:
        df = df.orderBy(*(getattr(F.col(c), d)() for c, d in order_by))
    return df.limit(limit + 1).select(*columns)


def spec_violations(specs: DataFrame) -> DataFrame:
    """(spec_id, violation) of filters of structured queries given as rows (spec_id, column_name, op, value, n_values): what ``check_spec`` would raise, each once.

    n_values is the number of values where they are a list, else null.
    """
    listed, none = F.col("n_values").isNotNull(), F.col("op").isin("is_null", "is_not_null")
    known = F.col("op").isin(*OPERATORS)
    rules = (
        ("bad identifier", ~F.coalesce(F.col("column_name").rlike(f"^{IDENTIFIER.pattern}$"), F.lit(False))),
        ("unknown operator", ~F.coalesce(known, F.lit(False))),
        ("wrong shape", known & ((F.col("op") == "in") != listed)),
        ("wrong number of values", (F.col("op") == "in") & listed & ~F.col("n_values").between(1, 100)),
        ("no value", known & ~none & ~listed & F.col("value").isNull()),
        ("value too long", F.length("value") > 4000),
        ("NUL in a value", F.col("value").contains("\0")),
    )
    found = specs.select("spec_id", F.explode(F.array_compact(F.array(*(F.when(when, why) for why, when in rules)))).alias("violation")).distinct()
    many = specs.groupBy("spec_id").agg(F.count("*").alias("n")).where("n > 20").select("spec_id", F.lit("too many filters").alias("violation"))
    return found.unionByName(many)
