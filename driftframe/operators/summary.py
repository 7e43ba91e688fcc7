"""Summaries of catalogs, discrepancies, logs and texts, their order and pages, and sets of names over servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators.rules import wildcard_match
from driftframe.operators.shared import few

#: Types of objects in the order in which they are listed.
TYPES = ("TABLE", "VIEW")


def by_difference(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.groupBy("difference").agg(F.count("*").alias("n"))


def top_tables(discrepancies: DataFrame, most: int = 50) -> DataFrame:
    """(table_name, n): the tables with the most discrepancies."""
    return discrepancies.groupBy("table_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_name").limit(most)


def table_count(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.agg(F.count_distinct("table_name").alias("n_tables"))


def hidden_count(discrepancies: DataFrame, patterns: list[str]) -> DataFrame:
    """(n_before, n_hidden): discrepancies, and those of tables that a wildcard hides."""
    hidden = F.lit(False)
    for p in patterns:
        hidden = hidden | wildcard_match("table_name", F.lit(p))
    return discrepancies.agg(F.count("*").alias("n_before"), F.count_if(hidden).alias("n_hidden"))


def index_columns(columns: DataFrame) -> DataFrame:
    """(table_name, index_name, columns) of each index, columns by name."""
    return columns.where("index_name is not null").groupBy("table_name", "index_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ", ").alias("columns"))


def issues_by_table(issues: DataFrame) -> DataFrame:
    """(history_table, n_issues, n_servers) of history issues."""
    return issues.groupBy("history_table").agg(F.count("*").alias("n_issues"), F.count_distinct("server_id").alias("n_servers"))


def fix_counts(fixes: DataFrame) -> DataFrame:
    """(target, generated, skipped): statements and skipped discrepancies of each target."""
    return fixes.groupBy("target").agg(F.count("statement").alias("generated"), F.count("skip_reason").alias("skipped"))


def first_fixes(fixes: DataFrame) -> DataFrame:
    """Fixes with a statement, without those that an earlier one repeats for the same target, table, column and kind."""
    same = Window.partitionBy("target", "table_name", "column_name", "kind", "statement").orderBy("id")
    return fixes.where("statement is not null").withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")


def next_version(names: DataFrame, column: str = "name") -> DataFrame:
    """(next_version): one more than the largest ``V<number>__`` of the names."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(column, r"^V(\d+)__", 1).try_cast("int")), F.lit(0)) + 1).alias("next_version"))


#: Fixed value: names that are looked at.
MOST_SCANNED = 500


def first_seen_names(df: DataFrame, key: str, name: str, position: str, cap: int, scanned: int = MOST_SCANNED) -> DataFrame:
    """(key, n_total, names): distinct names of each key among its first ``scanned``, in the order and spelling in which they come first, ``cap`` of them shown.

    Names are trimmed and blind to the case of A to Z; empty ones don't count.
    """
    rows = df.select(key, F.col(position).alias("pos"), F.trim(F.col(name), F.lit(" \t\n\r\x0b\f")).alias("name")).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("nth") <= scanned).where("name <> ''")
    same = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = rows.groupBy(key, same.alias("same")).agg(F.min(F.struct("pos", "name")).alias("first"))
    shown = first.groupBy(key).agg(F.count("*").alias("n_total"), F.array_sort(F.collect_list("first")).alias("all"))  # ``scanned`` at most
    return shown.select(key, "n_total", F.array_join(F.transform(F.slice("all", 1, cap), lambda x: x["name"]), ", ").alias("names"))


def severity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("connection_id").agg(F.count_if(F.col("outcome_raw") == "error").alias("errors"), F.count_if(F.col("outcome_raw") == "denied").alias("warnings"))


def drift_cube(discrepancies: DataFrame) -> DataFrame:
    """(server_id, difference, element, n, gid): counts with their subtotals by server, and 8 for those over all servers."""
    gid = F.grouping("server_id") * 4 + F.grouping("difference") * 2 + F.grouping("element")
    rolled = discrepancies.rollup("server_id", "difference", "element").agg(F.count("*").alias("n"), gid.cast("int").alias("gid"))
    cubed = discrepancies.cube("difference", "element").agg(F.count("*").alias("n"))
    return rolled.unionByName(cubed.select(F.lit(None).cast(rolled.schema["server_id"].dataType).alias("server_id"), "difference", "element", "n", F.lit(8).alias("gid")))


def objects_by_type(objects: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(object_type, n, place): counts, and each type's place in ``types``, 99 for others."""
    place = F.array_position(F.array(*map(F.lit, types)), F.col("object_type"))
    return objects.groupBy("object_type").agg(F.count("*").alias("n")).withColumn("place", F.when(place > 0, place).otherwise(99).cast("int"))


def all_tables(columns: DataFrame) -> DataFrame:
    return columns.select("table_name").distinct()


def table_spread(columns: DataFrame, servers: int) -> DataFrame:
    """(table_name, n_servers, kind): on how many servers a table is; common to all, on one only, or on some."""
    n = F.count_distinct("server_id")
    kind = F.when(n == servers, "common").when(n == 1, F.concat(F.lit("only "), F.min("server_id").cast("string"))).otherwise("some")
    return columns.groupBy("table_name").agg(n.alias("n_servers"), kind.alias("kind"))


def rule_reach(columns: DataFrame, matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(action, match_type, pattern, n_tables) of each enabled rule; ``matches`` has its tables."""
    keys = ["action", "match_type", "pattern"]
    hit = matches.groupBy(*keys).agg(F.count_distinct("table_name").alias("n"))
    return few(rules.where("enabled").select(*keys).distinct()).join(hit, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_tables"))


def browse(discrepancies: DataFrame, text: str, server: int | None = None) -> DataFrame:
    """Discrepancies of a server with the text, blind to case, in one of the shown fields."""
    needle = text.strip().lower()
    hit = F.lit(False)
    for c in ("table_name", "column_name", "server_name", "difference", "details"):
        hit = hit | F.lower(c).contains(needle)
    return discrepancies.where(hit) if server is None else discrepancies.where((F.col("server_id") == server) & hit)


def contains_all(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that have each column's text, blind to case; blank texts ask nothing."""
    for c, text in filters.items():
        if text.strip():
            df = df.where(F.lower(c).contains(text.strip().lower()))
    return df


def change_text(discrepancies: DataFrame) -> DataFrame:
    """(server_id, table_name, column_name, element, change_text): missing, extra, or ``reference -> actual``."""
    said = F.replace(F.regexp_replace("details", "^[A-Z_]+: ", ""), F.lit(" != "), F.lit(" -> "))
    text = F.when((F.col("difference") == "MISSING") & F.col("details").contains("found in reference server"), "missing").when(F.col("difference") == "MISSING", "extra").otherwise(said)
    return discrepancies.select("server_id", "table_name", "column_name", "element", text.alias("change_text"))


def chosen_tables(discrepancies: DataFrame, names: list[str], missing: bool = True) -> DataFrame:
    """(table_name): tables of the list, names trimmed and blind to case, and with ``missing`` those that a server lacks."""
    wanted = [n.strip().upper() for n in names]
    chosen = F.upper(F.trim("table_name")).isin(wanted) | ((F.col("element") == "TABLE") & F.lit(missing))
    return discrepancies.where(chosen).select("table_name").distinct()


def access_preview(objects: DataFrame, policies: DataFrame, access: DataFrame) -> DataFrame:
    """(connection_id, name, data_access) of shown objects of connections with a policy: allowed, restricted to columns, denied, or n/a."""
    shown = objects.withColumnRenamed("server_id", "connection_id").join(few(policies.select("connection_id")), "connection_id", "left_semi")
    own = access.withColumnRenamed("table_name", "name")
    verdict = F.when(F.col("object_type") != "TABLE", "n/a").when(F.col("allowed") & F.col("column_rules"), "restricted").when(F.col("allowed"), "allowed").otherwise("denied")
    return shown.join(own, ["connection_id", "name"], "left").select("connection_id", "name", verdict.alias("data_access"))


def last_per_key(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row for each key: the largest of ``by``; sums that are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max(by).alias(by))


def page(df: DataFrame, order: list, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page in an order; 1 to 10 000 rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(10_000, limit)))


def natural_key(c: str | F.Column) -> F.Column:
    """A sort key in which numbers of any length count as numbers, blind to case and accents.

    A number is its digits after leading zeros, behind how many they are; the whole is compared by a collation.
    """
    parts = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit("([0-9]+|[^0-9]+)"), 1)
    digits = lambda x: F.ltrim(x, F.lit("0"))
    key = F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)), "")
    return F.collate(key, "UNICODE_CI_AI")


def log_order() -> list[F.Column]:
    """Favourites, then their own order, pinned entries, the newest."""
    return [F.desc("favorite"), F.asc("sort_order"), F.desc("pinned"), F.desc("id")]


def lookup_names(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, matched, priority): the name that a key means: exactly 1, in upper case 2, in lower case 3, else in any case 4."""
    low = names.select(F.col("table_name").alias("name"), F.lower("table_name").alias("low")).distinct()
    priority = F.when(F.col("name").isNull(), 4).when(F.col("name") == F.col("key"), 1).when(F.col("name") == F.upper("key"), 2).when(F.col("name") == F.lower("key"), 3).otherwise(4)
    found = keys.withColumn("low", F.lower("key")).join(low, "low", "left").withColumn("priority", priority)
    return found.groupBy("key").agg(F.min_by("name", F.struct("priority", "name")).alias("matched"), F.min("priority").alias("priority"))
