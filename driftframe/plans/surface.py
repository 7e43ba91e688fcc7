"""Queries of catalogs, windows, texts, large cells, the audit log, sinks, streams and the SQL function surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.operators import audit, heads, rules, scan, sinks, summary, text
from driftframe.operators.shared import scratch, written
from driftframe.plans import fleet  # noqa: F401  (views that this module reads)
from driftframe.plans.registry import ORACLE_SQL, ORACLE_TEXT, QUERIES, bound, sql
from driftframe.sources import fanout, fixtures
from driftframe.sources.fixtures import VIEWS, query, view
from driftframe.streaming import audit_stream

# ---------------------------------------------------------------- catalogs

#: The catalog tables of servers of both engines, taken from the fleet's columns and indexes.
_TABLE_ID = "CAST(nullif(translate(c.table_name, 'THISMP_', ''), '') AS BIGINT)"
VIEWS["oracle_columns"] = """
SELECT server_id, CASE WHEN column_id = 7 THEN 'OTHER' ELSE 'APP' END AS owner, table_name, column_name, CASE data_type WHEN 'varchar2' THEN 'NVARCHAR2' WHEN 'CLOB' THEN 'LONG RAW' ELSE data_type END AS data_type,
 CAST(data_length AS INT) * 4 AS data_length, CAST(data_length AS INT) AS data_precision, CAST(data_length AS INT) + 1 AS char_length, concat(' ', data_default, chr(10)) AS data_default FROM fleet_columns WHERE server_id < 3"""
VIEWS["oracle_comments"] = "SELECT server_id, CASE WHEN column_id = 7 THEN 'OTHER' ELSE 'APP' END AS owner, table_name, column_name, concat(chr(13), chr(10), CASE WHEN column_id = 2 THEN 'Null' ELSE comments END, ' ') AS comments FROM fleet_columns WHERE server_id < 3 AND (column_id <> 3 OR server_id <> 1)"
VIEWS["oracle_index_columns"] = f"SELECT c.server_id, c.owner AS index_owner, i.index_name, c.table_name, c.column_name, i.index_position AS column_position FROM oracle_columns c JOIN fleet_index_columns i ON i.server_id = c.server_id AND i.column_name = c.column_name AND i.table_id = {_TABLE_ID}"
VIEWS["oracle_indexes"] = "SELECT DISTINCT server_id, index_owner AS owner, index_name FROM oracle_index_columns WHERE index_name <> 'IX_NO'"
VIEWS["oracle_views"] = "SELECT server_id, 'APP' AS owner, name FROM objects WHERE object_type = 'VIEW'"
VIEWS["oracle_mviews"] = "SELECT server_id, 'APP' AS owner, name FROM objects WHERE object_type = 'MATERIALIZED VIEW'"
VIEWS["oracle_owners"] = "SELECT server_id, schema_name AS owner FROM fleet_servers WHERE server_id < 3"
bound(
    "sc1",
    scan.scan_oracle,
    "oracle_columns oracle_comments oracle_index_columns oracle_indexes oracle_views oracle_mviews oracle_owners",
    """SELECT c.server_id, c.table_name, c.column_name, c.data_type, CAST(CASE c.data_type WHEN 'NUMBER' THEN data_precision WHEN 'NVARCHAR2' THEN char_length WHEN 'DATE' THEN NULL WHEN 'LONG RAW' THEN NULL ELSE data_length END AS VARCHAR) AS data_length,
 nullif(trim(replace(c.data_default, chr(10), '')), '') AS data_default, nullif(nullif(trim(replace(replace(o.comments, chr(10), ''), chr(13), '')), ''), 'Null') AS comments, i.index_name, i.column_position AS index_position
 FROM oracle_columns c JOIN oracle_comments o ON o.server_id = c.server_id AND o.owner = c.owner AND o.table_name = c.table_name AND o.column_name = c.column_name
 LEFT JOIN (SELECT ic.server_id, ic.index_owner, ic.table_name, ic.column_name, x.index_name, ic.column_position, row_number() OVER (PARTITION BY ic.server_id, ic.index_owner, ic.table_name, ic.column_name ORDER BY x.index_name DESC NULLS FIRST, ic.column_position DESC) AS rn
  FROM oracle_index_columns ic LEFT JOIN oracle_indexes x ON x.server_id = ic.server_id AND x.owner = ic.index_owner AND x.index_name = ic.index_name) i ON i.server_id = c.server_id AND i.index_owner = c.owner AND i.table_name = c.table_name AND i.column_name = c.column_name AND i.rn = 1
 WHERE c.owner = 'APP' AND NOT EXISTS (SELECT 1 FROM objects v WHERE v.server_id = c.server_id AND v.name = c.table_name AND v.object_type IN ('VIEW', 'MATERIALIZED VIEW'))""",
)
_OID = f"({_TABLE_ID} * 4 + length(c.table_name) % 4)"
VIEWS["pg_classes"] = f"""
SELECT DISTINCT c.server_id, {_OID} AS oid, c.table_name AS relname, CASE WHEN o.object_type = 'TABLE' THEN 'r' WHEN o.object_type = 'VIEW' THEN 'v' ELSE 'm' END AS relkind, CASE WHEN c.table_name LIKE '%9' THEN 'other' ELSE 'app' END AS nspname
 FROM fleet_columns c JOIN objects o ON o.server_id = c.server_id AND o.name = c.table_name WHERE c.server_id >= 3
UNION ALL SELECT DISTINCT server_id, indexrelid, index_name, 'i', 'app' FROM pg_index_rows"""
VIEWS["pg_index_rows"] = f"""
SELECT server_id, -(indrelid * 10 + rank() OVER (PARTITION BY server_id, indrelid ORDER BY index_name)) AS indexrelid, indrelid, index_name, keys FROM (
 SELECT c.server_id, {_OID} AS indrelid, i.index_name, min(i.index_position) AS low, max(i.index_position) AS high, concat('0 ', min(i.index_position), ' ', max(i.index_position)) AS keys
 FROM fleet_columns c JOIN fleet_index_columns i ON i.server_id = c.server_id AND i.column_name = c.column_name AND i.table_id = {_TABLE_ID} WHERE c.server_id >= 3 GROUP BY c.server_id, {_OID}, i.index_name) k"""
VIEWS["pg_attributes"] = f"""
SELECT c.server_id, {_OID} AS attrelid, c.column_id AS attnum, c.column_name AS attname, c.column_id = 6 AS attisdropped, concat(lower(c.data_type), CASE WHEN c.data_length IS NULL THEN '' ELSE concat('(', c.data_length, ')') END) AS type_text, c.data_default, c.comments FROM fleet_columns c WHERE c.server_id >= 3
UNION ALL SELECT DISTINCT c.server_id, {_OID}, -1, 'ctid', false, 'tid', NULL, NULL FROM fleet_columns c WHERE c.server_id >= 3"""
VIEWS["pg_defaults"] = "SELECT server_id, attrelid AS adrelid, attnum AS adnum, concat(' ', CASE WHEN attnum = 1 THEN ' ' ELSE data_default END, chr(9)) AS default_text FROM pg_attributes WHERE data_default IS NOT NULL"
VIEWS["pg_descriptions"] = "SELECT server_id, attrelid AS objoid, attnum AS objsubid, CASE WHEN attnum = 2 THEN ' ' ELSE comments END AS description FROM pg_attributes WHERE comments IS NOT NULL"
VIEWS["pg_schemas"] = "SELECT server_id, schema_name AS nspname FROM fleet_servers WHERE server_id IN (3, 4)"
bound(
    "sc2",
    lambda a, c, d, n, i, s: scan.scan_postgres(a, c, d, n, i.select("server_id", "indexrelid", "indrelid", F.split("keys", " ").cast("array<int>").alias("indkey")), s),
    "pg_attributes pg_classes pg_defaults pg_descriptions pg_index_rows pg_schemas",
    """SELECT a.server_id, c.relname AS table_name, a.attname AS column_name, a.type_text AS data_type, CAST(NULL AS VARCHAR) AS data_length, CASE WHEN a.attnum <> 1 THEN a.data_default END AS data_default, CASE WHEN a.attnum <> 2 THEN a.comments END AS comments,
 (SELECT min(x.index_name) FROM pg_index_rows x WHERE x.server_id = a.server_id AND x.indrelid = a.attrelid AND list_contains(string_split(x.keys, ' '), CAST(a.attnum AS VARCHAR))) AS index_name, CAST(NULL AS INT) AS index_position
 FROM pg_attributes a JOIN pg_classes c ON c.server_id = a.server_id AND c.oid = a.attrelid WHERE c.relkind = 'r' AND c.nspname = 'app' AND a.attnum > 0 AND NOT a.attisdropped""",
)
bound("sc6", lambda c: scan.columns_of(c, 0, "T1"), "fleet_columns", "SELECT column_name, column_id FROM fleet_columns WHERE server_id = 0 AND table_name = 'T1'")
sql("sc10", "SELECT server_id, table_name, ddl FROM table_ddls WHERE table_name IN (SELECT table_name FROM discrepancies WHERE element = 'TABLE')", held="fleet_columns")
bound(
    "sc13",
    lambda log: fanout.error_digest(log.where("outcome_raw = 'error'").select("connection_name", F.concat("tool", F.lit(" "), F.col("duration_ms") % 4).alias("why")), "connection_name", "why", 3),
    "audit_log",
    "SELECT array_to_string((list(DISTINCT said ORDER BY said))[1:3], ' | ') AS digest, count(*) AS n FROM (SELECT concat(connection_name, ': ', tool, ' ', duration_ms % 4) AS said FROM audit_log WHERE outcome_raw = 'error') e",
)


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts, a fifth on each of five servers, and four servers that can't be read: none there, no Parquet, other columns, broken after good files."""
    out = scratch(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.withColumn("server", F.col("p_partkey") % 5).write.partitionBy("server").parquet(f"{out}/parts")
    part.select(F.concat("p_name", F.lit("\n")).alias("text")).write.text(f"{out}/corrupt")
    part.select("p_partkey").write.parquet(f"{out}/other")
    sources = [fanout.Source(k, n, (f"{out}/parts/server={k}",)) for k, n in enumerate(("alpha", "Bravo", "charlie", "delta", "Echo"))]
    sources += [fanout.Source(5, "Foxtrot", (f"{out}/none",)), fanout.Source(6, "Golf", (f"{out}/corrupt",)), fanout.Source(7, "Hotel", (f"{out}/other",)), fanout.Source(8, "India", (f"{out}/parts/server=0", f"{out}/corrupt"))]
    return fanout.fan_out(spark, sources, "p_partkey long, p_name string, p_size int")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, or the error, of each server."""
    rows, errors = _fleet(spark, sf_dir)
    told = rows.groupBy("server_name").agg(F.count("*").alias("n")).withColumn("error", F.lit(None).cast("string"))
    return told.unionByName(errors.select("server_name", F.lit(0).cast("long").alias("n"), "error"))


QUERIES["sc11"] = lambda spark, sf_dir: _fleet(spark, sf_dir)[0]
QUERIES["sc12"] = _outcomes
_NAMES_OF = "list_extract(['alpha', 'Bravo', 'charlie', 'delta', 'Echo'], CAST(p_partkey % 5 + 1 AS INT))"
ORACLE_SQL["sc11"] = f"SELECT CAST(p_partkey % 5 AS INT) AS server_id, {_NAMES_OF} AS server_name, p_partkey, p_name, p_size FROM part"
ORACLE_SQL["sc12"] = f"SELECT {_NAMES_OF} AS server_name, count(*) AS n, NULL AS error FROM part GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('Foxtrot', 0, 'FileNotFoundError'), ('Golf', 0, 'ArrowInvalid'), ('Hotel', 0, 'ArrowInvalid'), ('India', 0, 'ArrowInvalid')) e"
ORACLE_SQL["sk1"] = f"SELECT {_NAMES_OF} AS \"Server\", p_partkey, p_name, p_size FROM part"
ORACLE_SQL["sk2"] = f"SELECT CAST(p_partkey % 5 AS INT) AS server_id, {_NAMES_OF} AS server_name, p_partkey, p_name, p_size, {_NAMES_OF} AS sheet_name FROM part"
ORACLE_SQL["sk3"] = f"SELECT {_NAMES_OF} AS \"Server\", p_partkey, p_name, TRY_CAST(p_name AS DOUBLE) AS p_name_number, p_size FROM part"
fixtures.BUILDERS["fleet_result"] = QUERIES["sc11"]
for _id, _write in (("sk1", sinks.write_csv), ("sk2", sinks.write_per_server), ("sk3", sinks.write_combined)):
    QUERIES[_id] = lambda spark, sf_dir, w=_write: w(_fleet(spark, sf_dir)[0], scratch(spark))
ORACLE_SQL["sk5"] = """
SELECT 0 AS seq, '{"columns":["c_custkey","c_name","c_nationkey","c_acctbal","c_mktsegment"]}' AS line
UNION ALL SELECT seq, line FROM (SELECT seq, line, sum(octet_length(encode(line)) + 1) OVER (ORDER BY seq) AS bytes FROM (
 SELECT row_number() OVER (ORDER BY c_custkey) AS seq, concat('["', c_custkey, '","', c_name, '","', c_nationkey, '","', c_acctbal, '","', c_mktsegment, '"]') AS line FROM customer) l) b WHERE bytes <= 20000"""
QUERIES["sk5"] = lambda spark, sf_dir: sinks.json_lines(view(spark, sf_dir, "customer"), "c_custkey", 20_000)
sql("lb2", "SELECT data_type, CASE WHEN upper(data_type) IN ('CLOB', 'NCLOB', 'LONG') THEN 'text_lob' WHEN upper(data_type) IN ('BLOB', 'BFILE', 'LONG RAW') THEN 'binary_lob' WHEN upper(data_type) = 'RAW' THEN 'raw' ELSE 'text' END AS kind, count(*) AS n FROM fleet_columns GROUP BY data_type")
sql("lb4", "SELECT c_custkey, decode(unhex(substr(concat('\\x', hex(encode(c_name))), 3))) AS back FROM customer", "SELECT c_custkey, decode(unhex(substr(concat('_x', hex(c_name)), 3)), 'UTF-8') AS back FROM customer")

# ---------------------------------------------------------------- windows, order, paging

bound("wn4", lambda i: summary.last_per_key(i, ["server_id", "table_id", "column_name"], "index_name"), "fleet_index_columns", "SELECT server_id, table_id, column_name, index_name FROM (SELECT *, row_number() OVER (PARTITION BY server_id, table_id, column_name ORDER BY index_name DESC) AS rn FROM fleet_index_columns) i WHERE rn = 1")
sql("wn9", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS nt, lag(o_orderkey) OVER w AS lg, lead(o_orderkey) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER w AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("sf3", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 4) AS running, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS near, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
sql("sl1", "SELECT o_orderkey, max(rn) OVER () > 100 AS truncated FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 101) p) q")
bound("sl2", lambda log: summary.page(log, [F.desc("id")], 500, 200).select("id", "tool"), "audit_log", "SELECT id, tool FROM audit_log ORDER BY id DESC LIMIT 500 OFFSET 200")
VIEWS["spelt_parts"] = "SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(replace(p_name, 'a', 'á'), 'e', 'Ê') WHEN 2 THEN concat(p_name, ' ', repeat('0', CAST(p_partkey % 3 AS INT)), '1234567890123456789012', p_partkey) ELSE concat(p_name, ' ', p_size) END AS name FROM part"
_NATURAL = "array_to_string(list_transform(regexp_extract_all(strip_accents(lower(name)), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN concat(lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0'), ltrim(x, '0')) ELSE x END), '')"
bound(
    "sl3",
    lambda p: p.withColumn("at", F.row_number().over(Window.partitionBy("p_brand").orderBy(summary.natural_key("name"), "p_partkey"))).select("p_partkey", "at"),
    "spelt_parts",
    f"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {_NATURAL}, p_partkey) AS at FROM spelt_parts",
)
bound("sl4", lambda q: summary.page(q, summary.log_order(), 300).select("id", "favorite", "sort_order", "pinned"), "query_log", "SELECT id, favorite, sort_order, pinned FROM query_log ORDER BY favorite DESC, sort_order, pinned DESC, id DESC LIMIT 300")
sql("sl5", "SELECT id FROM query_log WHERE pinned OR favorite")
bound("sl6", lambda n: summary.page(n, [F.asc("id")], 20).select("id", "table_name", "element"), "numbered", "SELECT id, table_name, element FROM numbered ORDER BY id LIMIT 20")

# ---------------------------------------------------------------- audit

_OUTCOME = "CASE WHEN outcome_raw IN ('allowed', 'denied') THEN outcome_raw ELSE 'error' END"


def _json_sql(c: str) -> str:
    """A JSON string in DuckDB, with a replacement for each character that the fixtures have."""
    text = f"replace({c}, chr(92), concat(chr(92), chr(92)))"
    for code, short in ((34, "chr(34)"), (9, "'t'"), (10, "'n'"), (1, "'u0001'"), (31, "'u001f'")):
        text = f"replace({text}, chr({code}), concat(chr(92), {short}))"
    return f"concat(chr(34), {text}, chr(34))"


def _body_sql() -> str:
    number = lambda c: f"CAST({c} AS VARCHAR)"
    text = lambda c, of=None: f"CASE WHEN {c} IS NOT NULL THEN {_json_sql(of or c)} END"
    fields = [number("id"), "concat(chr(34), strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ'), chr(34))", text("tool"), number("connection_id"), text("connection_name"), text("arguments"), _json_sql(_OUTCOME), text("reason"), number("row_count"), number("bytes"), number("duration_ms"), text("client_name")]
    return "concat('[', concat_ws(',', " + ", ".join(f"coalesce({f}, 'null')" for f in fields) + "), ']')"


VIEWS["audit_bodies"] = f"SELECT *, CAST(event_ts AS DATE) AS day, {_body_sql()} AS body FROM audit_entries"
fixtures.BUILDERS["audit_chain"] = lambda spark, sf_dir: written(audit.with_chain(view(spark, sf_dir, "audit_entries")), "chain")
VIEWS["audit_chain"] = "SELECT *, row_number() OVER (PARTITION BY connection_id, day ORDER BY id, body) AS seq FROM audit_bodies"
bound("au1", lambda log: log.select("id", F.sha2(F.concat(F.lit(audit.GENESIS), F.lit("\n"), audit.canonical(log)), 256).alias("hash")), "audit_entries", "SELECT id, sha256(concat(repeat('0', 64), chr(10), body)) AS hash FROM audit_bodies")
bound("au2", lambda chain: chain.groupBy("connection_id", "day").agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("last_hash")), "audit_chain", "SELECT connection_id, day, count(*) AS n, list_reduce(list_prepend(repeat('0', 64), list(body ORDER BY id, body)), lambda a, x: sha256(concat(a, chr(10), x))) AS last_hash FROM audit_bodies GROUP BY connection_id, day")


def _tampered(chain: DataFrame) -> DataFrame:
    """Verified after an entry of connection 1 was edited, one of 2 and the last of 3 were deleted."""
    issued = chain.groupBy("connection_id", "day").agg(F.max("seq").cast("long").alias("issued"))
    edited = chain.withColumn("reason", F.when((F.col("connection_id") == 1) & (F.col("seq") == 3), "edited").otherwise(F.col("reason")))
    edited = edited.where(~F.col("connection_id").eqNullSafe(2) | (F.col("seq") != 4))
    last = issued.where("connection_id = 3").select("connection_id", "day", F.col("issued").alias("seq"))
    return audit.verify_chain(edited.join(last, ["connection_id", "day", "seq"], "left_anti"), issued)


_FOUND = "SELECT connection_id, day, problem IS NULL AS ok, CASE problem WHEN 'modified' THEN 2 WHEN 'missing' THEN 4 WHEN 'truncated' THEN n - 1 ELSE n END AS entries, CASE problem WHEN 'modified' THEN 3 WHEN 'missing' THEN 5 WHEN 'truncated' THEN n END AS first_bad, problem FROM (SELECT connection_id, day, count(*) AS n, CASE WHEN connection_id = 1 AND count(*) >= 3 THEN 'modified' WHEN connection_id = 2 AND count(*) >= 5 THEN 'missing' WHEN connection_id = 2 AND count(*) = 4 THEN 'truncated' WHEN connection_id = 3 THEN 'truncated' END AS problem FROM audit_chain GROUP BY connection_id, day) c"
bound("au3", _tampered, "audit_chain", _FOUND)
bound("wn1", lambda chain: chain.select("connection_id", "day", "seq", "id", (F.col("prev_hash") == audit.GENESIS).alias("first")), "audit_chain", "SELECT connection_id, day, seq, id, seq = 1 AS first FROM audit_chain")
bound("au4", lambda log: summary.page(audit.filter_audit(log, connection=1), [F.desc("id")], 100, 10).select("id", "tool", "outcome_raw"), "audit_log", "SELECT id, tool, outcome_raw FROM audit_log WHERE connection_id = 1 ORDER BY id DESC LIMIT 100 OFFSET 10")
bound("au5", audit.usage_digest, "audit_log", "SELECT tool, connection_id, count(*) AS calls, count(*) FILTER (WHERE outcome_raw = 'denied') AS denials, count(*) FILTER (WHERE outcome_raw NOT IN ('allowed', 'denied')) AS errors, sum(row_count) AS n_rows, sum(bytes) AS n_bytes, sum(duration_ms) AS duration_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, max(duration_ms) AS longest_ms FROM audit_log GROUP BY tool, connection_id")
bound("au6", lambda log: log.groupBy("outcome_raw", audit.outcome("outcome_raw").alias("outcome")).agg(F.count("*").alias("n")), "audit_log", "SELECT outcome_raw, CASE WHEN outcome_raw IN ('allowed', 'denied') THEN outcome_raw ELSE 'error' END AS outcome, count(*) AS n FROM audit_log GROUP BY outcome_raw")
_NAMES = "json_extract_string(arguments, '$.target.names[*]')"
bound("tx10", lambda log: log.select("id", audit.target_summary(shown=1).alias("target")), "audit_log", f"SELECT id, concat(json_extract_string(arguments, '$.target.object_type'), ' ', {_NAMES}[1], ' (+', len({_NAMES}) - 1, ' more)') AS target FROM audit_log")
bound("tx25", audit_stream.audit_lines, "audit_log", f"SELECT concat('{{\"id\":', id, ',\"tool\":\"', tool, '\",\"connection_id\":', connection_id, ',\"outcome\":\"', {_OUTCOME}, '\",\"severity\":', CASE WHEN outcome_raw = 'allowed' THEN 6 ELSE 4 END, ',\"target\":\"TABLE\"}}') AS value FROM audit_log")
_QUOTED = lambda c: f"concat(chr(34), replace({c}, chr(34), concat(chr(34), chr(34))), chr(34))"
bound("sk7", audit.audit_csv_rows, "audit_log", f"SELECT id, concat_ws(',', id, strftime(event_ts, '%Y-%m-%d %H:%M:%S'), tool, connection_id, connection_name, {_OUTCOME}, CASE WHEN reason = '' THEN '' ELSE concat(chr(34), chr(39), replace(reason, chr(34), concat(chr(34), chr(34))), chr(34)) END, row_count, bytes, duration_ms, concat(chr(34), 'TABLE ', {_NAMES}[1], ', ', {_NAMES}[2], chr(34)), {_QUOTED('arguments')}) AS line FROM audit_log")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    audit_stream.forward(audit_stream.as_log(audit_stream.event_stream(spark, f"{sf_dir}/events.parquet*")), f"{out}/rows", f"{out}/state")
    return audit_stream.delivered(spark, f"{out}/rows").select("value")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit entries in four parts of rising ids: each is landed by many tasks, then taken by the stream, which goes on from its checkpoint, as one batch."""
    out, entries = scratch(spark), view(spark, sf_dir, "audit_entries")
    most = entries.agg(F.max("id")).first()[0] or 0
    for part in range(4):
        low, high = most * part // 4, most * (part + 1) // 4
        entries.where((F.col("id") > low) & (F.col("id") <= high)).write.mode("append").parquet(f"{out}/log")
        links = audit_stream.chain_stream(spark.readStream.schema(entries.schema).option("pathGlobFilter", "*.parquet").parquet(f"{out}/log"))
        links.writeStream.format("parquet").option("path", f"{out}/links").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(links.schema).parquet(f"{out}/links").select("connection_id", "day", "id", "seq", "hash", "refused")




def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    stream = audit_stream.screen(audit_stream.as_requests(audit_stream.event_stream(spark, f"{sf_dir}/events.parquet*")), view(spark, sf_dir, "connection_policies"), view(spark, sf_dir, "connection_rules"))
    rows = stream.select("id", "connection_id", "tool", "allowed", "reason_code")
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


QUERIES["sr1"], QUERIES["sr2"] = _streamed, _screened
ORACLE_SQL["sr1"] = ORACLE_SQL["tx25"]
QUERIES["au2_stream"] = _chained
ORACLE_SQL["au2_stream"] = fixtures.oracle("""
SELECT connection_id, day, id, seq, list_reduce(list_prepend(repeat('0', 64), bodies[1:seq]), lambda a, x: sha256(concat(a, chr(10), x))) AS hash, CAST(NULL AS VARCHAR) AS refused
FROM (SELECT *, list(body) OVER (PARTITION BY connection_id, day ORDER BY id, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bodies FROM audit_chain) c""")
_TOOL_LIST = ", ".join(f"'{t}'" for t, _, _ in rules.TOOLS)
ORACLE_SQL["sr2"] = fixtures.oracle(f"SELECT e.id, e.connection_id, e.tool, coalesce(m.allowed, false) AS allowed, CASE WHEN m.tool IS NULL THEN 'no_policy' ELSE m.reason_code END AS reason_code FROM (SELECT event_id + 1 AS id, CAST(user_id % 100 AS INT) AS connection_id, list_extract([{_TOOL_LIST}], CAST(event_id % {len(rules.TOOLS)} + 1 AS INT)) AS tool FROM events) e LEFT JOIN ({ORACLE_TEXT['fl9']}) m ON m.connection_id = e.connection_id AND m.tool = e.tool")

# ---------------------------------------------------------------- texts

_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\n+|\\n+$', '', 'g'), '\\s*;$', ''), '\\s+$', '')"
VIEWS["text_lines"] = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
fixtures.BUILDERS["text_lines"] = lambda spark, sf_dir: text.text_lines(view(spark, sf_dir, "documents"))
VIEWS["messy"] = "SELECT doc_id, text, concat(replace(text, chr(10), concat(' ', chr(13), chr(10))), ';') AS file_text FROM documents"
bound("tx1", lambda m: m.select("doc_id", F.sha2(text.normalize("file_text"), 256).alias("sha"), (text.normalize("file_text") == text.normalize("text")).alias("same")), "messy", f"SELECT doc_id, sha256({_NORM.format('file_text')}) AS sha, {_NORM.format('file_text')} = {_NORM.format('text')} AS same FROM messy")
sql("tx3", "SELECT server_id, table_name, column_name, nullif(nullif(trim(replace(replace(comments, chr(10), ''), chr(13), '')), ''), 'null') AS cleaned FROM fleet_columns")
sql("tx4", "SELECT DISTINCT concat(chr(39), replace(reason, chr(39), concat(chr(39), chr(39))), chr(39)) AS literal, concat(chr(34), replace(reason, chr(34), concat(chr(34), chr(34))), chr(34)) AS identifier, upper(trim(tool)) AS tool_key FROM audit_log")
sql("tx6", "SELECT DISTINCT c.server_id, c.table_name, CASE WHEN s.engine = 'oracle' THEN upper(lower(c.table_name)) ELSE lower(c.table_name) END AS folded FROM fleet_columns c JOIN fleet_servers s ON s.server_id = c.server_id")
_KIND = "CASE WHEN word IN ('select', 'with') THEN 'select' WHEN word IN ('insert', 'update', 'delete', 'merge') THEN 'dml' WHEN word IN ('create', 'alter', 'drop', 'truncate') THEN 'ddl' ELSE 'other' END"
sql("tx7", f"SELECT id, {_KIND} AS kind FROM (SELECT id, lower(regexp_extract(regexp_replace(sql_text, '--[^\\n]*|/\\*.*?\\*/', '', 'g'), '^\\s*([A-Za-z]+)', 1)) AS word FROM query_log) q", f"SELECT id, {_KIND} AS kind FROM (SELECT id, lower(regexp_extract(regexp_replace(sql_text, '--[^\\\\n]*|/\\\\*.*?\\\\*/', ''), '^\\\\s*([A-Za-z]+)', 1)) AS word FROM query_log) q")
sql("tx9", "SELECT doc_id, sha256(text) AS sha FROM documents", "SELECT doc_id, sha2(text, 256) AS sha FROM documents")
bound("tx16", lambda t: t.where(text.matches(r"(token|secret)\s*=", regex=True)), "text_lines", "SELECT doc_id, line_no, line FROM text_lines WHERE regexp_matches(line, '(?i)(token|secret)\\s*=')")
_HITS = "SELECT doc_id, line_no, line, contains(lower(line), 'a') AS hit, sum(CAST(contains(lower(line), 'a') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS hits FROM text_lines"
bound("tx16_counts", lambda t: text.grep_counts(t, "A", 3), "text_lines", f"SELECT doc_id, CAST(max(hits) AS BIGINT) AS match_count, CAST(least(max(hits), 3) AS BIGINT) AS returned, max(hits) > 3 AS truncated FROM ({_HITS}) h GROUP BY doc_id HAVING max(hits) > 0")
bound("tx16_first", lambda t: text.grep_first(t, "A", 3, 2).drop("grp"), "text_lines", f"SELECT doc_id, line_no, hit, line FROM ({_HITS}) h WHERE hits <= 3 AND EXISTS (SELECT 1 FROM ({_HITS}) o WHERE o.doc_id = h.doc_id AND o.hit AND o.hits <= 3 AND o.line_no BETWEEN h.line_no - 2 AND h.line_no + 2)")
sql("tx17", "SELECT doc_id, line_no, line, n > 6 AS more FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM text_lines) t WHERE line_no BETWEEN 3 AND 6")
sql("tx19", "SELECT doc_id, sha256(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), concat(chr(13), chr(10)))) AS sha FROM documents", "SELECT doc_id, sha2(replace(regexp_replace(text, '\\\\r\\\\n?', chr(10)), chr(10), concat(chr(13), chr(10))), 256) AS sha FROM documents")
bound("tx20", text.diff_counts, "ddl_pairs", "SELECT doc_id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM (SELECT doc_id, line, sum(n) AS n FROM (SELECT doc_id, unnest(string_split(file_text, chr(10))) AS line, 1 AS n FROM ddl_pairs UNION ALL SELECT doc_id, unnest(string_split(server_text, chr(10))), -1 FROM ddl_pairs) l GROUP BY doc_id, line) m GROUP BY doc_id")
bound("tx21", text.unified, "ddl_pairs")
bound("ud1", text.diff_operations, "ddl_pairs")
bound("tx20_exact", text.exact_counts, "ddl_pairs")
bound("tx21_summary", text.diff_summaries, "ddl_pairs")
_SIDE = lambda op: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != op, F.struct("seq", "line")))), lambda x: x["line"]), "\n"), 256)
bound("ud1_rebuilt", lambda p: text.diff_operations(p).groupBy("doc_id").agg(_SIDE("+").alias("old"), _SIDE("-").alias("new"), (F.count_if(F.col("op") == "+") - F.count_if(F.col("op") == "-")).alias("longer")), "ddl_pairs", f"SELECT doc_id, sha256(a) AS old, sha256(b) AS new, CAST(len(string_split(b, chr(10))) - len(string_split(a, chr(10))) AS BIGINT) AS longer FROM (SELECT doc_id, {_NORM.format('server_text')} AS a, {_NORM.format('file_text')} AS b FROM ddl_pairs) n WHERE a <> b")
VIEWS["changed_lines"] = "SELECT doc_id, line_no AS seq, CASE WHEN contains(lower(line), 'token') THEN '-' ELSE ' ' END AS op, line FROM text_lines"
_SHOWN = "SELECT * FROM (SELECT *, bool_or(op <> ' ') OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM changed_lines) n WHERE near"
bound("wn8", text.hunks, "changed_lines", f"SELECT doc_id, sum(gap) OVER (PARTITION BY doc_id ORDER BY seq) AS hunk, seq, op, line FROM (SELECT *, CASE WHEN seq - coalesce(lag(seq) OVER (PARTITION BY doc_id ORDER BY seq), -1) > 1 THEN 1 ELSE 0 END AS gap FROM ({_SHOWN}) s) g")
bound("tx23", lambda log: log.select("id", audit.csv_field(F.col("reason")).alias("field")), "audit_log", "SELECT id, CASE WHEN reason = '' THEN '' ELSE concat(chr(34), chr(39), replace(reason, chr(34), concat(chr(34), chr(34))), chr(34)) END AS field FROM audit_log")
sql("tx24", "SELECT doc_id, concat_ws(chr(9), doc_id, lang, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g')) AS row_text FROM documents", "SELECT doc_id, concat_ws(chr(9), doc_id, lang, regexp_replace(text, '[\\\\t\\\\r\\\\n]+', ' ')) AS row_text FROM documents")
_HITS = "SELECT *, contains(lower(line), 'token') AS hit FROM text_lines"
_GREP = f"SELECT doc_id, line_no, hit, line, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM (SELECT *, CASE WHEN line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -1) > 1 THEN 1 ELSE 0 END AS gap FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM ({_HITS}) h) n WHERE near) g"
bound("wn7", lambda t: text.grep_context(t, "token", 1), "text_lines", _GREP)

# ---------------------------------------------------------------- structured queries and SQL screening

_SPEC = {"columns": ["o_orderkey", "o_custkey", "o_orderstatus"], "filters": [("o_orderstatus", "in", ["O", "P"]), ("o_totalprice", "ge", 1000), ("o_orderpriority", "like", "%HIGH%"), ("o_custkey", "is_not_null", None)], "order_by": [("o_orderkey", "asc")], "limit": 200}
bound("fl12", lambda o: sinks.table_query(o, **_SPEC), "orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND o_orderpriority LIKE '%HIGH%' AND o_custkey IS NOT NULL ORDER BY o_orderkey LIMIT 201")

# ---------------------------------------------------------------- SQL functions

sql("sf1", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS pc FROM lineitem GROUP BY l_returnflag")
sql("sf2", "SELECT n_regionkey, n_nationkey, count(*) AS n, CAST(grouping(n_regionkey) * 2 + grouping(n_nationkey) AS INT) AS gid FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
sql("sf4", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CAST(c_nationkey AS VARCHAR(10)) AS t FROM customer")
sql("sf6", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, trim(concat(' ', n_name, ' ')) AS t, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rp, substr(n_name, 2, 3) AS s, length(n_name) AS n, replace(n_name, 'A', 'x') AS r, translate(n_name, 'AE', 'ae') AS tr, ascii(n_name) AS a, chr(65) AS c, position('A' IN n_name) AS p FROM nation")
sql("sf7", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice, 1) AS r, p_size % 7 AS m, round(sqrt(p_size), 6) AS sq, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size + 1), 6) AS l, round(log10(p_size + 1), 6) AS lg, sign(p_size - 25) AS sg, round(sin(p_size), 6) AS si, round(atan2(p_size, 2), 6) AS at2, CAST(floor(p_size / 10.0) AS INT) + 1 AS bucket FROM part")
sql("sf8", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, current_date IS NOT NULL AS has_now FROM orders")
sql("sf9", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12, 2)) AS d, CAST(p_size AS FLOAT) AS f, CAST(p_name AS VARCHAR(100)) AS v, CAST('2024-01-02' AS DATE) AS dt FROM part")
sql("sf10", "SELECT c_nationkey, median(c_acctbal) AS med, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segs, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 9) AS share FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, median(c_acctbal) AS med, listagg(c_mktsegment, ',') WITHIN GROUP (ORDER BY c_mktsegment) AS segs, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 9) AS share FROM customer GROUP BY c_nationkey")
sql("sf11", "SELECT id, CASE WHEN reason = '' THEN 'none' ELSE reason END AS nvl, CASE tool WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE 'x' END AS dec FROM audit_log", "SELECT id, nvl(nullif(reason, ''), 'none') AS nvl, decode(tool, 'view', 'v', 'click', 'c', 'x') AS dec FROM audit_log")
sql("sf12", "SELECT n_nationkey, instr(n_name, 'A') AS i, octet_length(encode(n_name)) AS b, regexp_extract(n_name, '[AEIOU]+') AS sub, len(regexp_extract_all(n_name, '[AEIOU]')) AS cnt, regexp_matches(n_name, '^[A-M]') AS lk FROM nation", "SELECT n_nationkey, instr(n_name, 'A') AS i, octet_length(n_name) AS b, regexp_extract(n_name, '[AEIOU]+', 0) AS sub, regexp_count(n_name, '[AEIOU]') AS cnt, n_name RLIKE '^[A-M]' AS lk FROM nation")
sql("sf14", "SELECT n_nationkey, hex(encode(n_name)) AS h, decode(unhex(hex(encode(n_name)))) AS back, CAST(n_nationkey AS DOUBLE) AS d FROM nation", "SELECT n_nationkey, hex(n_name) AS h, decode(unhex(hex(n_name)), 'UTF-8') AS back, CAST(n_nationkey AS DOUBLE) AS d FROM nation")
sql("sf16", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS ba, bool_or(c_acctbal > 9000) AS bo, bit_and(c_custkey) AS bi, bit_or(c_custkey) AS br, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey")
sql("sf17", "SELECT n_nationkey, left(n_name, 2) AS l, right(n_name, 2) AS r, split_part(n_name, 'A', 1) AS sp, reverse(n_name) AS rv, md5(n_name) AS m, concat_ws('-', n_name, n_nationkey) AS cw, strpos(n_name, 'A') AS st, starts_with(n_name, 'A') AS sw FROM nation", "SELECT n_nationkey, left(n_name, 2) AS l, right(n_name, 2) AS r, split_part(n_name, 'A', 1) AS sp, reverse(n_name) AS rv, md5(n_name) AS m, concat_ws('-', n_name, n_nationkey) AS cw, locate('A', n_name) AS st, startswith(n_name, 'A') AS sw FROM nation")
sql("sf18", "SELECT p_partkey, ceiling(p_retailprice) AS c, round(cbrt(p_size), 6) AS cb, round(degrees(p_size), 5) AS dg, round(radians(p_size), 9) AS rd, round(pi(), 9) AS pi, p_size // 3 AS dv FROM part", "SELECT p_partkey, ceiling(p_retailprice) AS c, round(cbrt(p_size), 6) AS cb, round(degrees(p_size), 5) AS dg, round(radians(p_size), 9) AS rd, round(pi(), 9) AS pi, p_size div 3 AS dv FROM part")
sql("sf20", "SELECT n_nationkey, len(string_split(n_name, 'A')) AS n, array_to_string(string_split(n_name, 'A'), '|') AS j, coalesce(list_position(string_split(n_name, 'A'), 'N'), 0) AS p, len(list_append(string_split(n_name, 'A'), 'x')) AS ap FROM nation", "SELECT n_nationkey, size(split(n_name, 'A')) AS n, array_join(split(n_name, 'A'), '|') AS j, array_position(split(n_name, 'A'), 'N') AS p, size(array_append(split(n_name, 'A'), 'x')) AS ap FROM nation")
sql("sf22", "WITH big(k, n) AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 1000) FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN n BETWEEN 1 AND 5 THEN 'few' WHEN n > 5 THEN 'many' ELSE 'none' END AS size, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer LEFT JOIN big ON k = c_custkey ORDER BY c_custkey LIMIT 500 OFFSET 10")


#: Headers with what they become: spelling, own and other schemas, quotes, words that differ in meaning, kinds of every sort, no header.
_HEADERS = (
    ("concat('create or replace  editionable Procedure \"app\".\"', name, '\"  is begin null; end;')", "concat('CREATE PROCEDURE ', name, ' IS begin null; end;')"),
    ("concat('  CREATE package   body App.', lower(name), chr(10), 'as x')", "concat('CREATE PACKAGE BODY ', name, chr(10), 'as x')"),
    ("concat('create noneditionable type body \"Other\".', name, ' as y')", "concat('CREATE NONEDITIONABLE TYPE BODY \"Other\".', name, ' AS y')"),
    ("concat('create or replace force view app.\"my', name, '\"(a) as select 1')", "concat('CREATE FORCE VIEW \"my', name, '\" (a) as select 1')"),
    ("concat('Create Global Temporary Table ', name, '(a int)')", "concat('CREATE GLOBAL TEMPORARY TABLE ', name, ' (a int)')"),
    ("concat('create unique index app . ', name, ' on t(a)')", "concat('CREATE UNIQUE INDEX APP . ', name, ' on t(a)')"),
    ("concat('create or replace public synonym ', name, ' for x.y;')", "concat('CREATE PUBLIC SYNONYM ', name, ' for x.y;')"),
    ("concat('CREATE SEQUENCE ', name)", "concat('CREATE SEQUENCE ', name)"),
    ("concat('create or view ', name)", "concat('create or view ', name)"),
    ("concat('create view ', name, '. as select 1')", "concat('create view ', name, '. as select 1')"),
    ("concat('select create view ', name)", "concat('select create view ', name)"),
)
_WHICH = f"(ascii(substr(name, length(name), 1)) + server_id) % {len(_HEADERS)}"
VIEWS["headers"] = f"SELECT server_id, name, CASE {_WHICH} " + " ".join(f"WHEN {i} THEN {raw}" for i, (raw, _) in enumerate(_HEADERS)) + " END AS ddl FROM objects"
bound("tx2", lambda h: h.withColumn("canonical", heads.canonical_header("ddl", "app")), "headers", f"SELECT *, CASE {_WHICH} " + " ".join(f"WHEN {i} THEN {made}" for i, (_, made) in enumerate(_HEADERS)) + " END AS canonical FROM headers")
