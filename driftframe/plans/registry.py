"""Queries by id, with their SQL equivalents.

A query is an operator bound to views of the test tables, or one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import audit, drift, rules, shared, sinks, summary
from driftframe.sources import fixtures
from driftframe.sources.fixtures import VIEWS, oracle, query, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The equivalents without the views they use.
ORACLE_TEXT: dict[str, str] = {}


def sql(name: str, text: str, spark_text: str | None = None, held: str = "") -> None:
    """One SQL text for both engines, or one for each where names of functions differ. Views in ``held`` are read several times, so they are derived once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with fixtures.once(spark, sf_dir, *held.split()):
            return query(spark, sf_dir, spark_text or text)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle(text)


def bound(name: str, make: Callable[..., DataFrame], views: str, text: str | None = None, held: str = "") -> None:
    """An operator over views; ``text`` is its equivalent for DuckDB. Views in ``held`` are read several times, so they are derived once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with fixtures.once(spark, sf_dir, *held.split()):
            return make(*(view(spark, sf_dir, v) for v in views.split()))

    QUERIES[name] = run
    if text:
        ORACLE_TEXT[name] = text
        ORACLE_SQL[name] = oracle(text)


# ---------------------------------------------------------------- drift

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def attribute_rows(a: str, table: str = "fleet_columns", key: str = "column_name") -> str:
    """Differences of one attribute in SQL, columns meeting by ``key``."""
    low = _LOW.format
    details = f"concat('{a.upper()}: ', coalesce(r.{a}, 'NULL'), ' != ', coalesce(c.{a}, 'NULL'))"
    real = ""
    if a == "data_length":
        details = "concat(coalesce(r.data_type, '?'), '(', coalesce(r.data_length, 'NULL'), ') != ', coalesce(c.data_type, '?'), '(', coalesce(c.data_length, 'NULL'), ')')"
    if a == "index_name":
        named = lambda s: f"({s}.index_name IS NOT NULL AND {s}.index_name <> '' AND lower({s}.index_name) <> 'none')"
        real = f" AND NOT ({named('r')} AND {named('c')})"
    return f"""SELECT c.server_id, 'DIFFERENT' AS difference, '{a.upper()}' AS element, c.table_name, c.{key} AS column_name, {details} AS details
 FROM {table} c JOIN {table} r ON r.server_id = 0 AND c.server_id <> 0 AND r.table_name = c.table_name AND r.{key} = c.{key}
 WHERE {low(f'r.{a}')} IS DISTINCT FROM {low(f'c.{a}')}{real}"""


_MISSING_TABLE = """SELECT s.server_id, 'MISSING' AS difference, 'TABLE' AS element, t.table_name, '' AS column_name, concat('Table found in reference server ALPHA but not in server ', upper(s.server_name)) AS details
 FROM (SELECT DISTINCT table_name FROM fleet_columns WHERE server_id = 0) t CROSS JOIN (SELECT * FROM fleet_servers WHERE server_id <> 0) s
 WHERE NOT EXISTS (SELECT 1 FROM fleet_columns c WHERE c.server_id = s.server_id AND c.table_name = t.table_name)
UNION ALL SELECT DISTINCT c.server_id, 'MISSING', 'TABLE', c.table_name, '', concat('Table ', c.table_name, ' found in server ', upper(s.server_name), ' but not in reference server ALPHA')
 FROM fleet_columns c JOIN fleet_servers s ON s.server_id = c.server_id WHERE c.server_id <> 0 AND NOT EXISTS (SELECT 1 FROM fleet_columns r WHERE r.server_id = 0 AND r.table_name = c.table_name)"""
_MISSING_COLUMN = """SELECT s.server_id, 'MISSING' AS difference, 'COLUMN' AS element, r.table_name, r.column_name, concat('Column found in reference server ALPHA but not in server ', upper(s.server_name)) AS details
 FROM fleet_columns r CROSS JOIN (SELECT * FROM fleet_servers WHERE server_id <> 0) s WHERE r.server_id = 0
 AND EXISTS (SELECT 1 FROM fleet_columns c WHERE c.server_id = s.server_id AND c.table_name = r.table_name)
 AND NOT EXISTS (SELECT 1 FROM fleet_columns c WHERE c.server_id = s.server_id AND c.table_name = r.table_name AND c.column_name = r.column_name)
UNION ALL SELECT c.server_id, 'MISSING', 'COLUMN', c.table_name, c.column_name, concat('Column ', c.column_name, ' found in server ', upper(s.server_name), ' but not in reference server ALPHA')
 FROM fleet_columns c JOIN fleet_servers s ON s.server_id = c.server_id WHERE c.server_id <> 0
 AND EXISTS (SELECT 1 FROM fleet_columns r WHERE r.server_id = 0 AND r.table_name = c.table_name)
 AND NOT EXISTS (SELECT 1 FROM fleet_columns r WHERE r.server_id = 0 AND r.table_name = c.table_name AND r.column_name = c.column_name)"""
VIEWS["discrepancies"] = "SELECT d.server_id, server_name, difference, element, table_name, column_name, details FROM (" + "\nUNION ALL ".join([_MISSING_TABLE, _MISSING_COLUMN, *map(attribute_rows, drift.ATTRIBUTES)]) + ") d JOIN fleet_servers s ON s.server_id = d.server_id"
fixtures.BUILDERS["discrepancies"] = lambda spark, sf_dir: drift.compare(view(spark, sf_dir, "fleet_columns"), view(spark, sf_dir, "fleet_servers"), 0)
_RANK = "CASE element WHEN 'TABLE' THEN 1 WHEN 'COLUMN' THEN 2 WHEN 'COLUMN_NAME' THEN 3 WHEN 'DATA_TYPE' THEN 4 WHEN 'DATA_LENGTH' THEN 5 WHEN 'DATA_DEFAULT' THEN 6 WHEN 'COMMENTS' THEN 7 ELSE 8 END"
VIEWS["numbered"] = f"SELECT *, row_number() OVER (ORDER BY table_name, server_id, {_RANK}, column_name) AS id FROM discrepancies"
fixtures.BUILDERS["numbered"] = lambda spark, sf_dir: drift.numbered(view(spark, sf_dir, "discrepancies"))

bound("jn1", lambda fc, s: drift.compare(fc, s, 0), "fleet_columns fleet_servers", "SELECT * FROM discrepancies")
bound("jn2", lambda fc, s: drift.missing_tables(fc, s, 0), "fleet_columns fleet_servers", "SELECT server_id, table_name, CASE WHEN details LIKE 'Table found%' THEN 'absent' ELSE 'extra' END AS side FROM discrepancies WHERE element = 'TABLE'")
bound("jn3", lambda fc: drift.missing_columns(fc, 0), "fleet_columns", "SELECT server_id, table_name, column_name, CASE WHEN details LIKE 'Column found%' THEN 'absent' ELSE 'extra' END AS side FROM discrepancies WHERE element = 'COLUMN'")
bound("jn11", lambda log, s: drift.labelled(log.select("id", F.col("connection_id").alias("server_id")), s.where("server_id < 3")), "audit_log fleet_servers", "SELECT l.id, l.connection_id AS server_id, coalesce(s.server_name, concat('#', l.connection_id)) AS server_name FROM audit_log l LEFT JOIN fleet_servers s ON s.server_id = l.connection_id AND s.server_id < 3")
bound("jn12", lambda fc, s: drift.expected_tables(fc.where("server_id = 0").select("table_name").distinct(), s.select("server_id")), "fleet_columns fleet_servers", "SELECT server_id, table_name FROM (SELECT DISTINCT table_name FROM fleet_columns WHERE server_id = 0) t CROSS JOIN (SELECT server_id FROM fleet_servers) s")
bound("wn6", drift.numbered, "discrepancies", "SELECT * FROM numbered")
bound("st1", summary.all_tables, "fleet_columns", "SELECT DISTINCT table_name FROM fleet_columns")
sql("st2", "SELECT server_id, name, object_type FROM objects WHERE object_type = 'TABLE' UNION SELECT server_id, name, 'VIEW' AS object_type FROM objects WHERE object_type = 'VIEW' UNION SELECT server_id, name, object_type FROM objects WHERE name LIKE 'T1%'")
sql("st3", "WITH RECURSIVE k(n) AS (SELECT 0 AS n UNION ALL SELECT n + 1 FROM k WHERE n < 10), a AS (SELECT c_nationkey AS n FROM customer), b AS (SELECT s_nationkey AS n FROM supplier WHERE s_suppkey % 3 = 0) SELECT 'intersect' AS op, n FROM (SELECT n FROM a INTERSECT SELECT n FROM b) x UNION ALL SELECT 'except' AS op, n FROM (SELECT n FROM a EXCEPT SELECT n FROM b) y UNION ALL SELECT 'union' AS op, n FROM (SELECT n FROM a UNION SELECT n FROM k) z")
bound("st4", lambda c: summary.table_spread(c, 5), "fleet_columns", "SELECT table_name, count(DISTINCT server_id) AS n_servers, CASE WHEN count(DISTINCT server_id) = 5 THEN 'common' WHEN count(DISTINCT server_id) = 1 THEN concat('only ', min(server_id)) ELSE 'some' END AS kind FROM fleet_columns GROUP BY table_name")

# ---------------------------------------------------------------- summaries

bound("ag1", summary.by_difference, "discrepancies", "SELECT difference, count(*) AS n FROM discrepancies GROUP BY difference")
bound("ag2", summary.top_tables, "discrepancies", "SELECT table_name, count(*) AS n FROM discrepancies GROUP BY table_name ORDER BY n DESC, table_name LIMIT 50")
bound("ag3", summary.table_count, "discrepancies", "SELECT count(DISTINCT table_name) AS n_tables FROM discrepancies")
bound("ag4", lambda d: summary.hidden_count(d, ["TMP_*"]), "discrepancies", "SELECT count(*) AS n_before, sum(CASE WHEN table_name LIKE 'TMP\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS n_hidden FROM discrepancies")
bound("ag5", lambda c: summary.index_columns(c.where("server_id = 0")), "fleet_columns", "SELECT table_name, index_name, string_agg(column_name, ', ' ORDER BY column_name) AS columns FROM fleet_columns WHERE server_id = 0 AND index_name IS NOT NULL GROUP BY table_name, index_name")
bound("ag10", lambda log: audit.filter_audit(log, connection=2, result="denied").agg(F.count("*").alias("n")), "audit_log", "SELECT count(*) AS n FROM audit_log WHERE outcome_raw = 'denied' AND connection_id = 2")
bound("ag9", lambda e: summary.next_version(e.select(F.format_string("V%s__x", (F.col("event_id") % 40).cast("string")).alias("name"))), "events", "SELECT max(CAST(regexp_extract(name, '^V([0-9]+)__', 1) AS INT)) + 1 AS next_version FROM (SELECT concat('V', event_id % 40, '__x') AS name FROM events) v")
VIEWS["spelt_calls"] = "SELECT id, connection_id, CASE id % 5 WHEN 0 THEN upper(tool) WHEN 1 THEN concat(' ', tool, chr(9)) WHEN 2 THEN ' ' ELSE concat(tool, '_', id % 9) END AS tool FROM audit_log"
_SCANNED = "SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY id) AS nth FROM spelt_calls"
_FIRST_SEEN = "SELECT connection_id, count(*) AS n_total, array_to_string((list(name ORDER BY pos))[1:3], ', ') AS names FROM (SELECT connection_id, min(id) AS pos, arg_min(trim(replace(tool, chr(9), '')), id) AS name FROM (" + _SCANNED + ") s WHERE nth <= 500 AND trim(replace(tool, chr(9), '')) <> '' GROUP BY connection_id, lower(trim(replace(tool, chr(9), '')))) t GROUP BY connection_id"
bound("ag11", lambda log: summary.first_seen_names(log, "connection_id", "tool", "id", 3), "spelt_calls", _FIRST_SEEN)
bound("ag12", summary.severity_counts, "audit_log", "SELECT connection_id, count(*) FILTER (WHERE outcome_raw = 'error') AS errors, count(*) FILTER (WHERE outcome_raw = 'denied') AS warnings FROM audit_log GROUP BY connection_id")
_ENDINGS = "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, CASE WHEN crlf > 0 AND lf > crlf THEN 'mixed' WHEN crlf > 0 THEN 'crlf' WHEN lf > 0 THEN 'lf' ELSE 'none' END AS line_ending FROM (SELECT doc_id, text, (length(text) - length(replace(text, concat(chr(13), chr(10)), ''))) / 2 AS crlf, length(text) - length(replace(text, chr(10), '')) AS lf FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) ELSE text END AS text FROM documents) d) e"
sql("ag13", _ENDINGS)
bound("ag14", summary.drift_cube, "discrepancies", "SELECT server_id, difference, element, count(*) AS n, CAST(grouping(server_id) * 4 + grouping(difference) * 2 + grouping(element) AS INT) AS gid FROM discrepancies GROUP BY ROLLUP (server_id, difference, element) UNION ALL SELECT NULL AS server_id, difference, element, count(*) AS n, 8 AS gid FROM discrepancies GROUP BY CUBE (difference, element)")
bound("ag15", summary.objects_by_type, "objects", "SELECT object_type, count(*) AS n, CASE object_type WHEN 'TABLE' THEN 1 WHEN 'VIEW' THEN 2 ELSE 99 END AS place FROM objects GROUP BY object_type")
bound("sk4", lambda d: sinks.write_discrepancies(d, shared.scratch(d.sparkSession)), "discrepancies", "SELECT difference, table_name, column_name, server_name, details, CASE difference WHEN 'MISSING' THEN 'missing' WHEN 'DIFFERENT' THEN 'different' END AS severity FROM discrepancies")

# ---------------------------------------------------------------- rules and policies

_LIKES = "CASE match_type WHEN 'prefix' THEN concat(upper(pattern), '%') WHEN 'suffix' THEN concat('%', upper(pattern)) WHEN 'contains' THEN concat('%', upper(pattern), '%') ELSE upper(pattern) END"
bound("fl1", lambda fc, r: rules.apply_name_rules(fc.select("server_id", "table_name").distinct(), r), "fleet_columns filter_rules", f"SELECT DISTINCT server_id, table_name FROM fleet_columns c WHERE NOT EXISTS (SELECT 1 FROM filter_rules WHERE enabled AND action = 'exclude' AND upper(c.table_name) LIKE {_LIKES})")
bound("fl1_include", lambda fc, r: rules.apply_name_rules(fc.select("server_id", "table_name").distinct(), r.withColumn("enabled", F.lit(True))), "fleet_columns filter_rules", f"SELECT DISTINCT server_id, table_name FROM fleet_columns c WHERE NOT EXISTS (SELECT 1 FROM filter_rules WHERE action = 'exclude' AND upper(c.table_name) LIKE {_LIKES}) AND EXISTS (SELECT 1 FROM filter_rules WHERE action = 'include' AND upper(c.table_name) LIKE {_LIKES})")
bound("fl2", lambda c, r: summary.rule_reach(c, rules.match_rules(c.select("table_name").distinct(), r), r), "fleet_columns filter_rules", "SELECT r.action, r.match_type, r.pattern, count(DISTINCT c.table_name) AS n_tables FROM filter_rules r LEFT JOIN fleet_columns c ON upper(c.table_name) LIKE CASE r.match_type WHEN 'prefix' THEN concat(upper(r.pattern), '%') WHEN 'suffix' THEN concat('%', upper(r.pattern)) WHEN 'contains' THEN concat('%', upper(r.pattern), '%') ELSE upper(r.pattern) END WHERE r.enabled GROUP BY r.action, r.match_type, r.pattern")
_WILD = "replace(replace(replace({}, '_', '^_'), '*', '%'), '?', '_')"
_UP = lambda text, pattern: f"upper({text}) LIKE {_WILD.format(f'upper({pattern})')} ESCAPE '^'"
_CS = lambda text, pattern: f"{text} LIKE {_WILD.format(pattern)} ESCAPE '^'"
bound("fl3", lambda fc, p: rules.match_patterns(fc.select("table_name").distinct(), p), "fleet_columns policy_table_rules", f"SELECT table_name, table_pattern, {_CS('table_name', 'table_pattern')} AS exact FROM (SELECT DISTINCT table_name FROM fleet_columns) t JOIN (SELECT DISTINCT table_pattern FROM policy_table_rules) p ON {_UP('table_name', 'table_pattern')}")
VIEWS["connection_tables"] = "SELECT DISTINCT server_id AS connection_id, table_name FROM fleet_columns"
_HIT = f"(CASE WHEN r.action = 'deny' OR s.engine = 'oracle' THEN {_UP('t.table_name', 'r.table_pattern')} ELSE {_CS('t.table_name', 'r.table_pattern')} END)"
VIEWS["access"] = f"SELECT t.connection_id, t.table_name, p.data_access = 'allowlist' AND NOT coalesce(bool_or(r.action = 'deny' AND r.column_pattern = ''), false) AND coalesce(bool_or(r.action = 'allow'), false) AS allowed, coalesce(bool_or(r.column_pattern <> ''), false) AS column_rules FROM connection_tables t JOIN policies p ON p.connection_id = t.connection_id LEFT JOIN fleet_servers s ON s.server_id = t.connection_id LEFT JOIN policy_table_rules r ON r.connection_id = t.connection_id AND {_HIT} GROUP BY t.connection_id, t.table_name, p.data_access"
fixtures.BUILDERS["access"] = lambda spark, sf_dir: rules.table_access(*(view(spark, sf_dir, v) for v in ("connection_tables", "policies", "policy_table_rules", "fleet_servers")))
bound("fl4", lambda a: a.select("connection_id", "table_name", "allowed"), "access", "SELECT connection_id, table_name, allowed FROM access")
_CHIT = f"(CASE WHEN r.action = 'deny' OR s.engine = 'oracle' THEN {_UP('t.table_name', 'r.table_pattern')} AND (r.column_pattern = '' OR {_UP('t.column_name', 'r.column_pattern')}) ELSE {_CS('t.table_name', 'r.table_pattern')} AND (r.column_pattern = '' OR {_CS('t.column_name', 'r.column_pattern')}) END)"
VIEWS["column_access"] = f"SELECT t.server_id AS connection_id, t.table_name, t.column_name, a.allowed AND NOT coalesce(bool_or(r.action = 'deny' AND r.column_pattern <> ''), false) AND coalesce(bool_or(r.action = 'allow'), false) AS allowed FROM fleet_columns t JOIN access a ON a.connection_id = t.server_id AND a.table_name = t.table_name LEFT JOIN fleet_servers s ON s.server_id = t.server_id LEFT JOIN policy_table_rules r ON r.connection_id = t.server_id AND {_CHIT} GROUP BY t.server_id, t.table_name, t.column_name, a.allowed"
fixtures.BUILDERS["column_access"] = lambda spark, sf_dir: rules.column_access(view(spark, sf_dir, "fleet_columns").withColumnRenamed("server_id", "connection_id"), *(view(spark, sf_dir, v) for v in ("policies", "policy_table_rules", "fleet_servers")))
bound("fl5", lambda a: a, "column_access", "SELECT * FROM column_access")
bound("fl6", lambda a: a.select("connection_id", "table_name", "column_rules"), "access", "SELECT connection_id, table_name, column_rules FROM access")
VIEWS["shown_objects"] = f"SELECT server_id, name, object_type FROM objects o WHERE NOT EXISTS (SELECT 1 FROM policy_object_deny d WHERE d.connection_id = o.server_id AND (d.object_type IN ('*', '') OR upper(d.object_type) = upper(o.object_type)) AND {_UP('o.name', 'd.name_pattern')})"
fixtures.BUILDERS["shown_objects"] = lambda spark, sf_dir: rules.hide_objects(view(spark, sf_dir, "objects").select("server_id", "name", "object_type"), view(spark, sf_dir, "policy_object_deny"))
bound("fl7", lambda o: o, "shown_objects", "SELECT * FROM shown_objects")
bound("fl8", lambda q, d: rules.texts_mentioning_hidden(q.select(F.col("id").alias("doc_id"), F.col("sql_text").alias("text")), d, 0), "query_log policy_object_deny", f"SELECT id AS doc_id, count(*) AS hits FROM (SELECT DISTINCT id, unnest(regexp_split_to_array(sql_text, '[^\\p{{L}}\\p{{N}}_$#]+')) AS word FROM query_log) w WHERE word <> '' AND EXISTS (SELECT 1 FROM policy_object_deny d WHERE d.connection_id = 0 AND {_UP('w.word', 'd.name_pattern')}) GROUP BY id")
bound("fl15", lambda d: summary.browse(d, " T1", 2), "discrepancies", "SELECT * FROM discrepancies WHERE server_id = 2 AND (contains(lower(table_name), 't1') OR contains(lower(column_name), 't1') OR contains(lower(server_name), 't1') OR contains(lower(difference), 't1') OR contains(lower(details), 't1'))")
bound("fl16", lambda d: summary.contains_all(d, {"table_name": " HIST ", "details": "null", "column_name": " "}), "discrepancies", "SELECT * FROM discrepancies WHERE contains(lower(table_name), lower(trim(' HIST '))) AND contains(lower(details), 'null')")
bound("fl17", lambda log: audit.filter_audit(log, connection=2, result="error", target="t3", start="2024-01-03", stop="2024-01-20").select("id", "tool", "outcome_raw"), "audit_log", "SELECT id, tool, outcome_raw FROM audit_log WHERE connection_id = 2 AND outcome_raw NOT IN ('allowed', 'denied') AND contains(lower(CAST(json_extract(arguments, '$.target.names') AS VARCHAR)), 't3') AND strftime(event_ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-03' AND strftime(event_ts, '%Y-%m-%d') <= '2024-01-20'")
bound("fl19", summary.change_text, "discrepancies", "SELECT server_id, table_name, column_name, element, CASE WHEN difference = 'MISSING' AND details LIKE '%found in reference server%' THEN 'missing' WHEN difference = 'MISSING' THEN 'extra' ELSE replace(regexp_replace(details, '^[A-Z_]+: ', ''), ' != ', ' -> ') END AS change_text FROM discrepancies")
bound("fl20", lambda d: summary.chosen_tables(d, ["t1", " T25", "hist_t2", "T121 "]), "discrepancies", "SELECT DISTINCT table_name FROM discrepancies WHERE upper(trim(table_name)) IN ('T1', 'T25', 'HIST_T2', 'T121') OR element = 'TABLE'")
bound("fl23", summary.access_preview, "shown_objects policies access", "SELECT o.server_id AS connection_id, o.name, CASE WHEN o.object_type <> 'TABLE' THEN 'n/a' WHEN a.allowed AND a.column_rules THEN 'restricted' WHEN a.allowed THEN 'allowed' ELSE 'denied' END AS data_access FROM shown_objects o JOIN policies p ON p.connection_id = o.server_id LEFT JOIN access a ON a.connection_id = o.server_id AND a.table_name = o.name")
VIEWS["history_pairs"] = "SELECT m.server_id, m.table_name AS main, coalesce(h1.table_name, h2.table_name) AS history, CASE WHEN h1.table_name IS NOT NULL THEN 1 ELSE 2 END AS rule_id FROM (SELECT DISTINCT server_id, table_name FROM fleet_columns WHERE table_name NOT LIKE '%HIST%') m LEFT JOIN (SELECT DISTINCT server_id, table_name FROM fleet_columns) h1 ON h1.server_id = m.server_id AND lower(h1.table_name) = lower(concat('HIST_', m.table_name)) LEFT JOIN (SELECT DISTINCT server_id, table_name FROM fleet_columns) h2 ON h2.server_id = m.server_id AND lower(h2.table_name) = lower(concat(m.table_name, '_HIST')) WHERE coalesce(h1.table_name, h2.table_name) IS NOT NULL"
bound("jn7", lambda fc, n: rules.history_pairs(fc.select("server_id", "table_name").distinct(), n), "fleet_columns naming_rules", "SELECT server_id, main, history, rule_id FROM history_pairs")
_TYPE = lambda s: f"CASE WHEN {s}.data_length IS NOT NULL THEN concat({s}.data_type, '(', {s}.data_length, ')') ELSE {s}.data_type END"
VIEWS["history_columns"] = f"SELECT p.server_id, p.history AS history_table, m.column_name, {_TYPE('m')} AS main_type, {_TYPE('h')} AS history_type, h.column_name AS history_column FROM history_pairs p JOIN fleet_columns m ON m.server_id = p.server_id AND m.table_name = p.main LEFT JOIN fleet_columns h ON h.server_id = p.server_id AND h.table_name = p.history AND upper(h.column_name) = upper(m.column_name) WHERE m.column_id > 1 AND upper(m.data_type) NOT IN ('CLOB', 'BLOB', 'LONG', 'LONG RAW')"
sql("jn8", "SELECT server_id, history_table, column_name, history_column FROM history_columns")
bound("gn10", rules.history_issues, "fleet_columns naming_rules fleet_servers", "SELECT server_id, history_table, column_name, issue_type, main_type, history_type, CASE WHEN server_id < 3 AND issue_type = 'MISSING' THEN concat('ALTER TABLE ', history_table, ' ADD (', column_name, ' ', main_type, ');') WHEN server_id < 3 THEN concat('ALTER TABLE ', history_table, ' MODIFY (', column_name, ' ', main_type, ');') WHEN issue_type = 'MISSING' THEN concat('ALTER TABLE ', history_table, ' ADD COLUMN IF NOT EXISTS ', column_name, ' ', main_type, ';') ELSE concat('ALTER TABLE ', history_table, ' ALTER COLUMN ', column_name, ' TYPE ', main_type, ' USING ', column_name, '::', main_type, ';') END AS statement FROM (SELECT *, CASE WHEN history_type IS NULL THEN 'MISSING' WHEN upper(history_type) <> upper(main_type) THEN 'TYPE_MISMATCH' END AS issue_type FROM history_columns) i WHERE issue_type IS NOT NULL")
bound("ag7", lambda c, n, s: summary.issues_by_table(rules.history_issues(c, n, s)), "fleet_columns naming_rules fleet_servers", "SELECT history_table, count(*) AS n_issues, count(DISTINCT server_id) AS n_servers FROM (SELECT * FROM history_columns WHERE history_type IS NULL OR upper(history_type) <> upper(main_type)) i GROUP BY history_table")
bound("jn9", lambda fc, r: rules.match_rules(fc.select("table_name").distinct(), r).select("table_name", "match_type", "pattern"), "fleet_columns filter_rules", f"SELECT table_name, match_type, pattern FROM (SELECT DISTINCT table_name FROM fleet_columns) c JOIN filter_rules ON enabled AND upper(c.table_name) LIKE {_LIKES}")
sql("jn5", "SELECT DISTINCT server_id, table_name FROM fleet_columns WHERE table_name NOT IN (SELECT name FROM objects WHERE object_type = 'VIEW' UNION ALL SELECT name FROM objects WHERE object_type = 'MATERIALIZED VIEW')")
sql("jn6", "SELECT DISTINCT server_id, table_id, index_name FROM fleet_index_columns i WHERE NOT EXISTS (SELECT 1 FROM fleet_index_columns c WHERE c.server_id = i.server_id AND c.table_id = i.table_id AND c.column_name = 'C1' AND c.index_name = i.index_name)")
_CASED = "CASE WHEN server_id = 1 THEN lower(table_name) WHEN server_id = 2 THEN concat(substr(table_name, 1, 1), lower(substr(table_name, 2))) ELSE table_name END AS key"
bound("jn10", lambda c: summary.lookup_names(c.where("server_id < 3").selectExpr(_CASED).distinct(), c.where("server_id = 0")), "fleet_columns", "SELECT k.key, min(r.table_name) AS matched, min(CASE WHEN r.table_name = k.key THEN 1 WHEN r.table_name = upper(k.key) THEN 2 WHEN r.table_name = lower(k.key) THEN 3 ELSE 4 END) AS priority FROM (SELECT DISTINCT CASE WHEN server_id = 1 THEN lower(table_name) WHEN server_id = 2 THEN initcap_(table_name) ELSE table_name END AS key FROM fleet_columns WHERE server_id < 3) k LEFT JOIN (SELECT DISTINCT table_name FROM fleet_columns WHERE server_id = 0) r ON lower(r.table_name) = lower(k.key) GROUP BY k.key".replace("initcap_(table_name)", "concat(substr(table_name, 1, 1), lower(substr(table_name, 2)))"))
