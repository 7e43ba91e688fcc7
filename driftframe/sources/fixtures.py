"""Derived views of the test tables, the inputs of the registered queries; one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftframe.operators.shared import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "fleet_columns": """
SELECT CAST(l_suppkey % 5 AS INT) AS server_id,
 CASE WHEN p_partkey % 20 = 0 THEN concat('TMP_T', CAST(floor(p_partkey / 2) AS BIGINT))
      WHEN p_partkey % 2 = 0 THEN concat('T', CAST(floor(p_partkey / 2) AS BIGINT))
      WHEN p_partkey % 4 = 1 THEN concat('HIST_T', CAST(floor(p_partkey / 2) AS BIGINT))
      ELSE concat('T', CAST(floor(p_partkey / 2) AS BIGINT), '_HIST') END AS table_name,
 concat('C', l_linenumber) AS column_name,
 l_linenumber AS column_id,
 CASE WHEN max(l_discount) >= 0.095 THEN 'CLOB'
      WHEN (max(p_size) + l_linenumber) % 4 = 0 THEN 'NUMBER'
      WHEN (max(p_size) + l_linenumber) % 4 = 1 THEN 'DATE'
      WHEN (max(p_size) + l_linenumber) % 4 = 2 AND min(l_returnflag) = 'A' THEN 'varchar2'
      ELSE 'VARCHAR2' END AS data_type,
 CASE WHEN max(l_discount) >= 0.095 OR (max(p_size) + l_linenumber) % 4 = 1 THEN NULL
      WHEN max(l_tax) >= 0.075 THEN CAST(max(p_size) + 10 AS VARCHAR(10))
      ELSE CAST(max(p_size) AS VARCHAR(10)) END AS data_length,
 CASE WHEN max(l_quantity) >= 45 THEN '0' WHEN max(l_quantity) >= 40 THEN 'SYSDATE' ELSE NULL END AS data_default,
 CASE WHEN min(l_returnflag) = 'R' THEN NULL ELSE concat('Flag ', min(l_returnflag)) END AS comments,
 CASE WHEN l_linenumber > 2 OR min(l_linestatus) = 'O' THEN NULL ELSE concat('IX_', max(p_size), '_', min(l_returnflag)) END AS index_name
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_suppkey % 5, p_partkey, l_linenumber""",
    "fleet_index_columns": """
SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS server_id, CAST(l_partkey AS BIGINT) AS table_id,
 concat('C', l_linenumber) AS column_name, concat('IX_', l_returnflag, l_linestatus) AS index_name, l_linenumber AS index_position
FROM lineitem WHERE l_linenumber <= 3""",
    "fleet_servers": """
SELECT * FROM (VALUES (0, 'alpha', 'oracle', 'north', 'APP'), (1, 'Bravo', 'oracle', 'north', 'APP'), (2, 'charlie', 'oracle', '', 'APP'),
 (3, 'delta', 'postgres', 'south', 'app'), (4, 'Echo', 'postgres', ' ', 'app'), (5, 'Foxtrot', 'postgres', 'south', 'app')) AS t(server_id, server_name, engine, group_name, schema_name)""",
    # fixed values: the 14 rules that are enabled by default
    "filter_rules": """
SELECT * FROM (VALUES ('exclude','prefix','V_',true), ('exclude','prefix','VW_',true), ('exclude','prefix','HIST_',true), ('exclude','prefix','TEST_',true),
 ('exclude','prefix','TEMP_',true), ('exclude','prefix','TMP_',true), ('exclude','suffix','_VW',true), ('exclude','suffix','_HIST',true), ('exclude','suffix','_TEST',true),
 ('exclude','suffix','_TEMP',true), ('exclude','suffix','_TMP',true), ('exclude','contains','_TEST_',true), ('exclude','contains','_TEMP_',true), ('exclude','contains','_TMP_',true),
 ('include','prefix','T1',false), ('include','exact','T25',false)) AS t(action, match_type, pattern, enabled)""",
    "naming_rules": """
SELECT * FROM (VALUES (1,'prefix','HIST_',true), (2,'suffix','_HIST',true), (3,'contains','HIST',true)) AS t(rule_id, match_type, pattern, enabled)""",
    "policies": """
SELECT * FROM (VALUES (0, true, true, true, false, true, true, true, 'allowlist', true, 200, 30, false), (1, true, true, true, false, false, false, false, 'none', true, 50000, 0, false),
 (2, false, true, true, true, true, true, true, 'allowlist', true, 200, 30, true), (3, true, false, true, true, true, true, false, 'allowlist', false, 0, 900, true)) AS t(connection_id, mcp_enabled,
 allow_schema_list, allow_ddl_read, allow_save_scripts, allow_compare_fix, allow_invalid_objects, allow_compare_object, data_access, allow_raw_sql, max_rows, query_timeout_secs, allow_apply_ddl)""",
    "policy_table_rules": """
SELECT * FROM (VALUES (0,'allow','T1*',''), (0,'deny','t1?',''), (0,'deny','*','c7'), (0,'allow','T2*','C?'), (3,'allow','t*',''), (3,'deny','HIST_*','*')) AS t(connection_id, action, table_pattern, column_pattern)""",
    "policy_object_deny": """
SELECT * FROM (VALUES (0,'*','TMP_*'), (0,'VIEW','T1*'), (3,'TABLE','t9?')) AS t(connection_id, object_type, name_pattern)""",
    "audit_log": """
SELECT event_id + 1 AS id, ts AS event_ts, event_type AS tool, user_id % 5 AS connection_id, concat('conn-', user_id % 5) AS connection_name,
 concat('{"target":{"object_type":"TABLE","names":["T', user_id, '","T', event_id % 7, '"]}}') AS arguments,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'denied' WHEN 'purchase' THEN 'bogus' ELSE 'allowed' END AS outcome_raw,
 CASE WHEN event_type = 'signup' THEN '=denied, "policy"' ELSE '' END AS reason,
 CAST(floor(value) AS BIGINT) AS row_count, CAST(length(props) AS BIGINT) AS bytes, event_id % 1000 AS duration_ms
FROM events""",
    # entries that repeat an id, that have no connection, no row count, and characters that JSON escapes
    "audit_entries": """
SELECT *, concat('client-', id % 3) AS client_name FROM audit_log
UNION ALL SELECT id, event_ts, tool, connection_id, connection_name, arguments, outcome_raw, reason, CAST(NULL AS BIGINT), bytes, duration_ms + 1, 'client-9' FROM audit_log WHERE id % 77 = 0
UNION ALL SELECT id, event_ts, tool, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR(9)), arguments, outcome_raw, concat('two', chr(10), chr(9), 'lines ', chr(1), chr(31), chr(34), chr(92), 'é'), row_count, bytes, duration_ms, '' FROM audit_log WHERE id % 50 = 0""",
    "query_log": """
SELECT event_id AS id, ts AS created_at, event_id % 11 = 0 AS pinned, event_id % 13 = 0 AS favorite, event_id % 5 AS sort_order,
 CASE event_id % 8 WHEN 0 THEN 'SELECT COUNT(*) FROM T1' WHEN 1 THEN concat('-- note: x', chr(10), 'select upper(a), dbms_lob.getlength(b) from T2')
  WHEN 2 THEN 'WITH q AS (SELECT 1 a FROM T3) SELECT sum(a) OVER () FROM q' WHEN 3 THEN 'DELETE FROM T1 WHERE a = ''drop(x)''' WHEN 4 THEN 'create table x (a int)'
  WHEN 5 THEN 'SELECT pg_sleep(1)' WHEN 6 THEN 'SELECT 1; SELECT 2' ELSE 'SELECT COUNT(*) FROM T1' END AS sql_text
FROM events""",
    "ddl_pairs": """
SELECT doc_id, text AS server_text, file_text FROM (
 SELECT doc_id, text, lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS file_text FROM documents) AS p
WHERE file_text IS NOT NULL""",
    "objects": """
SELECT server_id, table_name AS name, min(CASE WHEN table_name LIKE 'TMP%' THEN 'VIEW' WHEN table_name LIKE 'HIST%' THEN 'MATERIALIZED VIEW' ELSE 'TABLE' END) AS object_type,
 max(CASE WHEN column_name = 'C7' AND data_type = 'CLOB' THEN 'INVALID' ELSE 'VALID' END) AS status_max,
 min(CASE WHEN column_name = 'C7' AND data_type = 'CLOB' THEN 'INVALID' ELSE 'VALID' END) AS status
FROM fleet_columns GROUP BY server_id, table_name""",
}

#: Views whose rows an operator makes in Spark; DuckDB takes VIEWS instead.
BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



#: Views that are tables for now, by folder and name.
_HELD: dict[tuple[str, str], DataFrame] = {}


@contextmanager
def once(spark: SparkSession, sf_dir: str, *names: str) -> Iterator[None]:
    """Within the block these views are derived once and read from tables in the shared folder, however many views and operators read them."""
    new = [name for name in names if (sf_dir, name) not in _HELD]  # those that a block around this one holds are left to it
    try:
        for name in new:
            _HELD[sf_dir, name] = written(view(spark, sf_dir, name), name)
        yield
    finally:
        for name in new:
            _HELD.pop((sf_dir, name), None)


def used(sql: str) -> list[str]:
    """Names of views in a text, those they need first."""
    found: list[str] = []

    def walk(text: str, within: tuple[str, ...]) -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in VIEWS and name not in found and name not in within:
                walk(VIEWS[name], (*within, name))
                found.append(name)

    walk(sql, ())
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, of the data in ``sf_dir``."""
    if (sf_dir, name) in _HELD:
        return _HELD[sf_dir, name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUILDERS:
        return BUILDERS[name](spark, sf_dir)
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over views and tables of ``sf_dir``; they are looked up when the text is analysed."""
    for name in dict.fromkeys(re.findall(r"\b[a-z_]+\b", sql)):
        if name in VIEWS or name in TABLES:
            view(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def oracle(sql: str) -> str:
    """The same text for DuckDB, with the views it uses."""
    names = used(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql, count=1, flags=re.I)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE ", sql, flags=re.I) else ""
    return f"WITH {recursive}{head}{', ' if body != sql else ' '}{body}"
