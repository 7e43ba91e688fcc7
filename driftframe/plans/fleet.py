"""Queries of catalogs, table models, policies and SQL screening: operators bound to views of the test tables, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import catalog, drift, heads, repair, rules, sql_log, summary
from driftframe.plans.registry import ORACLE_TEXT, QUERIES, attribute_rows, bound, sql  # noqa: F401
from driftframe.sources import fixtures
from driftframe.sources.fixtures import VIEWS, view

# ---------------------------------------------------------------- catalogs

VIEWS["raw_objects"] = """
SELECT server_id, name, CASE WHEN server_id < 3 THEN lower(object_type) WHEN object_type = 'TABLE' THEN 'r' WHEN object_type = 'VIEW' THEN 'v' ELSE 'm' END AS code, status FROM objects
UNION ALL SELECT server_id, name, CASE WHEN server_id < 3 THEN 'TABLE' ELSE 'p' END AS code, 'VALID' AS status FROM objects WHERE object_type = 'MATERIALIZED VIEW'
UNION ALL SELECT CAST(s_suppkey % 5 AS INT) AS server_id, concat('SEQ_', s_suppkey) AS name, CASE WHEN s_suppkey % 5 < 3 THEN 'SEQUENCE' ELSE 'S' END AS code, CASE WHEN s_suppkey % 4 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM supplier"""
VIEWS["named_objects"] = """
SELECT server_id, name, CASE code WHEN 'r' THEN 'TABLE' WHEN 'p' THEN 'TABLE' WHEN 'v' THEN 'VIEW' WHEN 'm' THEN 'MATERIALIZED VIEW' WHEN 'S' THEN 'SEQUENCE' ELSE upper(code) END AS object_type, upper(status) AS status FROM raw_objects"""
VIEWS["listed_objects"] = """
SELECT DISTINCT server_id, name, object_type FROM named_objects o WHERE status = 'VALID'
AND NOT (object_type = 'TABLE' AND EXISTS (SELECT 1 FROM named_objects m WHERE m.server_id = o.server_id AND m.name = o.name AND m.object_type = 'MATERIALIZED VIEW'))"""
fixtures.BUILDERS["listed_objects"] = lambda spark, sf_dir: catalog.list_objects(view(spark, sf_dir, "raw_objects"))
VIEWS["shown_listed"] = VIEWS["shown_objects"].replace("FROM objects o", "FROM listed_objects o")
_TOP = """
SELECT server_id, name, object_type, n > {cap} AS truncated FROM (
 SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY object_type, name) AS rn, count(*) OVER (PARTITION BY server_id) AS n FROM {of}) o WHERE rn <= {cap}"""
bound("sc3", lambda o: o, "listed_objects", "SELECT * FROM listed_objects")
bound("sc4", lambda o, d: catalog.governed_objects(o, d), "listed_objects policy_object_deny", _TOP.format(cap=5000, of="shown_listed"))
bound("sc4_tables", lambda o, d: catalog.governed_objects(o, d, " table ", 20), "listed_objects policy_object_deny", _TOP.format(cap=20, of="(SELECT * FROM shown_listed WHERE object_type = 'TABLE') t"))
_PAIR = "concat(column_name, ' ', data_type)"
bound(
    "sc5",
    lambda c, o: catalog.relation_catalog(c, o).select("server_id", "name", "kind", F.coalesce(F.array_join(F.transform("columns", lambda x: F.concat_ws(" ", x["name"], x["type"])), ", "), F.lit("")).alias("columns")),
    "fleet_columns listed_objects",
    f"""
SELECT c.server_id, c.table_name AS name, coalesce(min(CASE WHEN o.object_type <> 'TABLE' THEN o.object_type END), 'TABLE') AS kind, c.columns FROM (
 SELECT server_id, table_name, string_agg({_PAIR}, ', ' ORDER BY column_id) AS columns FROM fleet_columns GROUP BY server_id, table_name) c
 LEFT JOIN listed_objects o ON o.server_id = c.server_id AND o.name = c.table_name AND o.object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW') GROUP BY c.server_id, c.table_name, c.columns
UNION ALL SELECT server_id, name, object_type, '' FROM listed_objects WHERE object_type NOT IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW')""",
)
VIEWS["invalid_by_server"] = "SELECT o.server_id, o.name, o.object_type FROM named_objects o JOIN fleet_servers s ON s.server_id = o.server_id WHERE o.status = 'INVALID' AND s.engine <> 'postgres'"
_INVALID = """
SELECT server_id, true AS applicable, name, object_type, truncated FROM ({}) t
UNION ALL SELECT server_id, false, NULL, NULL, false FROM fleet_servers WHERE engine = 'postgres'"""
bound("sc8", catalog.invalid_objects, "raw_objects fleet_servers", _INVALID.format(_TOP.format(cap=5000, of="invalid_by_server")))
bound("sc8_capped", lambda o, s: catalog.invalid_objects(o, s, "sequence", 3), "raw_objects fleet_servers", _INVALID.format(_TOP.format(cap=3, of="(SELECT * FROM invalid_by_server WHERE object_type = 'SEQUENCE') i")))
VIEWS["compile_rows"] = """
SELECT CAST(event_id % 5 AS INT) AS server_id, concat('SEQ_', event_id % 500) AS name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 90 AS INT) END AS line, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 40 AS INT) END AS position,
 CASE event_id % 4 WHEN 0 THEN ' warning ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Error' END AS attribute, CASE WHEN event_id % 50 = 0 THEN repeat('long ', 500) ELSE concat(' ', props) END AS message FROM events"""
VIEWS["compile_errors"] = """
SELECT server_id, name, coalesce(line, 0) AS line, coalesce(position, 0) AS position, CASE WHEN trim(coalesce(attribute, '')) = '' THEN 'ERROR' ELSE upper(trim(attribute)) END AS attribute,
 CASE WHEN length(trim(message)) > 2000 THEN concat(substr(trim(message), 1, 2000), '…') ELSE trim(message) END AS message FROM compile_rows"""
bound("sc9", catalog.compile_errors, "compile_rows", "SELECT * FROM compile_errors")
bound(
    "sc9_notes",
    lambda e, o: catalog.compile_summary(e, o.select("server_id", "name", "status")),
    "compile_rows raw_objects",
    """
SELECT coalesce(o.server_id, e.server_id) AS server_id, coalesce(o.name, e.name) AS name, o.status, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings,
 CASE WHEN o.status IS NULL THEN 'no such object' WHEN e.name IS NULL AND o.status = 'INVALID' THEN 'invalid without recorded errors' WHEN e.name IS NULL THEN 'no errors recorded' END AS note
FROM (SELECT server_id, name, min(status) AS status FROM named_objects GROUP BY server_id, name) o
FULL JOIN (SELECT server_id, name, count(*) FILTER (attribute <> 'WARNING') AS n_errors, count(*) FILTER (attribute = 'WARNING') AS n_warnings FROM compile_errors GROUP BY server_id, name) e ON e.server_id = o.server_id AND e.name = o.name""",
)

# ---------------------------------------------------------------- table models and their definitions

VIEWS["fleet_index_parts"] = """
SELECT server_id, table_name, concat('IX_', table_name, '_', column_id % 2) AS index_name, column_id % 2 = 0 AS is_unique, column_id AS position, column_name, CASE WHEN column_id = 3 THEN concat('UPPER(', column_name, ')') END AS expression
FROM fleet_columns WHERE column_id BETWEEN 2 AND 4
UNION ALL SELECT server_id, table_name, concat('PK_', table_name), true, 1, column_name, NULL FROM fleet_columns WHERE column_id = 1"""
_RULE = "SELECT server_id, table_name, concat('{name}_', table_name) AS constraint_name, '{kind}' AS kind, {position} AS position, column_name, CAST({condition} AS VARCHAR(200)) AS condition, CAST({table} AS VARCHAR(200)) AS target_table, CAST({column} AS VARCHAR(200)) AS target_column, CAST({gone} AS VARCHAR(200)) AS on_delete FROM fleet_columns WHERE column_id {where}"
_NONE = {"condition": "NULL", "table": "NULL", "column": "NULL", "gone": "NULL"}
VIEWS["fleet_constraints"] = "\nUNION ALL ".join([
    _RULE.format(**(_NONE | {"name": "PK", "kind": "P", "position": 1, "where": "= 1"})),
    _RULE.format(**(_NONE | {"name": "UQ", "kind": "U", "position": "column_id", "where": "IN (3, 4)"})),
    _RULE.format(**(_NONE | {"name": "NN", "kind": "C", "position": 1, "where": "= 2", "condition": """concat('"', column_name, '" IS NOT NULL')"""})),
    _RULE.format(**(_NONE | {"name": "CK", "kind": "C", "position": 1, "where": "= 6", "condition": "concat(column_name, ' > 0')"})),
    _RULE.format(**(_NONE | {"name": "FK", "kind": "R", "position": 1, "where": "= 5", "table": "'T1'", "column": "'C1'", "gone": "CASE WHEN server_id % 2 = 0 THEN 'CASCADE' WHEN server_id = 1 THEN 'NO ACTION' END"})),
])
VIEWS["fleet_table_comments"] = "SELECT DISTINCT server_id, table_name, CASE WHEN table_name LIKE '%5' THEN concat('It''s ', table_name) WHEN table_name LIKE '%4' THEN ' ' END AS comment FROM fleet_columns"
_NN = """CASE WHEN condition LIKE '"%" IS NOT NULL' THEN replace(replace(condition, '" IS NOT NULL', ''), '"', '') ELSE '' END"""
VIEWS["model_columns"] = f"""
SELECT c.server_id, c.table_name, c.column_id, c.column_name, concat(c.data_type, CASE WHEN coalesce(trim(c.data_length), '') = '' THEN '' ELSE concat('(', trim(c.data_length), ')') END) AS type_text,
 nullif(trim(c.data_default), '') AS default_text, nn.name IS NOT NULL AS not_null, nullif(trim(c.comments), '') AS note FROM fleet_columns c
LEFT JOIN (SELECT DISTINCT server_id, table_name, {_NN} AS name FROM fleet_constraints WHERE kind = 'C') nn ON nn.server_id = c.server_id AND nn.table_name = c.table_name AND nn.name = c.column_name"""
VIEWS["model_indexes"] = """
SELECT server_id, table_name, index_name, bool_or(is_unique) AS is_unique, list(coalesce(expression, column_name) ORDER BY position) AS parts FROM fleet_index_parts i
WHERE NOT EXISTS (SELECT 1 FROM fleet_constraints k WHERE k.kind IN ('P', 'U') AND k.server_id = i.server_id AND k.table_name = i.table_name AND k.constraint_name = i.index_name) GROUP BY server_id, table_name, index_name"""
VIEWS["model_constraints"] = f"""
SELECT server_id, table_name, constraint_name, kind, strpos('PURC', kind) AS rank, list(column_name ORDER BY position) AS own, max(condition) AS condition, max(target_table) AS target, list(target_column ORDER BY position) AS target_columns, max(on_delete) AS on_delete
FROM fleet_constraints WHERE NOT (kind = 'C' AND {_NN} <> '') GROUP BY server_id, table_name, constraint_name, kind"""


def _models(spark, sf_dir: str) -> DataFrame:
    with fixtures.once(spark, sf_dir, "fleet_columns"):  # columns, indexes, constraints and comments are all taken from it
        return catalog.table_models(*(view(spark, sf_dir, v) for v in ("fleet_columns", "fleet_index_parts", "fleet_constraints", "fleet_table_comments")))


fixtures.BUILDERS["table_models"] = _models
def said_model(models: DataFrame) -> DataFrame:
    """Table models in words."""
    maybe = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    columns = F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"], F.when(c["not_null"], " NN").otherwise(""), maybe(" D=", c["default"]), maybe(" /", c["comment"])))
    indexes = F.transform("indexes", lambda i: F.concat(i["name"], F.when(i["is_unique"], "!").otherwise(""), F.lit(":"), F.array_join(i["parts"], "+")))
    target = lambda c: F.concat(c["target"], F.lit("."), F.array_join(c["target_columns"], "+"))
    constraints = F.transform("constraints", lambda c: F.concat(c["kind"], F.lit(":"), c["name"], F.lit(":"), F.array_join(c["own"], "+"), maybe("?", c["condition"]), maybe(">", target(c)), maybe("-", c["on_delete"])))
    joined = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    return models.select("server_id", "table_name", "table_comment", joined(columns, ", ").alias("columns"), joined(indexes, "; ").alias("indexes"), joined(constraints, "; ").alias("constraints"))


bound(
    "sc7",
    said_model,
    "table_models",
    """
SELECT c.server_id, c.table_name, nullif(trim(t.comment), '') AS table_comment,
 string_agg(concat(column_name, ' ', type_text, CASE WHEN not_null THEN ' NN' ELSE '' END, coalesce(' D=' || default_text, ''), coalesce(' /' || note, '')), ', ' ORDER BY column_id) AS columns,
 coalesce((SELECT string_agg(concat(index_name, CASE WHEN is_unique THEN '!' ELSE '' END, ':', array_to_string(parts, '+')), '; ' ORDER BY index_name) FROM model_indexes i WHERE i.server_id = c.server_id AND i.table_name = c.table_name), '') AS indexes,
 coalesce((SELECT string_agg(concat(kind, ':', constraint_name, ':', array_to_string(own, '+'), coalesce('?' || condition, ''), coalesce('>' || target || '.' || array_to_string(target_columns, '+'), ''), coalesce('-' || on_delete, '')), '; ' ORDER BY rank, constraint_name) FROM model_constraints k WHERE k.server_id = c.server_id AND k.table_name = c.table_name), '') AS constraints
FROM model_columns c LEFT JOIN fleet_table_comments t ON t.server_id = c.server_id AND t.table_name = c.table_name GROUP BY c.server_id, c.table_name, t.comment""",
)
_TAIL = "type_text, coalesce(' default ' || default_text, ''), CASE WHEN not_null THEN ' not null' ELSE '' END"
_Q1 = "replace({}, chr(39), chr(39) || chr(39))"
VIEWS["table_ddls"] = f"""
SELECT p.server_id, p.table_name, concat(
 CASE WHEN ora THEN concat('create table ', p.table_name, chr(10), '(', chr(10), padded, chr(10), ')', chr(10), ';') ELSE concat('create table ', p.table_name, ' (', chr(10), plain, chr(10), ');') END,
 CASE WHEN t.comment IS NULL THEN '' ELSE concat(CASE WHEN ora THEN chr(10) ELSE chr(10) || chr(10) END, 'comment on table ', p.table_name, CASE WHEN ora THEN chr(10) || '  ' ELSE ' ' END, 'is ' || chr(39) || {_Q1.format('t.comment')} || chr(39) || ';') END,
 coalesce(notes, ''), coalesce(made, ''), coalesce(rule, '')) AS ddl
FROM (SELECT c.server_id, c.table_name, s.engine = 'oracle' AS ora,
  string_agg(concat('  ', rpad(lower(column_name), CAST(widest + 1 AS INT), ' '), {_TAIL}), ',' || chr(10) ORDER BY column_id) AS padded,
  string_agg(concat('  ', column_name, ' ', {_TAIL}), ',' || chr(10) ORDER BY column_id) AS plain,
  string_agg(CASE WHEN note IS NOT NULL THEN concat(chr(10), 'comment on column ', c.table_name, '.', CASE WHEN s.engine = 'oracle' THEN lower(column_name) ELSE column_name END, CASE WHEN s.engine = 'oracle' THEN chr(10) || '  is ' ELSE ' is ' END, chr(39), {_Q1.format('note')}, chr(39), ';') END, '' ORDER BY column_id) AS notes
 FROM (SELECT *, max(length(column_name)) OVER (PARTITION BY server_id, table_name) AS widest FROM model_columns) c JOIN fleet_servers s ON s.server_id = c.server_id GROUP BY c.server_id, c.table_name, s.engine) p
LEFT JOIN (SELECT server_id, table_name, comment FROM fleet_table_comments WHERE trim(comment) <> '') t ON t.server_id = p.server_id AND t.table_name = p.table_name
LEFT JOIN (SELECT server_id, table_name, string_agg(concat(chr(10), 'create ', CASE WHEN is_unique THEN 'unique ' ELSE '' END, 'index ', index_name, ' on ', table_name, ' (', array_to_string(parts, ', '), ');'), '' ORDER BY index_name) AS made FROM model_indexes GROUP BY server_id, table_name) i ON i.server_id = p.server_id AND i.table_name = p.table_name
LEFT JOIN (SELECT k.server_id, k.table_name, string_agg(concat(chr(10), 'alter table ', k.table_name, CASE WHEN s.engine = 'oracle' THEN chr(10) || ' ' ELSE '' END, ' add constraint ', constraint_name, ' ', CASE kind WHEN 'P' THEN concat('primary key (', array_to_string(own, ', '), ')') WHEN 'U' THEN concat('unique (', array_to_string(own, ', '), ')') WHEN 'C' THEN concat('check (', condition, ')')
   ELSE concat('foreign key (', array_to_string(own, ', '), ')', CASE WHEN s.engine = 'oracle' THEN chr(10) || ' ' ELSE '' END, ' references ', target, ' (', array_to_string(target_columns, ', '), ')', CASE WHEN on_delete IN ('CASCADE', 'SET NULL') THEN concat(CASE WHEN s.engine = 'oracle' THEN chr(10) || ' ' ELSE '' END, ' on delete ', lower(on_delete)) ELSE '' END) END, ';'), '' ORDER BY rank, constraint_name) AS rule
  FROM model_constraints k JOIN fleet_servers s ON s.server_id = k.server_id GROUP BY k.server_id, k.table_name) k ON k.server_id = p.server_id AND k.table_name = p.table_name"""
fixtures.BUILDERS["table_ddls"] = lambda spark, sf_dir: catalog.render(_models(spark, sf_dir), view(spark, sf_dir, "fleet_servers"))
bound("tx11", lambda d: d, "table_ddls", "SELECT * FROM table_ddls")
VIEWS["ddl_statements"] = """
SELECT server_id, table_name, row_number() OVER (PARTITION BY server_id, table_name ORDER BY place) AS seq, statement FROM (
 SELECT server_id, table_name, unnest(parts) AS statement, generate_subscripts(parts, 1) AS place FROM (
  SELECT server_id, table_name, list_transform(string_split(regexp_replace(chr(10) || ddl, chr(10) || '(create table|create unique index|create index|comment on|alter table)', chr(1) || '\\1', 'gi'), chr(1)), lambda x: rtrim(x, chr(10) || ' ')) AS parts FROM table_ddls) p) s WHERE statement <> ''"""
bound("tx13", catalog.statements, "table_ddls", "SELECT server_id, table_name, CAST(seq AS INT) AS seq, statement FROM ddl_statements")
_BARE = "rtrim(statement, chr(10) || ' ;/')"
_NAME = """regexp_extract(statement, '(?i)^(?:create\\s+(?:unique\\s+)?index|create\\s+table|alter\\s+table\\s+\\S+\\s+add\\s+constraint)\\s+"?([^\\s"(]+)', 1)"""
VIEWS["deploy_parts"] = f"""
SELECT server_id, table_name, CAST(seq AS INT) AS seq, statement, {_BARE} AS bare, {_NAME} AS name,
 CASE WHEN statement LIKE 'create table%' THEN 'table' WHEN statement LIKE 'create%index%' THEN 'index' WHEN statement LIKE 'alter table%' THEN 'constraint' ELSE 'comment' END AS kind FROM ddl_statements"""
_AGAIN = """CASE kind WHEN 'table' THEN replace(statement, 'create table', 'create table if not exists') WHEN 'index' THEN replace(statement, ' index ', ' index if not exists ')
 WHEN 'constraint' THEN concat('do $$ begin', chr(10), '  if not exists (select 1 from pg_constraint where conname = ', chr(39), name, chr(39), ') then', chr(10), '    ', bare, ';', chr(10), '  end if;', chr(10), 'end $$;') ELSE statement END"""
bound(
    "gn11",
    catalog.deploy_tables,
    "table_ddls fleet_servers",
    f"""
SELECT d.server_id, table_name, seq, CASE
 WHEN engine = 'oracle' AND kind = 'comment' THEN concat('begin', chr(10), '  execute immediate q', chr(39), '[', bare, ']', chr(39), ';', chr(10), 'end;', chr(10), '/')
 WHEN engine = 'oracle' THEN concat('begin', chr(10), '  for x in (select 1 from dual where not exists (select 1 from ', CASE kind WHEN 'table' THEN 'user_tables where table_name = ' WHEN 'index' THEN 'user_indexes where index_name = ' ELSE 'user_constraints where constraint_name = ' END, chr(39), CASE kind WHEN 'table' THEN table_name ELSE name END, chr(39), ')) loop', chr(10), '    execute immediate q', chr(39), '[', bare, ']', chr(39), ';', chr(10), '  end loop;', chr(10), 'end;', chr(10), '/')
 ELSE {_AGAIN} END AS block FROM deploy_parts d JOIN fleet_servers s ON s.server_id = d.server_id""",
)
VIEWS["sequence_ddls"] = """
SELECT CAST(s_suppkey % 5 AS INT) AS server_id, concat('SEQ_', s_suppkey) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'MATERIALIZED VIEW' WHEN 1 THEN 'TRIGGER' WHEN 2 THEN 'VIEW' ELSE 'SEQUENCE' END AS object_type,
 CASE s_suppkey % 4 WHEN 0 THEN concat('CREATE MATERIALIZED VIEW SEQ_', s_suppkey, ' AS SELECT 1 FROM dual;') WHEN 1 THEN concat('CREATE TRIGGER SEQ_', s_suppkey, ' x') WHEN 2 THEN 'CREATE OR REPLACE VIEW v AS SELECT 1'
  ELSE concat('CREATE SEQUENCE "APP"."SEQ_', s_suppkey, '"  START WITH ', s_nationkey + 7, ' INCREMENT BY 1   NOORDER  NOCYCLE noscale GLOBAL ;') END AS ddl FROM supplier"""
#: Definitions as a catalog gives them: sequences and others, and code objects with schemas, quotes and words that scripts leave out.
_CODE_DDL = {
    "PROCEDURE": ("concat('CREATE OR REPLACE EDITIONABLE PROCEDURE \"APP\".\"', name, '\" AS BEGIN EDITIONABLE; END;')", "concat('CREATE OR REPLACE PROCEDURE APP.\"', name, '\" AS BEGIN EDITIONABLE; END;')"),
    "PACKAGE BODY": ("concat('  CREATE NONEDITIONABLE  PACKAGE BODY \"', name, '\" AS', chr(10), 'x  ')", "concat('CREATE OR REPLACE PACKAGE BODY ', name, ' AS', chr(10), 'x')"),
    "VIEW": ("concat('CREATE OR REPLACE FORCE EDITIONABLE VIEW ', name, ' (a) AS SELECT 1')", "concat('CREATE OR REPLACE FORCE VIEW ', name, ' (a) AS SELECT 1')"),
    "SYNONYM": ("concat('create public synonym ', name, ' for app.x')", "concat('CREATE OR REPLACE PUBLIC SYNONYM ', name, ' for app.x')"),
    "FUNCTION": ("concat('-- ', name, ' is wrapped')", "concat('-- ', name, ' is wrapped')"),
}
_CODE_KIND = "CASE (ascii(substr(name, length(name), 1)) + length(name)) % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_CODE_DDL)) + " END"
VIEWS["raw_ddls"] = f"""
SELECT server_id, name, object_type, ddl FROM sequence_ddls WHERE object_type <> 'VIEW'
UNION ALL SELECT server_id, name, kind, CASE kind {" ".join(f"WHEN '{k}' THEN {raw}" for k, (raw, _) in _CODE_DDL.items())} END FROM (SELECT server_id, name, {_CODE_KIND} AS kind FROM objects) o"""
bound(
    "tx12",
    lambda d: d.select("server_id", "name", "object_type", heads.clean_definition("ddl", "object_type").alias("cleaned")),
    "raw_ddls",
    f"""SELECT server_id, name, object_type, CASE object_type {" ".join(f"WHEN '{k}' THEN {made}" for k, (_, made) in _CODE_DDL.items())}
 WHEN 'SEQUENCE' THEN concat('CREATE SEQUENCE ', name, ' START WITH 1 INCREMENT BY 1') WHEN 'TRIGGER' THEN replace(ddl, 'CREATE TRIGGER', 'CREATE OR REPLACE TRIGGER') ELSE trim(ddl) END AS cleaned FROM raw_ddls""",
)
bound(
    "gn11_objects",
    catalog.deploy_objects,
    "sequence_ddls fleet_servers",
    """
SELECT d.server_id, d.name, d.object_type, CASE
 WHEN s.engine = 'oracle' AND d.object_type IN ('SEQUENCE', 'MATERIALIZED VIEW') THEN concat('begin', chr(10), '  for x in (select 1 from dual where not exists (select 1 from ', CASE d.object_type WHEN 'SEQUENCE' THEN 'user_sequences where sequence_name' ELSE 'user_mviews where mview_name' END, ' = ', chr(39), d.name, chr(39), ')) loop', chr(10), '    execute immediate q', chr(39), '[', rtrim(d.ddl, ' ;'), ']', chr(39), ';', chr(10), '  end loop;', chr(10), 'end;', chr(10), '/')
 WHEN s.engine = 'oracle' THEN d.ddl WHEN d.object_type = 'SEQUENCE' THEN replace(trim(d.ddl), 'CREATE SEQUENCE', 'CREATE SEQUENCE IF NOT EXISTS') WHEN d.object_type = 'MATERIALIZED VIEW' THEN concat('DROP MATERIALIZED VIEW IF EXISTS ', d.name, ';', chr(10), d.ddl)
 WHEN d.object_type = 'TRIGGER' THEN replace(d.ddl, 'CREATE TRIGGER', 'CREATE OR REPLACE TRIGGER') ELSE d.ddl END AS script FROM sequence_ddls d JOIN fleet_servers s ON s.server_id = d.server_id""",
)
VIEWS["typed_columns"] = """
SELECT DISTINCT CASE l_linenumber % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'VARCHAR2' WHEN 2 THEN 'RAW' WHEN 3 THEN 'TIMESTAMP(6)' WHEN 4 THEN 'NUMBER' ELSE 'CHAR' END AS data_type, CASE WHEN l_tax > 0.05 THEN CAST(l_quantity AS INT) END AS data_length,
 CASE WHEN l_discount > 0.03 THEN CAST(l_quantity AS INT) END AS data_precision, CASE WHEN l_tax > 0.02 THEN CAST(l_linenumber % 3 AS INT) END AS data_scale, CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS INT) END AS char_length, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'B' END AS char_used FROM lineitem"""
bound(
    "tx5",
    lambda t: t.withColumn("shown", catalog.type_text("data_type", "data_length", "data_precision", "data_scale", "char_length", "char_used")),
    "typed_columns",
    """
SELECT *, CASE WHEN upper(data_type) = 'NUMBER' THEN concat('NUMBER', CASE WHEN data_precision IS NOT NULL AND data_scale > 0 THEN concat('(', data_precision, ',', data_scale, ')') WHEN data_precision IS NOT NULL THEN concat('(', data_precision, ')') WHEN data_scale > 0 THEN concat('(*,', data_scale, ')') ELSE '' END)
 WHEN data_type IN ('VARCHAR2', 'CHAR') AND char_used = 'C' THEN concat(data_type, coalesce('(' || char_length || ' CHAR)', '')) WHEN data_type IN ('VARCHAR2', 'CHAR', 'RAW') THEN concat(data_type, coalesce('(' || data_length || ')', '')) ELSE data_type END AS shown FROM typed_columns""",
)
VIEWS["file_ddls"] = """
SELECT 'table' AS object_type, CASE WHEN table_name LIKE '%2' THEN lower(table_name) ELSE table_name END AS name, CASE WHEN table_name LIKE '%7' THEN concat(ddl, ' -- changed') ELSE concat(replace(ddl, chr(10), concat(' ', chr(13), chr(10))), chr(10)) END AS ddl FROM table_ddls WHERE server_id = 1 AND table_name NOT LIKE '%9'
UNION ALL SELECT 'VIEW' AS object_type, concat('F_', s_suppkey) AS name, 'create view x' AS ddl FROM supplier"""
VIEWS["server_ddls"] = "SELECT 'TABLE' AS object_type, table_name AS name, ddl FROM table_ddls WHERE server_id = 1"
bound("jn13", catalog.object_drift, "server_ddls file_ddls", "SELECT 'TABLE' AS object_type, table_name AS name, CASE WHEN table_name LIKE '%9' THEN 'server only' WHEN table_name LIKE '%7' THEN 'different' ELSE 'equal' END AS status FROM table_ddls WHERE server_id = 1 UNION ALL SELECT 'VIEW', concat('F_', s_suppkey), 'file only' FROM supplier")

# ---------------------------------------------------------------- drift by another key

VIEWS["fleet_keyed"] = "SELECT server_id, table_name, column_name AS column_key, column_id, data_type, data_length, data_default, comments, index_name, CASE WHEN server_id = 2 AND column_id = 7 THEN concat(column_name, '_OLD') WHEN server_id = 3 THEN lower(column_name) ELSE column_name END AS column_name FROM fleet_columns"
_DIFFERENT = "\nUNION ALL ".join(attribute_rows(a, "fleet_keyed", "column_key") for a in ("column_name", *drift.ATTRIBUTES))
bound("jn4", lambda c, s: drift.compare(c, s, 0, tables=False, key="column_key").where("difference = 'DIFFERENT'"), "fleet_keyed fleet_servers", f"SELECT d.server_id, server_name, difference, element, table_name, column_name, details FROM ({_DIFFERENT}) d JOIN fleet_servers s ON s.server_id = d.server_id")

# ---------------------------------------------------------------- connections and policies

VIEWS["connections"] = """
SELECT CAST(s_suppkey AS INT) AS server_id, s_name AS server_name, CASE WHEN s_suppkey % 3 = 0 THEN 'postgres' ELSE 'oracle' END AS engine,
 CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 5 = 1 THEN ' ' ELSE n_name END AS group_name, CASE WHEN s_suppkey % 3 = 0 THEN 'app' ELSE 'APP' END AS schema_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_FLAG = "server_id % {} <> {} AS {}"
VIEWS["connection_policies"] = f"""
SELECT server_id AS connection_id, {_FLAG.format(2, 1, 'mcp_enabled')}, {_FLAG.format(3, 0, 'allow_schema_list')}, {_FLAG.format(5, 0, 'allow_ddl_read')}, {_FLAG.format(7, 0, 'allow_save_scripts')}, {_FLAG.format(11, 0, 'allow_compare_fix')}, {_FLAG.format(4, 2, 'allow_invalid_objects')}, {_FLAG.format(6, 4, 'allow_compare_object')},
 {_FLAG.format(10, 8, 'allow_raw_sql')}, {_FLAG.format(12, 0, 'allow_apply_ddl')}, CASE WHEN server_id % 8 < 6 THEN 'allowlist' ELSE 'none' END AS data_access, server_id * 37 AS max_rows, server_id % 700 AS query_timeout_secs, concat('agent_', repeat('x', server_id % 140)) AS account FROM connections WHERE server_id % 9 <> 0"""
VIEWS["connection_rules"] = """
SELECT DISTINCT CAST(l_suppkey AS INT) AS connection_id, CASE WHEN l_linenumber % 3 = 0 THEN 'deny' ELSE 'allow' END AS action,
 CASE l_linenumber WHEN 5 THEN concat(l_returnflag, ' x') WHEN 6 THEN repeat('AB', CAST(40 + l_quantity AS INT)) WHEN 2 THEN '' ELSE concat('T', l_partkey % 100, '*') END AS table_pattern,
 CASE l_linenumber WHEN 4 THEN 'C?' WHEN 7 THEN 'bad pattern!' ELSE '' END AS column_pattern FROM lineitem WHERE l_suppkey % 4 <> 3"""
VIEWS["connection_denies"] = "SELECT CAST(user_id % 20 AS INT) AS connection_id, CASE event_id % 3 WHEN 0 THEN '*' WHEN 1 THEN event_type ELSE 'a b' END AS object_type, CASE WHEN event_id % 4 = 0 THEN concat('T', event_id % 7, '?') ELSE props END AS name_pattern FROM events"
_NEEDS = {t: (reads, needs) for t, reads, needs in rules.TOOLS}
_MATRIX = " UNION ALL ".join(
    f"""SELECT connection_id, '{tool}' AS tool, CASE WHEN NOT mcp_enabled THEN 'mcp_disabled' {"WHEN data_access <> 'allowlist' THEN 'data_access_none'" if reads else ''} {f"WHEN NOT ({' AND '.join(needs)}) THEN 'policy_disabled'" if needs else ''}
 {{switch}} {"WHEN connection_id NOT IN (SELECT connection_id FROM connection_rules WHERE action = 'allow') THEN 'table_allowlist_empty'" if reads else ''} END AS reason_code, {"'" + ' and '.join(needs) + "'"} AS needs FROM connection_policies""".replace("{switch}", "WHEN {off} THEN 'kill_switch'" if reads else "")
    for tool, (reads, needs) in _NEEDS.items()
)
_CAPABLE = "SELECT connection_id, tool, reason_code IS NULL AS allowed, reason_code, CASE WHEN reason_code = 'policy_disabled' THEN needs END AS settings FROM ({}) m"
bound("fl9", rules.capability_matrix, "connection_policies connection_rules", _CAPABLE.format(_MATRIX.replace("{off}", "false")))
bound("fl9_switch", lambda p, r: rules.capability_matrix(p, r, True), "connection_policies connection_rules", _CAPABLE.format(_MATRIX.replace("{off}", "true")))
_OFF = ", ".join(f"coalesce(p.{f}, false) AS {f}" for f in rules.FLAGS)
bound("fl10", rules.with_default_policies, "connections connection_policies", f"SELECT s.server_id AS connection_id, {_OFF}, coalesce(p.data_access, 'none') AS data_access, greatest(1, least(10000, coalesce(p.max_rows, 200))) AS max_rows, greatest(1, least(600, coalesce(p.query_timeout_secs, 30))) AS query_timeout_secs FROM connections s LEFT JOIN connection_policies p ON p.connection_id = s.server_id")
_BAD = r"(octet_length(encode(trim({0}))) > 128 OR NOT regexp_matches(trim({0}), '^[\p{{L}}\p{{N}}_$#*?-]+$'))".format
bound(
    "fl11",
    rules.policy_violations,
    "connection_policies connection_rules connection_denies",
    f"""
SELECT connection_id, 'table rules' AS subject, CAST(count(*) AS VARCHAR) AS value, 'too many' AS violation FROM connection_rules GROUP BY connection_id HAVING count(*) > 500
UNION ALL SELECT connection_id, 'object rules', CAST(count(*) AS VARCHAR), 'too many' FROM connection_denies GROUP BY connection_id HAVING count(*) > 500
UNION ALL SELECT connection_id, 'table', table_pattern, 'bad pattern' FROM connection_rules WHERE {_BAD('table_pattern')}
UNION ALL SELECT connection_id, 'column', column_pattern, 'bad pattern' FROM connection_rules WHERE trim(column_pattern) <> '' AND {_BAD('column_pattern')}
UNION ALL SELECT connection_id, 'object', name_pattern, 'bad pattern' FROM connection_denies WHERE {_BAD('name_pattern')}
UNION ALL SELECT connection_id, 'type', object_type, 'bad type' FROM connection_denies WHERE trim(object_type) NOT IN ('*', '') AND {_BAD('object_type')}
UNION ALL SELECT connection_id, 'account', account, 'too long' FROM connection_policies WHERE length(account) > 128""",
)
_GROUPED = "SELECT coalesce(nullif(trim(group_name), ''), '{}') AS grp, count(*) AS n, count(DISTINCT engine) AS engines, string_agg(server_name, ', ' ORDER BY lower(server_name), server_name) AS servers FROM {} GROUP BY 1"
bound("ag6", rules.servers_by_group, "connections", _GROUPED.format("(no group)", "connections"))
bound("fl21", lambda c: rules.servers_by_group(c).select("grp", "engines", (F.col("engines") == 1).alias("ok")), "connections", f"SELECT grp, engines, engines = 1 AS ok FROM ({_GROUPED.format('(no group)', 'connections')}) g")
bound("fl24", lambda c: rules.servers_by_group(rules.search_servers(c, " nation_1"), "Default").unionByName(rules.servers_by_group(rules.search_servers(c, "ORA"), "Default")), "connections", _GROUPED.format("Default", "(SELECT * FROM connections WHERE contains(lower(concat_ws(chr(1), server_name, engine, group_name, schema_name)), 'nation_1')) a") + " UNION ALL " + _GROUPED.format("Default", "(SELECT * FROM connections WHERE contains(lower(concat_ws(chr(1), server_name, engine, group_name, schema_name)), 'ora')) b"))
VIEWS["column_requests"] = """
SELECT server_id AS connection_id, table_name, CASE WHEN min(column_id) % 2 = 0 OR table_name LIKE '%5' THEN NULL WHEN table_name LIKE '%4' THEN 'c2' WHEN table_name LIKE '%6' THEN 'C9' WHEN table_name LIKE '%8' THEN 'C7' ELSE 'C1' END AS asked FROM fleet_columns GROUP BY server_id, table_name"""
VIEWS["readable_rows"] = "SELECT c.server_id AS connection_id, c.table_name, c.column_name, coalesce(a.allowed, false) AS readable FROM fleet_columns c LEFT JOIN column_access a ON a.connection_id = c.server_id AND a.table_name = c.table_name AND a.column_name = c.column_name"
bound(
    "fl14",
    lambda c, a, ca, q: rules.readable_columns(c.withColumnRenamed("server_id", "connection_id"), a, ca, q),
    "fleet_columns access column_access column_requests",
    """
SELECT q.connection_id, q.table_name, q.asked, NULL AS column_name, 'table denied' AS verdict, 0 AS n_omitted FROM column_requests q LEFT JOIN access a ON a.connection_id = q.connection_id AND a.table_name = q.table_name WHERE NOT coalesce(a.allowed, false)
UNION ALL SELECT q.connection_id, q.table_name, q.asked, r.column_name, CASE WHEN r.column_name IS NULL THEN 'unknown column' WHEN r.readable THEN 'allowed' ELSE 'column denied' END, 0 FROM column_requests q JOIN access a ON a.connection_id = q.connection_id AND a.table_name = q.table_name AND a.allowed
 LEFT JOIN readable_rows r ON r.connection_id = q.connection_id AND r.table_name = q.table_name AND upper(r.column_name) = upper(q.asked) WHERE q.asked IS NOT NULL
UNION ALL SELECT q.connection_id, q.table_name, NULL, r.column_name, 'allowed', (SELECT count(*) FROM readable_rows o WHERE o.connection_id = q.connection_id AND o.table_name = q.table_name AND NOT o.readable) FROM column_requests q JOIN access a ON a.connection_id = q.connection_id AND a.table_name = q.table_name AND a.allowed
 JOIN readable_rows r ON r.connection_id = q.connection_id AND r.table_name = q.table_name AND r.readable WHERE q.asked IS NULL""",
)

VIEWS["table_requests"] = "SELECT DISTINCT concat(server_id, '/', table_name) AS request_id, server_id AS connection_id, table_name, CASE WHEN table_name LIKE '%1' THEN NULL WHEN table_name LIKE '%2' THEN 0 WHEN table_name LIKE '%3' THEN 20000 ELSE 50 END AS asked_limit FROM fleet_columns"
VIEWS["request_parts"] = """
SELECT concat(server_id, '/', table_name) AS request_id, 'column' AS part, column_id AS seq, CASE WHEN table_name LIKE '%4' THEN lower(column_name) ELSE column_name END AS asked FROM fleet_columns WHERE column_id % 2 = 1 AND table_name NOT LIKE '%5' AND table_name NOT LIKE '%9'
UNION ALL SELECT request_id, 'column', 99, 'C9' FROM table_requests WHERE table_name LIKE '%6' UNION ALL SELECT request_id, 'filter', 1, 'C1' FROM table_requests WHERE table_name NOT LIKE '%7'
UNION ALL SELECT request_id, 'filter', 2, ' c7 ' FROM table_requests WHERE table_name LIKE '%8' OR table_name LIKE '%5' UNION ALL SELECT request_id, 'order', 1, 'c2' FROM table_requests WHERE table_name LIKE '%9' OR table_name LIKE '%3'"""
bound(
    "fl14_query",
    lambda q, p, c, a, ca, po: rules.granted_queries(q, p, c.withColumnRenamed("server_id", "connection_id"), a, ca, po).select("request_id", "reason", F.array_join("columns", ",").alias("columns"), "n_omitted", "row_limit"),
    "table_requests request_parts fleet_columns access column_access policies",
    """
SELECT request_id, reason, CASE WHEN reason IS NULL THEN chosen END AS columns, CASE WHEN reason IS NULL AND n = 0 THEN hidden ELSE 0 END AS n_omitted, CASE WHEN reason IS NULL THEN greatest(1, least(coalesce(asked_limit, most), most)) END AS row_limit FROM (
 SELECT r.request_id, r.asked_limit, greatest(1, least(10000, coalesce(p.max_rows, 200))) AS most, coalesce(f.n, 0) AS n, e.hidden, CASE WHEN coalesce(f.n, 0) > 0 THEN f.chosen ELSE e.every END AS chosen,
  CASE WHEN NOT coalesce(a.allowed, false) THEN 'table denied' WHEN f.first IS NOT NULL THEN f.first WHEN coalesce(f.n, 0) = 0 AND e.every IS NULL THEN 'no column may be read' ELSE f.later END AS reason
 FROM table_requests r LEFT JOIN access a ON a.connection_id = r.connection_id AND a.table_name = r.table_name LEFT JOIN policies p ON p.connection_id = r.connection_id
 LEFT JOIN (SELECT c.connection_id, c.table_name, string_agg(c.column_name, ',' ORDER BY i.column_id) FILTER (readable) AS every, count(*) FILTER (NOT readable) AS hidden FROM readable_rows c JOIN fleet_columns i ON i.server_id = c.connection_id AND i.table_name = c.table_name AND i.column_name = c.column_name GROUP BY 1, 2) e
  ON e.connection_id = r.connection_id AND e.table_name = r.table_name
 LEFT JOIN (SELECT request_id, arg_min(fault, seq) FILTER (part = 'column' AND fault IS NOT NULL) AS first, arg_min(fault, concat(part, seq)) FILTER (part <> 'column' AND fault IS NOT NULL) AS later, count(*) FILTER (part = 'column') AS n, string_agg(column_name, ',' ORDER BY seq) FILTER (part = 'column') AS chosen
  FROM (SELECT q.*, c.column_name, CASE WHEN c.column_name IS NULL THEN concat('unknown column: ', trim(q.asked)) WHEN NOT c.readable THEN concat(q.part, ' denied: ', c.column_name) END AS fault FROM request_parts q JOIN table_requests r ON r.request_id = q.request_id
   LEFT JOIN readable_rows c ON c.connection_id = r.connection_id AND c.table_name = r.table_name AND upper(c.column_name) = upper(trim(q.asked))) j GROUP BY request_id) f ON f.request_id = r.request_id) v""",
    held="fleet_columns",
)
bound(
    "fl23_summary",
    lambda *views: rules.access_summary(*views),
    "objects policies policy_table_rules policy_object_deny fleet_servers",
    f"""
SELECT p.connection_id, count(o.name) FILTER (s.name IS NULL) AS n_hidden, count(*) FILTER (s.relation AND s.allowed AND NOT s.ruled) AS n_allowed, count(*) FILTER (s.relation AND s.allowed AND s.ruled) AS n_restricted, count(*) FILTER (s.relation AND NOT s.allowed) AS n_denied, count(*) FILTER (NOT s.relation) AS n_other,
 max(t.tools) AS tools FROM policies p LEFT JOIN objects o ON o.server_id = p.connection_id AND p.mcp_enabled AND p.allow_schema_list
LEFT JOIN (SELECT h.server_id, h.name, h.object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW') AS relation, coalesce(a.allowed, false) AS allowed, coalesce(a.column_rules, false) AS ruled FROM shown_objects h LEFT JOIN access a ON a.connection_id = h.server_id AND a.table_name = h.name) s ON s.server_id = o.server_id AND s.name = o.name
JOIN (SELECT connection_id, coalesce(string_agg(tool, ' ' ORDER BY tool) FILTER (reason_code IS NULL), '') AS tools FROM ({_MATRIX.replace("{off}", "false").replace("connection_policies", "policies").replace("connection_rules", "policy_table_rules")}) m GROUP BY connection_id) t ON t.connection_id = p.connection_id GROUP BY p.connection_id""",
)

# ---------------------------------------------------------------- SQL screening

VIEWS["logged_sql"] = """
SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'SELECT created_at, COUNT(*) FROM T1 WHERE a IN (1, 2)' WHEN 1 THEN concat('-- DROP x', chr(10), 'select upper(a), "pg_sleep"(1) from T2;') WHEN 2 THEN 'WITH q (a) AS (SELECT 1) SELECT sum(a) OVER (ORDER BY a) FROM q'
 WHEN 3 THEN 'DELETE FROM T1 WHERE a = ''drop(x)''' WHEN 4 THEN 'create table x (a int)' WHEN 5 THEN 'SELECT pg_sleep(1), my_func(2), my_func (3)' WHEN 6 THEN 'SELECT 1; SELECT 2' WHEN 7 THEN concat('SELECT ', event_id, ' /* ; update */ FROM "Update"')
 WHEN 8 THEN concat('SELECT ''', repeat('x', 20001), '''') WHEN 9 THEN 'SELECT utl_inaddr.get_host_name FROM dual' WHEN 10 THEN 'SELECT nvl(a, 0), date_trunc(b) INTO c FROM t' ELSE 'explain select 1' END AS sql_text FROM events"""
_FOUND = {
    1: [("blocked function", "PG_SLEEP")],
    3: [("start", "DELETE"), ("forbidden word", "DELETE")],
    4: [("start", "CREATE"), ("forbidden word", "CREATE"), ("forbidden word", "TABLE"), ("function not allowed", "X")],
    5: [("blocked function", "PG_SLEEP"), ("function not allowed", "MY_FUNC")],
    6: [("several statements", ";")],
    8: [("too long", "20010")],
    11: [("start", "EXPLAIN")],
}
_FOUND[9] = [("blocked function", "UTL_INADDR")]
_SCREENED = {e: _FOUND | {10: [("function not allowed", f), ("forbidden word", "INTO")]} for e, f in (("postgres", "NVL"), ("oracle", "DATE_TRUNC"))}
for _engine, _id in (("postgres", "fl22"), ("oracle", "fl22_oracle")):
    _rows = ", ".join(f"({k}, '{v}', '{t}')" for k, found in _SCREENED[_engine].items() for v, t in found)
    bound(_id, lambda q, e=_engine: sql_log.screen_sql(q, e), "logged_sql", f"SELECT event_id AS id, violation, token FROM events JOIN (VALUES {_rows}) AS v(k, violation, token) ON event_id % 12 = k")

# ---------------------------------------------------------------- repair

_Q = lambda c: f"concat(chr(34), replace({c}, chr(34), concat(chr(34), chr(34))), chr(34))"
_LIT = lambda c: f"concat(chr(39), replace({c}, chr(39), concat(chr(39), chr(39))), chr(39))"
_GUARD = lambda condition, statement: f"concat('BEGIN', chr(10), '  FOR x IN (SELECT 1 FROM dual WHERE ', {condition}, ') LOOP', chr(10), '    EXECUTE IMMEDIATE ', {_LIT(statement)}, ';', chr(10), '  END LOOP;', chr(10), 'END;', chr(10), '/')"
_HELD = lambda view, column, name, more="": f"concat('EXISTS (SELECT 1 FROM {view} WHERE {column} = ', {_LIT(f'upper(trim({name}))')}{more}, ')')"
_TYPE_OF = lambda r: f"concat(trim({r}.data_type), CASE WHEN coalesce(trim({r}.data_length), '') = '' THEN '' ELSE concat('(', trim({r}.data_length), ')') END)"
_DEFAULT_OF = lambda r: f"CASE WHEN coalesce(trim({r}.data_default), '') = '' THEN '' ELSE concat(' DEFAULT ', trim({r}.data_default)) END"
_COLUMN_HELD = lambda t, c: _HELD("user_tab_columns", "table_name", t, f", ' AND column_name = ', {_LIT(f'upper(trim({c}))')}")
_NOTE = lambda t, c, note: f"concat('COMMENT ON COLUMN ', {_Q(t)}, '.', {_Q(c)}, ' IS ', {_LIT(note)})"
_RANK_KIND = "CASE element WHEN 'TABLE' THEN 'missing_table' WHEN 'COLUMN' THEN 'missing_column' ELSE lower(element) END"
VIEWS["classified"] = f"SELECT *, {_RANK_KIND} AS kind FROM numbered"
fixtures.BUILDERS["classified"] = lambda spark, sf_dir: repair.classify(view(spark, sf_dir, "numbered"))
VIEWS["reference_ddls"] = "SELECT table_name, CASE WHEN table_name LIKE '%3' THEN ' ;/ ' ELSE ddl END AS ddl FROM table_ddls WHERE server_id = 0 AND table_name NOT LIKE '%1'"
VIEWS["reference_columns"] = f"""
SELECT table_name, string_agg(concat({_Q('column_name')}, ' ', {_TYPE_OF('c')}, {_DEFAULT_OF('c')}), ', ' ORDER BY column_name) AS defs,
 string_agg(CASE WHEN trim(comments) <> '' THEN concat(chr(10), chr(10), {_GUARD(_COLUMN_HELD('table_name', 'column_name'), _NOTE('table_name', 'column_name', 'trim(comments)'))}) END, '' ORDER BY column_name) AS oracle_notes,
 string_agg(CASE WHEN trim(comments) <> '' THEN concat(chr(10), {_NOTE('table_name', 'column_name', 'trim(comments)')}, ';') END, '' ORDER BY column_name) AS postgres_notes FROM fleet_columns c WHERE server_id = 0 GROUP BY table_name"""
_INDEX = f"concat({_Q('index_name')}, ' ON ', {_Q('table_name')}, ' (', columns, ')')"
VIEWS["reference_indexes"] = f"""
SELECT table_name, string_agg(concat(chr(10), chr(10), {_GUARD("concat('NOT ', " + _HELD('user_indexes', 'index_name', 'index_name') + ")", f"concat('CREATE INDEX ', {_INDEX})")}), '' ORDER BY index_name) AS oracle_indexes,
 string_agg(concat(chr(10), 'CREATE INDEX IF NOT EXISTS ', {_INDEX}, ';'), '' ORDER BY index_name) AS postgres_indexes FROM (
 SELECT table_name, trim(index_name) AS index_name, string_agg({_Q('column_name')}, ', ' ORDER BY column_name) AS columns FROM fleet_columns WHERE server_id = 0 AND trim(index_name) <> '' GROUP BY table_name, trim(index_name)) i GROUP BY table_name"""
_NO_TABLE = f"concat('NOT ', {_HELD('user_tables', 'table_name', 'c.table_name')})"
_WHY = "concat('-- the definition ', CASE WHEN d.table_name IS NULL THEN 'is not known' ELSE 'can' || chr(39) || 't run' END, ', so this one is made from the columns', chr(10))"
_SUFFIX = "coalesce(oracle_notes, ''), coalesce(oracle_indexes, '')"
VIEWS["created_tables"] = f"""
SELECT c.table_name, CASE WHEN rtrim(d.ddl, chr(10) || ' ;/') <> '' THEN concat({_GUARD(_NO_TABLE, 'p.bare')}, {_SUFFIX})
 ELSE concat({_WHY}, {_GUARD(_NO_TABLE, f"concat('CREATE TABLE ', {_Q('c.table_name')}, ' (', defs, ')')")}, {_SUFFIX}) END AS oracle,
 CASE WHEN rtrim(d.ddl, chr(10) || ' ;/') <> '' THEN (SELECT string_agg({_AGAIN}, chr(10) || chr(10) ORDER BY seq) FROM deploy_parts q WHERE q.server_id = 0 AND q.table_name = c.table_name)
 ELSE concat({_WHY}, 'CREATE TABLE IF NOT EXISTS ', {_Q('c.table_name')}, ' (', defs, ');', coalesce(postgres_notes, ''), coalesce(postgres_indexes, '')) END AS postgres
FROM reference_columns c LEFT JOIN reference_indexes i ON i.table_name = c.table_name LEFT JOIN reference_ddls d ON d.table_name = c.table_name LEFT JOIN deploy_parts p ON p.server_id = 0 AND p.seq = 1 AND p.table_name = c.table_name"""
_T, _C = _Q("d.table_name"), _Q("d.column_name")
_HERE = _COLUMN_HELD("d.table_name", "d.column_name")
_ALTER = f"'ALTER TABLE ', {_T}"
_SAID_NOTE = _NOTE("d.table_name", "d.column_name", "coalesce(trim(r.comments), '')")
_MADE = {
    ("missing_table", "oracle"): "f.oracle",
    ("missing_table", "postgres"): "f.postgres",
    ("missing_column", "oracle"): f"concat({_GUARD(f'concat({_HELD("user_tables", "table_name", "d.table_name")}, {chr(39)} AND NOT {chr(39)}, {_HERE})', f'concat({_ALTER}, {chr(39)} ADD ({chr(39)}, {_C}, {chr(39)} {chr(39)}, {_TYPE_OF("r")}, {_DEFAULT_OF("r")}, {chr(39)}){chr(39)})')}, CASE WHEN coalesce(trim(r.comments), '') = '' THEN '' ELSE concat(chr(10), chr(10), {_GUARD(_HERE, _SAID_NOTE)}) END)",
    ("missing_column", "postgres"): f"concat({_ALTER}, ' ADD COLUMN IF NOT EXISTS ', {_C}, ' ', {_TYPE_OF('r')}, {_DEFAULT_OF('r')}, ';', CASE WHEN coalesce(trim(r.comments), '') = '' THEN '' ELSE concat(chr(10), {_SAID_NOTE}, ';') END)",
    ("data_type", "oracle"): _GUARD(_HERE, f"concat({_ALTER}, ' MODIFY (', {_C}, ' ', {_TYPE_OF('r')}, ')')"),
    ("data_type", "postgres"): f"concat({_ALTER}, ' ALTER COLUMN ', {_C}, ' TYPE ', {_TYPE_OF('r')}, ' USING ', {_C}, '::', {_TYPE_OF('r')}, ';')",
    ("data_default", "oracle"): _GUARD(_HERE, f"concat({_ALTER}, ' MODIFY (', {_C}, ' DEFAULT ', coalesce(nullif(trim(r.data_default), ''), 'NULL'), ')')"),
    ("data_default", "postgres"): f"concat({_ALTER}, ' ALTER COLUMN ', {_C}, CASE WHEN coalesce(trim(r.data_default), '') = '' THEN ' DROP DEFAULT' ELSE concat(' SET DEFAULT ', trim(r.data_default)) END, ';')",
    ("comments", "oracle"): _GUARD(_HERE, _SAID_NOTE),
    ("comments", "postgres"): f"concat({_SAID_NOTE}, ';')",
}
_BY_KIND = "\n".join(f"WHEN replace(d.kind, 'data_length', 'data_type') = '{kind}' AND s.engine = '{engine}' THEN {made}" for (kind, engine), made in _MADE.items())
_SKIP = "CASE WHEN d.kind = 'index_name' THEN 'index composition is not known' WHEN d.kind = 'column_name' THEN 'a rename is unsafe' WHEN d.kind = 'missing_table' AND f.table_name IS NULL OR d.kind <> 'missing_table' AND r.table_name IS NULL THEN 'no reference metadata' END"
VIEWS["fix_rows"] = f"""
SELECT d.id, d.server_id AS target, d.table_name, d.column_name, d.kind, CASE WHEN {_SKIP} IS NOT NULL THEN NULL {_BY_KIND} END AS statement, {_SKIP} AS skip_reason
FROM classified d JOIN fleet_servers s ON s.server_id = d.server_id LEFT JOIN fleet_columns r ON r.server_id = 0 AND r.table_name = d.table_name AND r.column_name = d.column_name LEFT JOIN created_tables f ON f.table_name = d.table_name"""


def _fix_rows(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    with fixtures.once(spark, sf_dir, "fleet_columns"):  # the catalog is read for the comparison, table models, definitions and comments
        return repair.fix_rows(*(view(spark, sf_dir, v) for v in ("numbered", "fleet_columns", "fleet_servers", "reference_ddls")), 0, kinds)


fixtures.BUILDERS["fix_rows"] = _fix_rows
bound("gn1", lambda c: c.select("id", "kind"), "classified", "SELECT id, kind FROM classified")
VIEWS["seen_at"] = "SELECT id, difference, details, CASE WHEN id % 3 = 0 THEN 0 ELSE server_id END AS server_id FROM numbered"
bound("gn2", lambda d, s: repair.resolve_targets(d, s, 0).select("id", "target"), "seen_at fleet_servers", "SELECT d.id, CASE WHEN d.server_id <> 0 THEN d.server_id ELSE s.server_id END AS target FROM seen_at d LEFT JOIN fleet_servers s ON d.difference = 'MISSING' AND contains(d.details, concat('found in server ', upper(s.server_name), ' but not in reference server '))")
for _id, _kinds in (("gn3", ["missing_column"]), ("gn4", ["data_type", "data_length"]), ("gn5", ["data_default"]), ("gn6", ["comments"]), ("gn7", ["missing_table"])):
    bound(_id, lambda f, k=_kinds: f.where(F.col("kind").isin(*k)).select("id", "target", "statement"), "fix_rows", "SELECT id, target, statement FROM fix_rows WHERE kind IN ({})".format(", ".join(f"'{k}'" for k in _kinds)))
    QUERIES[_id] = lambda spark, sf_dir, k=_kinds: _fix_rows(spark, sf_dir, k).select("id", "target", "statement")  # work for other kinds is left out
bound("gn8", lambda f: f.where("skip_reason is not null").select("id", "target", "skip_reason"), "fix_rows", "SELECT id, target, skip_reason FROM fix_rows WHERE skip_reason IS NOT NULL")
bound(
    "gn9",
    lambda f, s: repair.script_blocks(f, s, 0),
    "fix_rows fleet_servers",
    """
SELECT DISTINCT target, 0 AS part, 0 AS id, concat('-- reference: alpha', chr(10), '-- target: ', server_name, chr(10), '-- review before it runs') AS block FROM fix_rows f JOIN fleet_servers s ON s.server_id = f.target
UNION ALL SELECT target, 1, min(id), concat('-- discrepancy #', min(id), chr(10), '-- table: ', table_name, chr(10), '-- column: ', CASE WHEN column_name = '' THEN '(table-level)' ELSE column_name END, chr(10), statement) FROM fix_rows WHERE statement IS NOT NULL GROUP BY target, table_name, column_name, kind, statement
UNION ALL SELECT target, 2, id, concat('-- #', id, ': ', skip_reason) FROM fix_rows WHERE skip_reason IS NOT NULL""",
)
bound("ag8", summary.fix_counts, "fix_rows", "SELECT target, sum(CASE WHEN statement IS NOT NULL THEN 1 ELSE 0 END) AS generated, sum(CASE WHEN skip_reason IS NOT NULL THEN 1 ELSE 0 END) AS skipped FROM fix_rows GROUP BY target")
bound("wn5", lambda f: summary.first_fixes(f.unionByName(f.where("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000))).select("id", "target", "kind"), "fix_rows", "SELECT id, target, kind FROM (SELECT *, row_number() OVER (PARTITION BY target, table_name, column_name, kind, statement ORDER BY id) AS rn FROM (SELECT * FROM fix_rows UNION ALL SELECT id + 1000000, target, table_name, column_name, kind, statement, skip_reason FROM fix_rows WHERE id % 7 = 0) u WHERE statement IS NOT NULL) x WHERE rn = 1")
