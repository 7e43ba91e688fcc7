"""Queries of large cells, scripts, files, logs and reports: operators bound to views of the test tables, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftframe.operators import lob, saves, sinks, sql_log, text
from driftframe.operators.shared import scratch
from driftframe.plans import fleet, surface  # noqa: F401  (views that this module reads)
from driftframe.plans.registry import ORACLE_SQL, QUERIES, bound
from driftframe.sources import fixtures, objects
from driftframe.sources.fixtures import VIEWS, view

# ---------------------------------------------------------------- large cells

#: First bytes of cells in hex, with the type that they make.
_HEADS = (("255044462D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("474946383961", "gif"), ("504B0304776F72642F", "docx"), ("504B0304786C2F", "xlsx"), ("504B03047070742F", "pptx"), ("504B0304", "zip"), ("1F8B", "gz"), ("00FF", "bin"),
          ("D0CF11E0A1B11AE1", "doc"), ("424D00", "bmp"), ("5249464600000000574542505650", "webp"), ("7B5C727466", "rtf"), ("424D", "txt"), ("5B315D20", "txt"))
fixtures.BUILDERS["cells"] = lambda spark, sf_dir: sinks.cells(*(view(spark, sf_dir, t) for t in ("customer", "documents", "pages")), tuple(h for h, _ in _HEADS))
_BLOB = "unhex(list_extract([{}], CAST(c_custkey % {} + 1 AS INT))) || encode(c_name)".format(", ".join(f"'{h}'" for h, _ in _HEADS), len(_HEADS))
_BLOB_KIND = "list_extract([{}], CAST(c_custkey % {} + 1 AS INT))".format(", ".join(f"'{k}'" for _, k in _HEADS), len(_HEADS))
_LOW = "lower(regexp_replace(substr(regexp_replace(t, '^\\s+', ''), 1, 1024), '^\\s+', ''))"
_TEXT_KIND = f"CASE WHEN {_LOW} LIKE '<svg%' OR {_LOW} LIKE '<?xml%<svg%' THEN 'svg' WHEN {_LOW} LIKE '<!doctype html%' OR {_LOW} LIKE '<html%' THEN 'html' WHEN {_LOW} LIKE '<%' THEN 'xml' WHEN regexp_matches({_LOW}, '^[\\[{{]') AND json_valid(t) THEN 'json' ELSE 'txt' END"
_HEX = "concat(substr(hex(b), 1, 80), CASE WHEN octet_length(b) > 40 THEN concat('… (', octet_length(b), ' bytes)') ELSE '' END)"
VIEWS["cells"] = f"""
SELECT doc_id AS row_id, 'TEXT' AS column_name, {_TEXT_KIND} AS mime, octet_length(encode(t)) AS n_bytes, sha256(t) AS digest, t AS shown FROM (SELECT doc_id, text AS t FROM documents) d
UNION ALL SELECT page_id, 'CLOB', {_TEXT_KIND}, octet_length(encode(t)), sha256(t), t FROM (SELECT page_id, html AS t FROM pages) p
UNION ALL SELECT c_custkey, 'BLOB', {_BLOB_KIND}, octet_length(b), sha256(b), CASE WHEN c_custkey % {len(_HEADS)} IN (1, 2, 8, 9, 10, 11, 12) THEN {_HEX} ELSE decode(b) END FROM (SELECT c_custkey, {_BLOB} AS b FROM customer) c"""
_OBJECTS = "SELECT concat('cells-', column_name, '-row', row_id) AS label, mime AS ext, n_bytes, digest AS sha256, substr(shown, 1, 200) AS preview FROM cells"
bound("sk8", lob.lob_objects, "cells", _OBJECTS)
_KEY = "concat('r_', substr(sha256(concat('cells-', column_name, '-row', row_id, ':', digest)), 1, 32))"


def _written_objects(cells):
    """Objects as written, and whether they read back as the same bytes."""
    path = scratch(cells.sparkSession)
    made = objects.write_objects(cells, path)
    held = objects.contents(made, path).select("id", F.sha2("bytes", 256).alias("held"))
    return made.join(objects.referenced(made), ["row_id", "column_name"]).join(held, "id", "left").select("label", "cell", "ext", "n_bytes", "sha256", F.sha2("preview", 256).alias("preview"), (F.col("held") == F.col("sha256")).alias("same"))


_TYPED = "CASE column_name WHEN 'TEXT' THEN 'TEXT' WHEN 'CLOB' THEN 'CLOB' ELSE 'BLOB' END"
bound("sk8_written", _written_objects, "cells", f"SELECT concat('cells-', column_name, '-row', row_id) AS label, concat('<', {_TYPED}, ' file ', {_KEY}, '>') AS cell, mime AS ext, n_bytes, digest AS sha256, CASE WHEN column_name <> 'BLOB' OR row_id % {len(_HEADS)} NOT IN (1, 2, 8, 9, 10, 11, 12) THEN sha256(substr(shown, 1, 200)) END AS preview, true AS same FROM cells")
bound("lb1", lambda c: c.groupBy("column_name", lob.sniff().alias("mime")).agg(F.count("*").alias("n")), "cells", "SELECT column_name, mime, count(*) AS n FROM cells GROUP BY column_name, mime")
bound("lb3", lambda c: c.select("row_id", "column_name", F.sha2(lob.display(), 256).alias("shown")), "cells", "SELECT row_id, column_name, sha256(shown) AS shown FROM cells")
bound("lb3_inline", lambda c: c.select("row_id", "column_name", lob.inline_cell().alias("cell")).select("row_id", "column_name", F.sha2("cell.shown", 256).alias("shown"), "cell.cut"), "cells", "SELECT row_id, column_name, sha256(substr(shown, 1, 4000)) AS shown, length(shown) > 4000 AS cut FROM cells")
bound("lb6", lob.profile, "cells", "SELECT column_name, mime, count(*) AS n, sum(n_bytes) AS n_bytes, max(n_bytes) AS longest, count(*) FILTER (WHERE n_bytes > 4000) AS n_over FROM cells GROUP BY column_name, mime")
#: A call reads a thousand rows, so what one group holds is bounded.
bound("lb5", lambda c: lob.capture(c.withColumn("call_id", F.floor(F.col("row_id") / 1000)), each=20_000, total=120_000), "cells", """
SELECT x.call_id, x.c.row_id AS row_id, x.c.column_name AS column_name, x.c.size AS size, x.c.reason IS NULL AS captured, x.c.reason AS reason FROM (
 SELECT call_id, unnest(list_reduce(list_prepend([{'row_id': CAST(NULL AS BIGINT), 'column_name': CAST(NULL AS VARCHAR), 'size': CAST(0 AS BIGINT), 'taken': CAST(0 AS BIGINT), 'used': CAST(0 AS BIGINT), 'reason': CAST(NULL AS VARCHAR)}],
  list_transform(cells, lambda x: [{'row_id': x.row_id, 'column_name': x.column_name, 'size': x.size, 'taken': CAST(0 AS BIGINT), 'used': CAST(0 AS BIGINT), 'reason': CAST(NULL AS VARCHAR)}])),
  lambda a, x: list_append(a, {'row_id': x[1].row_id, 'column_name': x[1].column_name, 'size': x[1].size,
   'taken': a[-1].taken + CASE WHEN a[-1].taken < 50 AND x[1].size <= 20000 AND a[-1].used + x[1].size <= 120000 THEN 1 ELSE 0 END,
   'used': a[-1].used + CASE WHEN a[-1].taken < 50 AND x[1].size <= 20000 AND a[-1].used + x[1].size <= 120000 THEN x[1].size ELSE 0 END,
   'reason': CASE WHEN a[-1].taken >= 50 THEN 'too many cells' WHEN x[1].size > 20000 THEN 'cell too large' WHEN a[-1].used + x[1].size > 120000 THEN 'total exceeded' END}))) AS c
 FROM (SELECT CAST(floor(row_id / 1000) AS BIGINT) AS call_id, list({'row_id': row_id, 'column_name': column_name, 'size': CAST(n_bytes AS BIGINT)} ORDER BY row_id, column_name) AS cells FROM cells GROUP BY 1) g) x WHERE x.c.row_id IS NOT NULL""")
QUERIES["ud2"], ORACLE_SQL["ud2"] = QUERIES["lb5"], ORACLE_SQL["lb5"]

# ---------------------------------------------------------------- scripts, previews and names

_BLOCKS = fleet.ORACLE_TEXT["gn9"]
VIEWS["script_rows"] = f"SELECT CASE part WHEN 0 THEN -1 - target ELSE id END AS doc_id, block AS text FROM ({_BLOCKS}) b"
fixtures.BUILDERS["script_rows"] = lambda spark, sf_dir: QUERIES["gn9"](spark, sf_dir).select(F.when(F.col("part") == 0, -1 - F.col("target")).otherwise(F.col("id")).cast("long").alias("doc_id"), F.col("block").alias("text"))
#: Heads in SQL: the words of a line, without those that may stand before a kind or a name.
_WORDS = "list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')"
_BARE = "list_filter(w[2:], lambda x: upper(x) NOT IN ('OR', 'REPLACE', 'EDITIONABLE', 'NONEDITIONABLE', 'GLOBAL', 'TEMPORARY', 'UNIQUE', 'MATERIALIZED', 'IF', 'NOT', 'EXISTS'))"
_MADE = "upper(b[1]) IN ('TABLE', 'INDEX', 'VIEW', 'PACKAGE', 'TYPE', 'SEQUENCE', 'PROCEDURE', 'FUNCTION', 'TRIGGER', 'SYNONYM')"
_FIRST = "regexp_extract({}, '^(\"[^\"]+\"|[A-Za-z0-9_$#]+)(\\.(\"[^\"]+\"|[A-Za-z0-9_$#]+))?', 0)"
_HEADED = f"""SELECT doc_id, line_no, CASE
 WHEN upper(w[1]) = 'CREATE' AND {_MADE} THEN {{'kind': upper(b[1]), 'name': {_FIRST.format("b[2]")}}}
 WHEN upper(w[1]) = 'ALTER' AND upper(w[2]) = 'TABLE' THEN {{'kind': 'ALTER TABLE', 'name': {_FIRST.format("w[3]")}}}
 WHEN upper(w[1]) IN ('PROCEDURE', 'FUNCTION') THEN {{'kind': upper(w[1]), 'name': {_FIRST.format("w[2]")}}}
 WHEN w[1] = '--' AND lower(w[2]) IN ('target:', 'table:') THEN {{'kind': upper(rtrim(w[2], ':')), 'name': trim(substr(line, strpos(line, ':') + 1))}} END AS head
 FROM (SELECT *, {_BARE} AS b FROM (SELECT *, {_WORDS} AS w FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM script_rows) l) m) n"""
bound("tx14", lambda s: text.outline(text.text_lines(s)), "script_rows", f"SELECT doc_id, CAST(line_no AS INT) AS line_no, head.kind AS kind, head.name AS name, false AS truncated FROM ({_HEADED}) h WHERE head.name <> ''")
bound("tx14_capped", lambda t: text.outline(t.withColumn("line", F.concat(F.lit("alter table "), F.regexp_replace("line", "[^A-Za-z]", ""))), 2), "text_lines", "SELECT doc_id, line_no, 'ALTER TABLE' AS kind, name, n > 2 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS at_, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, line_no, CASE WHEN length(r) > 2000 THEN concat(substr(r, 1, 2000), '…') ELSE r END AS name FROM (SELECT doc_id, line_no, regexp_replace(line, '[^A-Za-z]', '', 'g') AS r FROM text_lines) x WHERE r <> '') y) z WHERE at_ <= 2")
_CUT = "CASE WHEN length(line) > 2000 THEN concat(substr(line, 1, 2000), '…') ELSE line END"
bound("tx15", text.preview, "text_lines", f"SELECT doc_id, coalesce(string_agg(concat(line, chr(10)), '' ORDER BY line_no) FILTER (bytes <= 4096), '') AS preview FROM (SELECT doc_id, line_no, line, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS bytes FROM (SELECT doc_id, line_no, {_CUT} AS line FROM text_lines WHERE line_no <= 40) c) r GROUP BY doc_id")
bound("tx8", lambda d: d.select("doc_id", text.clipped("text", 500).alias("shown"), text.bounded("text").alias("b")).select("doc_id", "shown", F.coalesce("b.truncated", F.lit(False)).alias("truncated"), "b.original_bytes", "b.sha256", "b.preview"), "documents", "SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '…') ELSE text END AS shown, n > 16000 AS truncated, CASE WHEN n > 16000 THEN n END AS original_bytes, CASE WHEN n > 16000 THEN sha256(text) END AS sha256, CASE WHEN n > 16000 THEN concat(substr(text, 1, 2000), CASE WHEN length(text) > 2000 THEN '…' ELSE '' END) END AS preview FROM (SELECT *, octet_length(encode(text)) AS n FROM documents) d")
VIEWS["packages"] = """
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('  CREATE  OR REPLACE package p', event_id, ' as end;', chr(10), ' / ', chr(10)) WHEN 1 THEN 'create editionable package q as end;' WHEN 2 THEN '/' ELSE concat('create package body_x as end', chr(10), '  /') END AS spec,
 CASE event_id % 3 WHEN 0 THEN 'create or replace package body p as end;' WHEN 1 THEN concat('select 1 / 2', chr(10)) ELSE concat('CREATE PACKAGE', chr(10), 'BODY p as end;') END AS body FROM events"""
_SPEC = "CASE id % 4 WHEN 0 THEN concat('CREATE  OR REPLACE package p', id, ' as end;') WHEN 1 THEN spec WHEN 2 THEN '' ELSE 'create package body_x as end' END"
bound("tx22", lambda p: p.withColumn("combined", text.combine_package("spec", "body")).select("id", "combined", text.has_spec_and_body("combined").alias("both")), "packages", f"SELECT id, concat({_SPEC}, chr(10), '/', chr(10), chr(10), rtrim(body, chr(10)), chr(10), '/', chr(10)) AS combined, id % 4 <> 2 AND id % 3 <> 1 AS both FROM packages")
VIEWS["named_saves"] = """
SELECT DISTINCT server_id, table_name AS object, CASE WHEN server_id = 3 THEN '' ELSE '20240131' END AS day, CASE WHEN server_id = 4 THEN '' ELSE 'APP' END AS owner, CASE WHEN table_name LIKE '%5' THEN ' ' WHEN table_name LIKE '%6' THEN 'a/b' WHEN table_name LIKE '%7' THEN 'x..y' ELSE lower(table_name) END AS description,
 CASE WHEN table_name LIKE '%8' THEN '' ELSE '..sql' END AS ending FROM fleet_columns UNION ALL SELECT DISTINCT -1, CASE s_suppkey % 3 WHEN 0 THEN 'con' WHEN 1 THEN 'LPT1' ELSE 'COM0' END, '', '', '', 'sql' FROM supplier"""
_BADNAME = "CASE WHEN f = '' THEN 'empty' WHEN regexp_matches(f, '[^\\p{L}\\p{N}_\\-$#. ]') THEN 'bad character' WHEN contains(f, '..') OR f LIKE '.%' OR f LIKE '%.' THEN 'dots' WHEN regexp_matches(f, '(?i)^(con|prn|aux|nul|(com|lpt)[1-9])(\\.|$)') THEN 'reserved' END"
_D, _X = "trim(description)", "CASE WHEN ending = '' THEN '' ELSE '.sql' END"
bound(
    "tx18",
    lambda s: s.withColumn("f", F.when(F.col("server_id") >= 0, text.file_name("{date}_{schema}${description}{ext}", {"date": F.col("day"), "schema": F.col("owner"), "description": F.col("description"), "ext": F.col("ending")})).otherwise(text.file_name("{object}.{ext}", {"object": F.col("object"), "ext": F.col("ending")}))).select("server_id", "object", F.col("f").alias("file_name"), text.bad_file_name(F.col("f")).alias("violation")),
    "named_saves",
    f"""SELECT server_id, object, f AS file_name, {_BADNAME} AS violation FROM (SELECT server_id, object, CASE WHEN server_id < 0 THEN concat(object, '.sql')
 ELSE concat(CASE WHEN owner = '' THEN CASE WHEN {_D} = '' THEN day ELSE concat(day, CASE WHEN day = '' THEN '' ELSE '$' END, {_D}) END ELSE concat(day, CASE WHEN day = '' THEN '' ELSE '_' END, lower(owner), CASE WHEN {_D} = '' THEN '' ELSE concat('$', {_D}) END) END, {_X}) END AS f FROM named_saves) n""",
)
VIEWS["planned"] = "SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) WHEN doc_id % 4 = 1 THEN concat(text, chr(13), chr(10), 'x', chr(10)) ELSE text END AS content FROM documents"
VIEWS["existing_files"] = "SELECT path, CASE WHEN path % 5 = 0 THEN content WHEN path % 5 = 1 THEN concat('first', chr(10), content) ELSE concat(substr(content, 1, 50), chr(10), 'end', chr(10), 'end') END AS content FROM planned WHERE path % 3 <> 0"
_LF = "list_transform(string_split(replace({}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: x)"
bound(
    "tx26",
    text.plan_summary,
    "planned existing_files",
    f"""
SELECT p.path, e.path IS NOT NULL AS overwrites, octet_length(encode(p.content)) AS size, sha256(p.content) AS sha256, len(string_split(p.content, chr(10))) AS n_lines,
 CASE WHEN NOT contains(p.content, chr(10)) THEN 'none' WHEN NOT contains(p.content, chr(13) || chr(10)) THEN 'lf' WHEN length(p.content) - length(replace(p.content, chr(10), '')) = (length(p.content) - length(replace(p.content, chr(13) || chr(10), ''))) / 2 THEN 'crlf' ELSE 'mixed' END AS line_ending,
 c.added, c.removed, p.content = e.content AS identical, octet_length(encode(e.content)) AS existing_size FROM planned p LEFT JOIN existing_files e ON e.path = p.path
LEFT JOIN (SELECT path, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM (SELECT path, line, sum(n) AS n FROM (
 SELECT p.path, unnest({_LF.format('p.content')}) AS line, 1 AS n FROM planned p JOIN existing_files e ON e.path = p.path UNION ALL SELECT path, unnest({_LF.format('content')}), -1 FROM existing_files) l GROUP BY path, line) m GROUP BY path) c ON c.path = p.path""",
)

# ---------------------------------------------------------------- reports, files, logs

_JSON = """concat('{"difference":"', difference, '","element":"', element, '","table":"', table_name, '","column":"', column_name, '","server_id":', server_id, ',"server":"', server_name, '","details":"', details, '"}')"""
bound(
    "sk6",
    sinks.discrepancy_report,
    "discrepancies",
    f"""
SELECT 'lines' AS part, CAST(NULL AS VARCHAR) AS key, {_JSON} AS line FROM discrepancies
UNION ALL SELECT 'sample', NULL, {_JSON} FROM (SELECT * FROM discrepancies ORDER BY table_name, server_id, element, column_name LIMIT 20) s
UNION ALL SELECT 'by difference', difference, CAST(count(*) AS VARCHAR) FROM discrepancies GROUP BY difference
UNION ALL SELECT 'tables', NULL, CAST(count(DISTINCT table_name) AS VARCHAR) FROM discrepancies
UNION ALL SELECT 'top tables', table_name, CAST(n AS VARCHAR) FROM (SELECT table_name, count(*) AS n FROM discrepancies GROUP BY table_name ORDER BY n DESC, table_name LIMIT 50) t""",
    held="discrepancies",
)
VIEWS["saved_objects"] = """
SELECT CASE server_id WHEN 0 THEN 'APP' WHEN 1 THEN 'Sales' ELSE concat('S', server_id) END AS schema_name, 'TABLE' AS object_type, table_name AS name, ddl FROM table_ddls
UNION ALL SELECT CASE server_id WHEN 0 THEN 'APP' WHEN 1 THEN 'Sales' ELSE 'S2' END, object_type, name, ddl FROM sequence_ddls"""
VIEWS["save_defaults"] = "SELECT object_type, CASE object_type WHEN 'TABLE' THEN 'both' WHEN 'SEQUENCE' THEN 'code' WHEN 'VIEW' THEN ' ' ELSE 'migration' END AS storage_mode, CASE WHEN object_type = 'TABLE' THEN '.tab' ELSE '' END AS extension, '' AS folder FROM (SELECT DISTINCT object_type FROM saved_objects) t"
VIEWS["save_overrides"] = "SELECT DISTINCT lower(schema_name) AS schema_name, CASE WHEN schema_name = 'APP' THEN '' WHEN schema_name = 'Sales' THEN 'TABLE' ELSE 'VIEW' END AS object_type, CASE WHEN schema_name = 'Sales' THEN 'code' ELSE '' END AS storage_mode, CASE WHEN schema_name = 'S2' THEN 'vw' ELSE '' END AS extension, CASE WHEN schema_name = 'APP' THEN 'main' ELSE '' END AS folder FROM saved_objects"
VIEWS["saved_files"] = "SELECT 'main/app/migration' AS path, concat('V', event_id % 40, '__app_x.sql') AS name FROM events UNION ALL SELECT 'sql/sales/code', concat(lower(table_name), '.tab') FROM table_ddls WHERE server_id = 1 AND table_name LIKE '%3'"
_OPTION = lambda c, usual: f"coalesce(nullif(trim(o.{c}), ''), nullif(trim(a.{c}), ''), nullif(trim(d.{c}), ''), '{usual}')"
bound(
    "sk9",
    sinks.plan_files,
    "saved_objects save_defaults save_overrides saved_files",
    f"""
SELECT k.kind, k.path, k.name, k.sha256, EXISTS (SELECT 1 FROM saved_files f WHERE f.path = k.path AND f.name = k.name) AS exists FROM (
 SELECT kind, path, concat(CASE WHEN kind = 'migration' THEN concat('V', coalesce((SELECT max(CAST(nullif(regexp_extract(f.name, '^V([0-9]+)__', 1), '') AS INT)) + 1 FROM saved_files f WHERE f.path = r.path), 1), '__', schema_low, '_') ELSE '' END, lower(name), '.', ltrim(extension, '.')) AS name, sha256 FROM (
  SELECT v.kind, concat_ws('/', {_OPTION('folder', 'sql')}, lower(s.schema_name), v.kind) AS path, lower(s.schema_name) AS schema_low, s.name, {_OPTION('extension', 'sql')} AS extension, sha256(s.ddl) AS sha256
  FROM saved_objects s LEFT JOIN save_defaults d ON d.object_type = s.object_type LEFT JOIN save_overrides o ON o.object_type = s.object_type AND o.schema_name = lower(s.schema_name) LEFT JOIN save_overrides a ON a.object_type = '' AND a.schema_name = lower(s.schema_name)
  JOIN (VALUES ('code'), ('migration')) AS v(kind) ON {_OPTION('storage_mode', 'both')} NOT IN ('code', 'migration') OR {_OPTION('storage_mode', 'both')} = v.kind) r) k""",
)
VIEWS["plan_objects"] = """
SELECT concat(server_id, '/', table_name) AS object_id, 'oracle' AS engine, CASE server_id WHEN 0 THEN 'APP' WHEN 1 THEN 'Sales' WHEN 2 THEN 'Hr' ELSE 'Ops' END AS schema_name, CASE WHEN table_name LIKE '%7' THEN 'view' ELSE 'TABLE' END AS object_type, table_name AS name,
 CASE WHEN table_name LIKE '%3' THEN 'first_cut' ELSE ' ' END AS description, ddl, CASE WHEN table_name NOT LIKE '%5' THEN concat('-- deploy', chr(10), ddl) END AS deploy FROM table_ddls"""
VIEWS["plan_files"] = """
SELECT '/srv/app/migration' AS path, concat('V', event_id % 40, '__app_x.sql') AS name FROM events UNION ALL SELECT '/srv/app/migration/old', concat('V', max(event_id), '__x.sql') FROM events UNION ALL SELECT 'db/ops/migration/new', 'a.sql' FROM region
UNION ALL SELECT 'db/sales/migration/2.1', concat('table_', table_name, '.tab') FROM table_ddls WHERE server_id = 1 AND table_name LIKE '%3'"""
_OVERRIDES = """
SELECT o.*, if(schema_name = 'App', map('VIEW', 'code'), if(schema_name = 'hr', map('TABLE', 'migration'), NULL)) AS storage_modes, if(schema_name = 'sales', map('TABLE', '.tab'), NULL) AS extensions FROM VALUES
 ('App', '/srv/app', '', ' ', 'flyway', '', NULL, '', 'crlf'), ('sales', ' ', 'src', '', 'flyway', '{type}_{object}{ext}', 'version', ' 2.1 ', ''), ('hr', '', NULL, 'mig', '', '{nope}', '', '', 'lf')
 AS o(schema_name, folder_path, code_folder, migration_folder, naming_convention, naming_template, folder_mode, version_label, line_endings)"""
_TYPES = "SELECT * FROM VALUES ('TABLE', 'both', 'sql'), ('VIEW', 'migration', '') AS t(object_type, storage_mode, extension)"
_CRLF = "replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), chr(10), concat(chr(13), chr(10)))"
_LF_ONLY = "regexp_replace({}, '\\r\\n?', chr(10), 'g')"
_SAVED = "CASE low WHEN 'app' THEN {} WHEN 'hr' THEN {} ELSE {} END".format(_CRLF.format("content"), _LF_ONLY.format("content"), "content")
bound(
    "sk9_plan",
    lambda o, e: saves.save_plan(o, o.sparkSession.sql(_TYPES), o.sparkSession.sql(_OVERRIDES), e, "2024-03-05 14:07:00", "db").drop("content"),
    "plan_objects plan_files",
    f"""
SELECT object_id, kind, path, name, sha256({_SAVED}) AS sha256, EXISTS (SELECT 1 FROM plan_files f WHERE f.path = p.path AND f.name = p.name) AS exists, CASE WHEN name IS NULL THEN 'bad template' END AS violation FROM (
 SELECT object_id, low, 'code' AS kind, ddl AS content, CASE low WHEN 'app' THEN '/srv/app/code/app' WHEN 'sales' THEN 'db/sales/src/sales' ELSE 'db/ops/code/ops' END AS path,
  concat(CASE WHEN low IN ('app', 'sales') THEN 'R__' ELSE '' END, name, CASE WHEN object_type = 'view' THEN '' WHEN low = 'sales' THEN '.tab' ELSE '.sql' END) AS name FROM (SELECT *, lower(schema_name) AS low FROM plan_objects) c WHERE low <> 'hr' AND (object_type = 'TABLE' OR low = 'app')
 UNION ALL SELECT object_id, low, 'migration', coalesce(deploy, ddl), CASE low WHEN 'app' THEN '/srv/app/migration' WHEN 'sales' THEN 'db/sales/migration/2.1' WHEN 'hr' THEN 'db/hr/mig' ELSE 'db/ops/migration/new' END,
  CASE low WHEN 'app' THEN concat('V', greatest((SELECT max(event_id) FROM events), 39) + 1, '__app_', said, ext) WHEN 'sales' THEN concat(lower(object_type), '_', name, CASE WHEN ext = '' THEN '' ELSE '.tab' END) WHEN 'ops' THEN concat('240305_1407_ops$', said, ext) END
 FROM (SELECT *, lower(schema_name) AS low, CASE WHEN trim(description) = '' THEN name ELSE description END AS said, CASE WHEN object_type = 'view' THEN '' ELSE '.sql' END AS ext FROM plan_objects) m WHERE NOT (low = 'app' AND object_type = 'view')) p""",
    held="table_ddls",
)
bound("wn2", lambda q: sql_log.drop_repeats(q.select("id", "sql_text")), "query_log", "SELECT id, sql_text FROM (SELECT id, sql_text, lag(sql_text) OVER (ORDER BY id) AS prev FROM query_log) q WHERE prev IS NULL OR prev <> sql_text")
_BYTES = "length(CAST(c_custkey AS VARCHAR)) + 2 + length(c_name) + 2"
bound("wn3", lambda c: sinks.byte_capped(c.select("c_custkey", "c_name"), "c_custkey", 20_000), "customer", f"SELECT c_custkey, c_name, running_bytes, total > 20000 AS truncated FROM (SELECT c_custkey, c_name, CAST(sum({_BYTES}) OVER (ORDER BY c_custkey) AS BIGINT) AS running_bytes, sum({_BYTES}) OVER () AS total FROM customer) r WHERE running_bytes <= 20000")
VIEWS["described_log"] = "SELECT *, CASE WHEN id % 3 = 0 THEN 'Counts rows' END AS description FROM query_log"
bound("fl18", lambda q: sql_log.filter_log(q, " COUNT", "select", days=7, now="2024-01-28 12:00:00").union(sql_log.filter_log(q, favorites=True, days=0, now="2024-01-28 12:00:00")).select("id", "favorite"), "described_log", "SELECT id, favorite FROM described_log WHERE (contains(lower(sql_text), 'count') OR contains(lower(description), 'count')) AND regexp_matches(sql_text, '(?i)^(--[^\\n]*\\n)?\\s*(select|with)') AND created_at >= CAST('2024-01-21 12:00:00' AS TIMESTAMP) UNION ALL SELECT id, favorite FROM described_log WHERE favorite AND created_at >= CAST('2024-01-28' AS TIMESTAMP)")
VIEWS["filter_specs"] = """
SELECT user_id AS spec_id, CASE event_id % 9 WHEN 0 THEN 'a b' WHEN 1 THEN '' WHEN 2 THEN concat('c', repeat('x', 128)) ELSE concat('c$', event_id % 3) END AS column_name, CASE event_id % 6 WHEN 0 THEN 'in' WHEN 1 THEN 'eq' WHEN 2 THEN 'is_null' WHEN 3 THEN 'or' WHEN 4 THEN 'like' ELSE 'ge' END AS op,
 CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN repeat('v', 4001) ELSE props END AS value, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 101 END AS n_values FROM events"""
bound(
    "fl13",
    sinks.spec_violations,
    "filter_specs",
    """
SELECT DISTINCT spec_id, 'bad identifier' AS violation FROM filter_specs WHERE NOT regexp_full_match(column_name, '[A-Za-z_][A-Za-z0-9_$#]{0,127}') UNION SELECT spec_id, 'unknown operator' FROM filter_specs WHERE op = 'or'
UNION SELECT spec_id, 'wrong shape' FROM filter_specs WHERE op <> 'or' AND (op = 'in') <> (n_values IS NOT NULL) UNION SELECT spec_id, 'wrong number of values' FROM filter_specs WHERE op = 'in' AND n_values IN (0, 101)
UNION SELECT spec_id, 'no value' FROM filter_specs WHERE op IN ('in', 'eq', 'like', 'ge') AND n_values IS NULL AND value IS NULL UNION SELECT spec_id, 'value too long' FROM filter_specs WHERE length(value) > 4000
UNION SELECT spec_id, 'too many filters' FROM filter_specs GROUP BY spec_id HAVING count(*) > 20""",
)
