"""Operators of drift, rules, repair, audit and text on small tables, and all queries against DuckDB."""

import datetime
import decimal
import hashlib
import json
import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from driftframe.operators import audit, drift, heads, lob, repair, rules, saves, shared, sinks, sql_log, text
from driftframe.plans import content, dialects, fleet, registry, surface  # noqa: F401
from driftframe.sources import fanout, objects
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COLUMNS = "server_id int, table_name string, column_name string, column_id int, data_type string, data_length string, data_default string, comments string, index_name string"


def catalog(spark, rows):
    return spark.createDataFrame([(s, t, c, 1, *(list(a) + [None] * (5 - len(a)))) for s, t, c, a in rows], COLUMNS)


@pytest.fixture(scope="module")
def servers(spark):
    return spark.createDataFrame([(0, "Ref", "oracle"), (1, "Tgt", "oracle")], "server_id int, server_name string, engine string")


def compared(spark, servers, rows, **flags):
    return sorted((r.difference, r.element, r.table_name, r.column_name, r.details) for r in drift.compare(catalog(spark, rows), servers, 0, **flags).collect())


def test_a_missing_table_has_no_column_rows(spark, servers):
    got = compared(spark, servers, [(0, "T", "A", ("NUMBER",)), (0, "T", "B", ("NUMBER",)), (0, "S", "A", ("DATE",)), (1, "S", "A", ("DATE",))])
    assert got == [("MISSING", "TABLE", "T", "", "Table found in reference server REF but not in server TGT")]


def test_an_extra_table_and_column(spark, servers):
    got = compared(spark, servers, [(0, "S", "A", ("DATE",)), (1, "S", "A", ("DATE",)), (1, "S", "X", ("DATE",)), (1, "Z", "A", ("DATE",))])
    assert got == [
        ("MISSING", "COLUMN", "S", "X", "Column X found in server TGT but not in reference server REF"),
        ("MISSING", "TABLE", "Z", "", "Table Z found in server TGT but not in reference server REF"),
    ]


def test_values_are_blind_to_case_and_null_safe(spark, servers):
    same = [(0, "T", "A", ("varchar2", None, "x", "C", None)), (1, "T", "A", ("VARCHAR2", None, "X", "c", None))]
    assert compared(spark, servers, same) == []
    differ = [(0, "T", "A", ("VARCHAR2", "50")), (1, "T", "A", ("VARCHAR2", "30", "0"))]
    assert compared(spark, servers, differ) == [("DIFFERENT", "DATA_DEFAULT", "T", "A", "DATA_DEFAULT: NULL != 0"), ("DIFFERENT", "DATA_LENGTH", "T", "A", "VARCHAR2(50) != VARCHAR2(30)")]


def test_two_real_indexes_never_differ(spark, servers):
    two = lambda a, b: [(0, "T", "A", ("X", None, None, None, a)), (1, "T", "A", ("X", None, None, None, b))]
    assert compared(spark, servers, two("I1", "I2")) == []
    assert len(compared(spark, servers, two("I1", None))) == 1
    assert len(compared(spark, servers, two("none", "I1"))) == 1


def test_names_match_with_case_and_flags_gate(spark, servers):
    rows = [(0, "T", "A", ("X",)), (1, "t", "A", ("X",))]
    assert [r[1] for r in compared(spark, servers, rows)] == ["TABLE", "TABLE"]
    assert compared(spark, servers, rows, tables=False) == []
    noted = [(0, "T", "A", ("X", None, None, "a")), (1, "T", "A", ("X", None, None, "b"))]
    assert compared(spark, servers, noted, comments=False) == []


def test_applied_fixes_leave_no_difference(spark, servers):
    rows = [(0, "T", "A", ("NUMBER", "5")), (0, "T", "B", ("DATE",)), (1, "T", "A", ("NUMBER", "4"))]
    before = compared(spark, servers, rows)
    fixed = [r for r in rows if r[0] == 0] + [(1, t, c, a) for s, t, c, a in rows if s == 0]
    assert len(before) == 2 and compared(spark, servers, fixed) == []


def test_a_server_without_rows_lacks_all_tables(spark, servers):
    more = servers.union(spark.createDataFrame([(2, "Empty", "oracle")], servers.schema))
    rows = [(0, "T", "A", ("X",)), (0, "S", "A", ("X",)), (1, "T", "A", ("X",)), (1, "S", "A", ("X",))]
    got = sorted((r.server_name, r.element, r.table_name) for r in drift.compare(catalog(spark, rows), more, 0).collect())
    assert got == [("Empty", "TABLE", "S"), ("Empty", "TABLE", "T")]
    assert sorted(map(tuple, drift.missing_tables(catalog(spark, rows), more, 0).collect())) == [(2, "S", "absent"), (2, "T", "absent")]
    for call in (drift.compare, drift.missing_tables):
        with pytest.raises(ValueError, match="reference server 9"):
            call(catalog(spark, rows), more, 9)


def test_a_column_of_another_name(spark, servers):
    rows = catalog(spark, [(0, "T", "Ab", ("X",)), (1, "T", "aB", ("X",)), (0, "T", "C", ("X",)), (1, "T", "D", ("X",))]).withColumn("place", F.when(F.col("column_name").isin("Ab", "aB"), "1").otherwise("2"))
    got = [(r.element, r.column_name, r.details) for r in drift.compare(rows, servers, 0, key="place").collect()]
    assert got == [("COLUMN_NAME", "2", "COLUMN_NAME: C != D")]


def test_repairs_look_before_they_alter(spark, servers):
    """An Oracle column is added where the table is and the column isn't, with its comment; what can't be repaired says why."""
    rows = [(0, "T", "A", ("NUMBER", "5", None, "it's", "I1")), (0, "T", "B", ("DATE",)), (0, "U", "A", ("DATE",)), (1, "T", "B", ("DATE", None, None, None, "I2")), (1, "X", "A", ("DATE",))]
    fleet = catalog(spark, rows)
    fixes = repair.fix_rows(drift.numbered(drift.compare(fleet, servers, 0)), fleet, servers, spark.createDataFrame([], "table_name string, ddl string"), 0)
    got = {(r.table_name, r.kind): r for r in fixes.collect()}
    added = got["T", "missing_column"].statement
    assert added.index("FROM user_tables WHERE table_name = 'T') AND NOT EXISTS (SELECT 1 FROM user_tab_columns WHERE table_name = 'T' AND column_name = 'A')") < added.index("ALTER TABLE")
    assert added.count("EXECUTE IMMEDIATE") == 2 and "COMMENT ON COLUMN" in added
    assert got["T", "index_name"].skip_reason == "index composition is not known" and got["X", "missing_table"].skip_reason == "no reference metadata"
    assert got["U", "missing_table"].statement.startswith("-- the definition is not known")
    blocks = repair.script_blocks(fixes, servers, 0).orderBy("target", "part", "id").collect()
    assert [b.part for b in blocks] == [0, 1, 1, 2, 2]


def test_scripts_are_written_in_order(spark, servers, tmp_path):
    blocks = spark.createDataFrame([(t, p, i, f"{t}-{p}-{i:03d}") for t in (1, 2) for p in (0, 1) for i in range(50)], "target int, part int, id long, block string").repartition(5)
    repair.write_scripts(blocks, str(tmp_path / "scripts"))
    for t in (1, 2):
        names = sorted((tmp_path / "scripts" / f"target={t}").glob("part-*"))
        lines = [x for n in names for x in n.read_text().split()]
        assert lines == sorted(lines) and len(lines) == 100


def test_sql_screening(spark):
    texts = ["select created_at, count (*) from t", "with x as (select 1) select * from x;", "select 'a;b -- drop' /* ; */ from t -- end", "select f(1) from t", 'select "DBMS_LOB"(a) from t', "delete from t", "select 1; select 2", "select utl_x.y from dual", "select a into b from t", "select upper(a) filter (where b)"]
    log = spark.createDataFrame(list(enumerate(texts)), "id int, sql_text string")
    got = {i: set() for i in range(len(texts))}
    for r in sql_log.screen_sql(log, "oracle").collect():
        got[r.id].add((r.violation, r.token))
    assert not got[0] and not got[1] and not got[2] and not got[9]
    assert got[3] == {("function not allowed", "F")} and got[4] == {("blocked function", "DBMS_LOB")} and got[5] == {("start", "DELETE"), ("forbidden word", "DELETE")}
    assert got[6] == {("several statements", ";")} and got[7] == {("blocked function", "UTL_X")} and got[8] == {("forbidden word", "INTO")}


@pytest.mark.parametrize("bad", ["", "a b", "{x}", "{date", "x" * 121])
def test_file_name_templates_are_checked(spark, bad):
    with pytest.raises((ValueError, KeyError)):
        text.file_name(bad, {"date": F.lit("d")})


def test_file_names(spark):
    values = {"date": F.lit(""), "schema": F.lit("APP"), "description": F.lit(" "), "ext": F.lit(".sql"), "type": F.lit("Package Body"), "version": F.lit(3)}
    row = spark.range(1).select(text.file_name("{date}_{schema}${description}{ext}", values).alias("a"), text.file_name("V{version}__{schema}_{description}{ext}", values).alias("b"), text.file_name("{type}.{ext}", values).alias("c"))
    assert tuple(row.first()) == ("app.sql", "V3__app.sql", "package_body.sql")
    bad = spark.createDataFrame([(x,) for x in ("ok.sql", "", "a/b", "a..b", ".a", " a", "con.sql", "LPT9", "LPT0")], "n string")
    assert [r[0] for r in bad.select(text.bad_file_name(F.col("n"))).collect()] == [None, "empty", "bad character", "dots", "dots", "space at an end", "reserved", "reserved", None]


def test_name_rules_do_not_escape_the_underscore(spark):
    names = spark.createDataFrame([("V_A",), ("VXA",), ("A",), ("x_test",), ("KEEP",)], "table_name string")
    r = spark.createDataFrame([("exclude", "prefix", "V_", True), ("exclude", "suffix", "_TEST", True), ("include", "exact", "A", False)], "action string, match_type string, pattern string, enabled boolean")
    assert {x.table_name for x in rules.apply_name_rules(names, r).collect()} == {"A", "KEEP"}
    only = r.withColumn("enabled", F.lit(True))
    assert {x.table_name for x in rules.apply_name_rules(names, only).collect()} == {"A"}


def test_many_rules_are_looked_up(spark, monkeypatch):
    """The same pairs as by comparing all, by equality: beginnings, ends, insides, and patterns that have none of these."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("AB_%C\\\\") for _ in range(rng.randrange(1, n)))
    names = sorted({word(9) for _ in range(400)})
    likes = sorted({"".join(rng.choice(["A", "B", "C", "AB", "CCA", "%", "_", "\\\\%", "\\\\_", "\\\\\\\\"]) for _ in range(rng.randrange(1, 6))) for _ in range(600)} | {"%", "_", "%ABC%", "A%"})
    texts, patterns = spark.createDataFrame([(n,) for n in names], "text string"), spark.createDataFrame([(x,) for x in likes], '`like` string')
    want = {tuple(r) for r in texts.join(F.broadcast(patterns), F.like("text", F.col("like"))).collect()}
    for most in (0, 30):
        monkeypatch.setattr(shared, "SMALL_ROWS", most)
        got = [tuple(r) for r in rules.like_pairs(texts, patterns).collect()]
        assert set(got) == want and len(got) == len(want)
    assert len(want) > 1000
    headed = patterns.where("`like` RLIKE '^A'")
    plan = rules.like_pairs(texts, headed)._jdf.queryExecution().optimizedPlan().toString()
    assert "key" in plan and "Join Cross" not in plan


def test_operators_with_many_rules_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    names = spark.createDataFrame([(k % 3, f"{rng.choice(['T', 'tmp_', 'HIST_', 'x'])}{k}{rng.choice(['', '_hist', '_TMP', 'é'])}") for k in range(300)], "server_id int, table_name string")
    own = [("exclude" if k % 5 else "include", rng.choice(["prefix", "suffix", "contains", "exact"]), rng.choice([f"T{k}", f"{k}", "_hist", f"tmp_{k}", f"x{k}é"]), k % 7 > 0) for k in range(80)]
    table = spark.createDataFrame(own, "action string, match_type string, pattern string, enabled boolean")
    objects = names.select("server_id", F.col("table_name").alias("name"), F.lit("Table").alias("object_type"))
    deny = spark.createDataFrame([(k % 4, rng.choice(["*", "", "table", "VIEW"]), rng.choice([f"T{k}*", f"*{k}", f"?{k}?*", "*mp*"])) for k in range(60)], "connection_id int, object_type string, name_pattern string")
    wild = deny.select(F.col("name_pattern").alias("table_pattern"))
    run = lambda: [sorted(map(tuple, df.collect()), key=str) for df in (rules.apply_name_rules(names, table), rules.match_rules(names, table), rules.hide_objects(objects, deny), rules.match_patterns(names.select("table_name").distinct(), wild))]
    want = run()
    monkeypatch.setattr(shared, "SMALL_ROWS", 5)
    assert run() == want and all(want)


def test_wildcards_escape_like_characters(spark):
    df = spark.createDataFrame([("T_1", "T_*"), ("TX1", "T_*"), ("A%B", "A%B"), ("AXB", "A%B"), ("abc", "A?C"), ("ab\\c", "ab\\*")], "name string, pattern string")
    got = [(r[0], r[1]) for r in df.select(rules.wildcard_match("name", "pattern"), rules.wildcard_match("name", "pattern", ci=False)).collect()]
    assert got == [(True, True), (False, False), (True, True), (False, False), (True, False), (True, True)]


def test_chain_finds_each_kind_of_tampering(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, "view", c, f"c{c}", "{}", "allowed", "", 1, 2, 3, "x") for c in range(5) for i in range(c * 10 + 1, c * 10 + 7)]
    schema = "id long, event_ts timestamp_ntz, tool string, connection_id long, connection_name string, arguments string, outcome_raw string, reason string, row_count long, bytes long, duration_ms long, client_name string"
    chain = audit.with_chain(spark.createDataFrame(rows, schema)).cache()
    issued = chain.groupBy("connection_id", "day").agg(F.max("seq").cast("long").alias("issued"))
    assert all(r.ok and r.entries == 6 for r in audit.verify_chain(chain, issued).collect())
    c, s = F.col("connection_id"), F.col("seq")
    bad = chain.withColumn("reason", F.when((c == 0) & (s == 3), "x").otherwise(F.col("reason"))).where(~((c == 1) & (s == 4))).where(~((c == 2) & (s == 6)))
    bad = bad.withColumn("prev_hash", F.when((c == 3) & (s == 2), audit.GENESIS).otherwise(F.col("prev_hash")))
    got = {r.connection_id: (r.ok, r.entries, r.first_bad, r.problem) for r in audit.verify_chain(bad, issued).collect()}
    assert got == {0: (False, 2, 3, "modified"), 1: (False, 4, 5, "missing"), 2: (False, 5, 6, "truncated"), 3: (False, 1, 2, "broken link"), 4: (True, 6, None, None)}


ENTRY = "id long, event_ts timestamp_ntz, tool string, connection_id long, connection_name string, arguments string, outcome_raw string, reason string, row_count long, bytes long, duration_ms long, client_name string"


def test_chain_keeps_entries_that_repeat_an_id_or_lack_a_connection(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, "view", c, None, "{}", "allowed", why, None, 2, 3, "x") for i, c, why in ((1, 7, "a"), (2, 7, "c"), (2, 7, "b"), (3, None, "d"), (4, None, "e"), (None, 7, "f"))]
    chain = audit.with_chain(spark.createDataFrame(rows, ENTRY)).cache()
    got = sorted(((r.connection_id or 0), r.seq, r.id, r.reason) for r in chain.collect())
    assert got == [(0, 1, 3, "d"), (0, 2, 4, "e"), (7, 1, None, "f"), (7, 2, 1, "a"), (7, 3, 2, "b"), (7, 4, 2, "c")]
    issued = chain.groupBy("connection_id", "day").agg(F.max("seq").cast("long").alias("issued"))
    found = {r.connection_id: (r.ok, r.entries) for r in audit.verify_chain(chain, issued).collect()}
    assert found == {None: (True, 2), 7: (True, 4)}
    lost = chain.where("reason <> 'e'")
    assert {r.connection_id: r.problem for r in audit.verify_chain(lost, issued).collect()} == {None: "truncated", 7: None}


def test_canonical_entries_are_json(spark):
    odd = "".join(map(chr, range(1, 128))) + "é\u2028😀"
    row = (1, datetime.datetime(2024, 1, 2, 3, 4, 5, 6000), odd, 2, None, odd, "bogus", "", None, 4, 5, 'c"\\')
    body = spark.createDataFrame([row], ENTRY).select(audit.canonical(spark.createDataFrame([row], ENTRY))).first()[0]
    assert json.loads(body) == [1, "2024-01-02T03:04:05.006Z", odd, 2, None, odd, "error", "", None, 4, 5, 'c"\\']
    assert body == json.dumps(json.loads(body), ensure_ascii=False, separators=(",", ":"))


def _numbers():
    """A reader of sources of two batches that may break before, between or after them; made here, so that it is sent by its code."""

    def read(path, names):
        import pyarrow as pa

        if path == "none":
            raise ConnectionError("no such host")
        yield pa.RecordBatch.from_pydict({"a": [1, 2], "b": ["x", None]})
        if path == "breaks":
            raise TimeoutError("too slow " * 1000)
        yield pa.RecordBatch.from_pydict({"a": [3], "b": ["y"]})
        if path == "late":
            raise ValueError("at the end")
        if path == "other":
            yield pa.RecordBatch.from_pydict({"a": ["not a number"], "b": ["z"]})

    return read


def test_sources_fail_for_themselves(spark):
    kinds = ["good", "none", "breaks", "late", "other"]
    sources = [fanout.Source(k, n, (n,)) for k, n in enumerate(kinds)] + [fanout.Source(9, "mixed", ("good", "late")), fanout.Source(10, "twice", ("good", "good"))]
    rows, errors = fanout.fan_out(spark, sources, "a long, b string", _numbers())
    got = sorted((r.server_id, r.server_name, r.a, r.b) for r in rows.collect())
    assert got == sorted([(k, n, a, b) for k, n, times in ((0, "good", 1), (10, "twice", 2)) for a, b in ((1, "x"), (2, None), (3, "y")) * times], key=lambda r: (r[0], r[2]))
    said = {r.server_name: (r.error, len(r.message)) for r in errors.collect()}
    assert said == {"none": ("ConnectionError", 12), "breaks": ("TimeoutError", 2000), "late": ("ValueError", 10), "other": ("ArrowInvalid", said["other"][1]), "mixed": ("ValueError", 10)}
    many, _ = fanout.fan_out(spark, [fanout.Source(k, f"s{k}", ("good",)) for k in range(60)], "a long, b string", _numbers())
    assert many.count() == 180
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(many) == size(rows)


def test_no_source_no_rows(spark):
    rows, errors = fanout.fan_out(spark, [fanout.Source(1, "x", ("none",))], "a long, b string", _numbers())
    assert rows.count() == 0 and errors.count() == 1


def test_error_digest_shows_the_first(spark):
    errors = spark.createDataFrame([("b", "late"), ("a", "late"), ("a", "late"), ("c", "gone")], "name string, error string")
    assert tuple(fanout.error_digest(errors, "name", "error", 2).first()) == ("a: late | b: late", 4)


def test_csv_guard(spark):
    values = ["=1+1", "a,b", 'say "x"', "plain", "", "-5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(audit.csv_field(F.col("v"))).collect()] == ['"\'=1+1"', '"a,b"', '"say ""x"""', "plain", "", '"\'-5"']


def test_normal_form_is_idempotent(spark):
    df = spark.createDataFrame([("﻿\r\n\nselect 1  \r\nfrom t\t;\r\n/\n\n",), ("x;",), ("",), ("a\r\rb",)], "t string")
    once = df.select(text.normalize("t", "oracle").alias("t"))
    assert [r[0] for r in once.collect()] == ["select 1\nfrom t", "x", "", "a\n\nb"]
    assert once.select(text.normalize("t", "oracle").alias("t")).collect() == once.collect()


@pytest.mark.parametrize(
    ("ddl", "want"),
    [
        ('create  editionable package  body "APP"."PK" as\n x', "CREATE PACKAGE BODY PK AS\n x"),
        ('noneditionable procedure "MyProc"', 'noneditionable procedure "MyProc"'),
        ('create or replace noneditionable procedure "MyProc" is', 'CREATE NONEDITIONABLE PROCEDURE "MyProc" IS'),
        ("create force view app.V1", "CREATE FORCE VIEW V1"),
        ("create or replace editioning view v as select 1", "CREATE EDITIONING VIEW V AS select 1"),
        ("create\ntable\tother.t1(a int)", "CREATE TABLE OTHER.T1 (a int)"),
        ("create bitmap index i on t(a)", "CREATE BITMAP INDEX I on t(a)"),
        ("create private temporary table t", "CREATE PRIVATE TEMPORARY TABLE T"),
        ("create sequence s", "CREATE SEQUENCE S"),
        ("create or replace public synonym s for t", "CREATE PUBLIC SYNONYM S for t"),
        ("create materialized view mv\n as x", "CREATE MATERIALIZED VIEW MV\n as x"),
        ('create trigger "A B"."C" before', 'CREATE TRIGGER "A B".C before'),
        ("create type body", "create type body"),
        ("create package body", "create package body"),
        ("create type bodyguard as object", "CREATE TYPE BODYGUARD AS object"),
        ("create table 1t", "create table 1t"),
        ('create table ""', 'create table ""'),
        ("create or table t", "create or table t"),
        ("create user u", "create user u"),
        ("select 1", "select 1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_header(spark, ddl, want):
    df = spark.createDataFrame([(ddl,)], "t string")
    assert df.select(heads.canonical_header("t", " app ")).first()[0] == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("CREATE OR REPLACE EDITIONABLE PACKAGE BODY app.pk AS", ("PACKAGE BODY", "app.pk")),
        ("  create unique index \"I x\" on t", ("INDEX", '"I x"')),
        ("create global temporary table if not exists t1(a int)", ("TABLE", "t1")),
        ("create table if not t1", ("TABLE", "if")),
        ("create package body", ("PACKAGE", "body")),
        ("alter table a.b add c int", ("ALTER TABLE", "a.b")),
        ("alter index i rebuild", None),
        ("  procedure p(a int) is", ("PROCEDURE", "p")),
        ("function f return int", ("FUNCTION", "f")),
        ("-- Table:  my table  ", ("TABLE", "my table")),
        ("--target data source: x:y", ("TARGET DATA SOURCE", "x:y")),
        ("-- table:", None),
        ("create view", None),
        ("create force view v", None),
        ("select 1", None),
        ("", None),
    ],
)
def test_line_heads(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(heads.line_head("t")).first()[0]
    assert (got and tuple(got)) == want


def test_clean_definitions(spark):
    rows = [
        ('CREATE SEQUENCE "APP"."S1"  MINVALUE 1 START WITH 4711 CACHE 20 NOORDER  NOCYCLE NOKEEP NOSCALE GLOBAL;', "SEQUENCE", "CREATE SEQUENCE S1 MINVALUE 1 START WITH 1 CACHE 20"),
        ("create sequence s\n start with 5\n nocycle;\n", "SEQUENCE", "create sequence s\n start with 1"),
        (' CREATE OR REPLACE EDITIONABLE TRIGGER "TR" BEFORE x\n', "TRIGGER", "CREATE OR REPLACE TRIGGER TR BEFORE x"),
        ("CREATE TYPE BODY t AS x", "TYPE BODY", "CREATE OR REPLACE TYPE BODY T AS x".replace("T AS", "t AS")),
        ("CREATE MATERIALIZED VIEW m", "MATERIALIZED VIEW", "CREATE MATERIALIZED VIEW m"),
        (None, "VIEW", None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "d string, k string")
    assert [r[0] for r in df.select(heads.clean_definition("d", "k")).collect()] == [r[2] for r in rows]
    conditions = spark.createDataFrame([('"A_1" is NOT  null',), (" b IS NOT NULL ",), ("c is not null or d",), ("f(x) is not null",), ("",)], "c string")
    assert [r[0] for r in conditions.select(heads.not_null_column("c")).collect()] == ["A_1", "b", "", "", ""]


def test_diff_rebuilds_both_texts(spark, sf_dir):
    pairs = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nx\nc\nd\ne"), (2, "same", "same;"), (3, "", "n")], "doc_id long, server_text string, file_text string")
    ops = text.diff_operations(pairs).orderBy("doc_id", "seq").collect()
    side = lambda d, drop: "\n".join(r.line for r in ops if r.doc_id == d and r.op != drop)
    assert (side(1, "+"), side(1, "-")) == ("a\nb\nc\nd", "a\nx\nc\nd\ne") and {r.doc_id for r in ops} == {1, 3}
    got = {r.doc_id: (r.added, r.removed, r.n_hunks) for r in text.unified(pairs).collect()}
    assert got[1] == (2, 1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14))
def test_diff_keeps_a_longest_common_subsequence(a, b):
    ops = text._operations(a, b)
    side = lambda drop: [line for op, line in zip(ops["op"], ops["line"], strict=True) if op != drop]
    assert side("+") == a and side("-") == b
    best = [0] * (len(b) + 1)  # lengths for the walked part of a, by part of b
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(best[k] + 1 if x == y else max(best[k + 1], row[k]))
        best = row
    assert (ops["op"] == " ").sum() == best[-1]


@pytest.mark.parametrize("pairs", [1_000_000, 40, 0])
def test_diff_of_texts_with_many_equal_lines(monkeypatch, pairs):
    """Walked, and divided: as many lines are kept as the plain table of lengths says."""
    monkeypatch.setattr(text, "EXACT_PAIRS", pairs)
    monkeypatch.setattr(text, "OFTEN", 3)
    rng = random.Random(pairs)
    cases = [([*"x" * 40, "end"], ["new", *"x" * 40, "end"]), (["a"], []), ([], ["b"]), (list("abcde" * 9), list("edcba" * 9))]
    cases += [([rng.choice("abcxyz") for _ in range(rng.randrange(60))], [rng.choice("abcuvw") for _ in range(rng.randrange(60))]) for _ in range(40)]
    for a, b in cases:
        test_diff_keeps_a_longest_common_subsequence.hypothesis.inner_test(a, b)


def test_a_moved_block_of_a_long_text_is_told_exactly():
    """Beyond the pairs that are walked: 100 000 lines of three kinds, one block of other lines moved."""
    rng = random.Random(1)
    lines = [rng.choice(["", "end;", "begin"]) for _ in range(30_000)]
    block = [f"line {k}" for k in range(50)]
    began = time.time()
    ops = text._operations([*lines[:100], *block, *lines[100:]], [*lines[:29_000], *block, *lines[29_000:]])
    assert ((ops["op"] == "+").sum(), (ops["op"] == "-").sum()) == (50, 50) and time.time() - began < 60


def test_common_lengths():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, 70), rng.integers(0, 5, 90)
    best = [0] * 91
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(best[k] + 1 if x == y else max(best[k + 1], row[k]))
        best = row
    assert text.common_lengths(a, b).tolist() == best
    assert text.common_lengths(a, b[:0]).tolist() == [0]


def test_diffs_hold_few_pairs_and_read_them_once(spark):
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "a": "x", "b": "y"} for i in range(2 * text.PAIRS + 1)])
    assert [len(rows) for rows in text._few_pairs(iter([batch]))] == [text.PAIRS, text.PAIRS, 1]
    pairs = spark.createDataFrame([(i, "a\nb", f"b\nc{i}") for i in range(150)] + [(200, None, "x"), (201, "x;", "x")], "doc_id long, server_text string, file_text string").coalesce(1)
    counts = text.exact_counts(pairs)
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in counts.collect()} == {(i, 1, 1) for i in range(150)} | {(200, 0, 0), (201, 0, 0)}
    rows = text.diff_operations(pairs)
    assert rows.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, rows.where("doc_id = 149").collect())) == [(149, 1, "-", "a"), (149, 2, " ", "b"), (149, 3, "+", "c149")]


def test_repair_of_columns_makes_no_tables(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(repair, "created_tables", lambda *_: pytest.fail("tables are made"))
    assert not registry.QUERIES["gn3"](spark, sf_dir).isEmpty()


def test_diff_summaries(spark):
    long = "\n".join(f"l{k}" for k in range(3000))
    pairs = [(1, "a\nb\nc\nd\ne\nf\ng", "a\nb\nc\nX\ne\nf\ng\nh"), (2, "a\r\nb", "a\nb"), (3, "same", "same"), (4, long, long.replace("l", "m")), (5, "x\n" * 100, "y\n" * 100), (6, "", "é")]
    got = {r.doc_id: tuple(r)[1:] for r in text.diff_summaries(spark.createDataFrame(pairs, "doc_id long, server_text string, file_text string")).collect()}
    assert got[1] == ("--- existing\n+++ new (+2 -1 lines)\n@@ -2,6 +2,7 @@\n b\n c\n-d\n+X\n e\n f\n g\n+h", 2, 1)
    assert got[2] == ("(only line endings or encoding differ)", 0, 0)
    assert got[4] == ("(too large for a line diff: 3000 existing lines, 3000 new lines, 0 unchanged lines at the top/bottom excluded)", None, None)
    assert got[5][0].endswith("-x\n... (diff truncated)") and got[5][0].count("\n") == 42 and got[5][1:] == (100, 100)
    assert got[6] == ("--- existing\n+++ new (+1 -1 lines)\n@@ -1,1 +1,1 @@\n-\n+é", 1, 1) and 3 not in got
    counts = {r.doc_id: tuple(r)[1:] for r in text.exact_counts(spark.createDataFrame([(1, "a\nb\nc", "b\nc\na"), (2, "q", "q;")], "doc_id long, server_text string, file_text string")).collect()}
    assert counts == {1: (1, 1), 2: (0, 0)}


def test_a_long_chain_takes_time_in_proportion(spark):
    log = spark.range(100_000).selectExpr("id + 1 AS id", "timestamp_ntz'2024-01-01 00:00:00' AS event_ts", "'view' AS tool", "1L AS connection_id", "'c' AS connection_name", "'{}' AS arguments", "'allowed' AS outcome_raw", "'' AS reason", "1L AS row_count", "2L AS bytes", "3L AS duration_ms", "'x' AS client_name")
    began = time.time()
    chain = audit.with_chain(log)
    last = chain.orderBy(F.desc("seq")).first()
    assert (last.seq, last.id) == (100_000, 100_000) and time.time() - began < 60
    hashes = [r.hash for r in chain.where("seq <= 3").orderBy("seq").collect()]
    bodies = [r[0] for r in log.where("id <= 3").orderBy("id").select(audit.canonical(log)).collect()]
    own = audit.GENESIS
    for body, got in zip(bodies, hashes, strict=True):
        own = hashlib.sha256(f"{own}\n{body}".encode()).hexdigest()
        assert own == got


def test_grep_shows_the_first_and_counts_all(spark):
    lines = text.text_lines(spark.createDataFrame([(1, "hit\na\nb\nhit\nc\nhit\nd\nhit"), (2, "none"), (3, "Hit")], "doc_id long, text string"))
    got = sorted(map(tuple, text.grep_first(lines, "hit", 2, 1).collect()))
    assert got == [(1, 1, True, "hit", 1), (1, 2, False, "a", 1), (1, 3, False, "b", 1), (1, 4, True, "hit", 1), (1, 5, False, "c", 1), (3, 1, True, "Hit", 1)]
    assert sorted(map(tuple, text.grep_counts(lines, "hit", 2).collect())) == [(1, 4, 2, True), (3, 1, 1, False)]


def test_grep_groups(spark):
    lines = text.text_lines(spark.createDataFrame([(1, "a\nhit\nb\nc\nd\nhit\ne")], "doc_id long, text string"))
    got = [(r.line_no, r.hit, r.grp) for r in text.grep_context(lines, "HIT", 1).orderBy("line_no").collect()]
    assert got == [(1, False, 1), (2, True, 1), (3, False, 1), (5, False, 2), (6, True, 2), (7, False, 2)]


def test_cells_are_cut_where_they_are_shown(spark):
    df = spark.createDataFrame([(bytearray(("é" * n).encode()),) for n in (3999, 4000, 4001)] + [(None,)], "bytes binary")
    got = [tuple(r[0]) for r in df.select(lob.inline_cell()).collect()]
    assert got[:3] == [("é" * 3999, False), ("é" * 4000, False), ("é" * 4000, True)] and got[3][0] is None


def test_sniff_and_display(spark):
    rows = [(bytes.fromhex(m) + b"\x00..", k) for m, k in lob.MAGIC] + [(b"PK\x03\x04" + b"\x00" * 90 + p.encode(), k) for p, k in lob.OFFICE] + [(b"PK\x03\x04", "zip"), (b"BM is text", "txt"), (b"{\\rtf1", "rtf"), (b"[1] no", "txt"), (b"<a/>", "xml"), (b'<?xml version="1.0"?>\n<svg/>', "svg"), (b"a\x00", "bin"), (b"RIFF1234WEBPxx", "webp"), (b"  <svg>", "svg"), (b"<!DOCTYPE html>", "html"), (b"<?xml", "xml"), (b'{"a":1}', "json"), ("é".encode() * 400, "txt"), (b"\x00\xff", "bin"), (None, "bin")]
    df = spark.createDataFrame([(None if b is None else bytearray(b), k) for b, k in rows], "bytes binary, k string")
    assert all(r[0] == r[1] for r in df.select(lob.sniff(), "k").collect())
    assert [r[0] for r in df.where("k = 'bin' and bytes is not null").select(lob.display()).collect()] == ["6100", "00FF"]


def test_capture_lets_a_later_smaller_cell_in(spark):
    df = spark.createDataFrame([(1, i, "c", bytearray(n)) for i, n in enumerate((5, 8, 2, 9, 1))], "call_id long, row_id long, column_name string, bytes binary")
    got = [(r.row_id, r.reason) for r in lob.capture(df, cells_most=3, each=8, total=10).orderBy("row_id").collect()]
    assert got == [(0, None), (1, "total exceeded"), (2, None), (3, "cell too large"), (4, None)]


def test_objects_hold_their_cells_and_count_only_whole(spark, tmp_path):
    cells = spark.createDataFrame([(1, "C", "CLOB", bytearray(b"text")), (2, "B", "BLOB", bytearray(b"\0" * 5000)), (3, "B", "BLOB", bytearray()), (4, "B", "BLOB", None)], "row_id long, column_name string, source_type string, bytes binary")
    root = str(tmp_path / "cells")
    made = objects.write_objects(cells.repartition(3), root)
    rows = {r.row_id: r for r in made.collect()}
    assert set(rows) == {1, 2, 3} and (rows[1].label, rows[1].ext, rows[1].preview) == ("cells-C-row1", "txt", "text") and rows[2].preview is None
    for r in rows.values():
        content = (tmp_path / "cells" / r.place).read_bytes()
        assert (len(content), hashlib.sha256(content).hexdigest()) == (r.n_bytes, r.sha256)
    assert {r.row_id: r.cell for r in objects.referenced(made).collect()}[2] == f"<BLOB file {rows[2].id}>"
    before = sorted(p.relative_to(tmp_path) for p in tmp_path.rglob("*"))
    fails = cells.withColumn("bytes", F.expr("if(row_id = 2, cast(raise_error('lost') as binary), bytes)"))
    with pytest.raises(Exception, match="lost"):
        objects.write_objects(fails.repartition(3), root)
    assert sorted(p.relative_to(tmp_path) for p in tmp_path.rglob("*")) == before
    assert objects.write_objects(cells.where("row_id > 9"), str(tmp_path / "none")).count() == 0


def test_an_attempt_that_comes_second_leaves_no_object(tmp_path):
    writer = objects._Writer(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"row_id": 1, "column_name": "C", "source_type": "CLOB", "id": "r_1", "label": "l", "ext": "txt", "n_bytes": 1, "sha256": "s", "preview": "x", "bytes": b"x"}])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept])
    assert (tmp_path / kept.name).exists() and not (tmp_path / lost.name).exists()


@pytest.mark.parametrize("bad", [{"columns": ["a b"]}, {"columns": ["zz"]}, {"columns": ["c"], "limit": 0}, {"columns": ["c"], "filters": [("c", "in", [])]}, {"columns": ["c"], "filters": [("c", "eq", "\0")]}, {"columns": ["c"], "filters": [("c", "or", 1)]}, {"columns": ["c"], "order_by": [("c", "up")]}])
def test_structured_query_refuses(spark, bad):
    with pytest.raises(ValueError):
        sinks.table_query(spark.createDataFrame([("x",)], "c string"), **bad)


def test_a_structured_query_is_judged_whole_and_runs_by_its_names(spark):
    columns = spark.createDataFrame([(0, "T", "A", 1), (0, "T", "b", 2), (0, "T", "B", 3), (0, "T", "Z", 4)], "connection_id int, table_name string, column_name string, column_id int")
    access = spark.createDataFrame([(0, "T", True), (0, "GONE", True), (0, "N", False)], "connection_id int, table_name string, allowed boolean")
    cells = spark.createDataFrame([(0, "T", "A", True), (0, "T", "b", True), (0, "T", "B", False)], "connection_id int, table_name string, column_name string, allowed boolean")
    policies = spark.createDataFrame([(0, 3)], "connection_id int, max_rows int")
    asks = {
        "all": ("T", [], None), "exact": ("T", [("column", " b "), ("column", "a"), ("filter", "a"), ("order", "b")], 1), "denied": ("T", [("filter", "zz"), ("column", "A"), ("column", "B")], 9),
        "filter": ("T", [("column", "A"), ("order", "q"), ("filter", "Z")], 9), "none": ("N", [], 9), "gone": ("GONE", [("column", "A")], 9), "unknown": ("T", [("column", "x"), ("column", "B")], 9),
    }
    requests = spark.createDataFrame([(k, 0, t, n) for k, (t, _, n) in asks.items()], "request_id string, connection_id int, table_name string, asked_limit int")
    parts = spark.createDataFrame([(k, p, i, c) for k, (_, ps, _) in asks.items() for i, (p, c) in enumerate(ps)], "request_id string, part string, seq int, asked string")
    got = {r.request_id: r for r in rules.granted_queries(requests, parts, columns, access, cells, policies).collect()}
    assert {k: r.reason for k, r in got.items()} == {"all": None, "exact": None, "denied": "column denied: B", "filter": "filter denied: Z", "none": "table denied", "gone": "table not found", "unknown": "unknown column: x"}
    assert (got["all"].columns, got["all"].n_omitted, got["all"].row_limit) == (["A", "b"], 2, 3)
    assert (got["exact"].columns, got["exact"].names, got["exact"].row_limit) == (["b", "A"], {"a": "A", "b": "b"}, 1)
    data = spark.createDataFrame([(i, 10 - i) for i in range(5)], "A int, b int")
    assert [tuple(r) for r in sinks.granted_rows(data, got["exact"], [("a", "gt", 1)], [("b", "asc")]).collect()] == [(6, 4), (7, 3)]
    for request, filters in (("denied", []), ("all", [("Z", "eq", 1)])):
        with pytest.raises(PermissionError):
            sinks.granted_rows(data, got[request], filters)


def test_a_row_at_the_reference_is_repaired_where_its_details_say(spark):
    servers = spark.createDataFrame([(0, "Ref"), (1, "Tgt"), (2, None)], "server_id int, server_name string")
    found = "Table found in server tGT but not in reference server REF"
    rows = [(1, 0, "MISSING", found), (2, 0, "missing", found), (3, 0, "DIFFERENT", found), (4, 0, "MISSING", found.replace("tGT", "other")), (5, 7, "MISSING", found), (6, 0, "MISSING", None)]
    df = spark.createDataFrame(rows, "id int, server_id int, difference string, details string")
    assert {r.id: r.target for r in repair.resolve_targets(df, servers, 0).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: 7, 6: None}


def test_a_plan_of_files_says_what_cannot_be_written(spark):
    objects = spark.createDataFrame(
        [(1, "postgres", "A", "package spec and body", "p", "", "x", None), (2, "oracle", "A", "PACKAGE SPEC AND BODY", "p", "", "x\r\ny", "d"), (3, "oracle", "B", "TABLE", "a/b", "", "x", None), (4, "oracle", "C", "TABLE", "t", "", "x", None)],
        "object_id int, engine string, schema_name string, object_type string, name string, description string, ddl string, deploy string",
    )
    types = spark.createDataFrame([("PACKAGE", "both", ".pks"), ("TABLE", "odd", "")], "object_type string, storage_mode string, extension string")
    none = spark.createDataFrame([("c", "mac")], "schema_name string, line_endings string")
    for c in saves.OPTIONS:
        none = none if c == "line_endings" else none.withColumn(c, F.lit(None).cast("string"))
    none = none.withColumns({c: F.lit(None).cast("map<string, string>") for c in ("storage_modes", "extensions")})
    files = spark.createDataFrame([("sql/a/migration/2024", "240305_0900_a$p.pks")], "path string, name string")
    got = {(r.object_id, r.kind): r for r in saves.save_plan(objects, types, none, files, "2024-03-05 09:00:00", options={"line_endings": "lf"}).collect()}
    assert {k: r.violation for k, r in got.items()} == {(1, "code"): "no packages here", (1, "migration"): "no packages here", (2, "code"): None, (2, "migration"): None, (3, "code"): "bad character", (3, "migration"): "bad character", (4, "code"): "unknown line endings", (4, "migration"): "unknown line endings"}
    code, migration = got[2, "code"], got[2, "migration"]
    assert (code.path, code.name, code.content, code.exists) == ("sql/a/code/a", "p.pks", "x\ny", False)
    assert (migration.path, migration.name, migration.content, migration.exists) == ("sql/a/migration/2024", "240305_0900_a$p.pks", "d", True)


def test_a_report_keeps_separators_quotes_and_lines(spark, tmp_path):
    rows = [("MISSING", "T;1", "", 'say "x"', "two\nlines"), ("OTHER", None, "a", "b", ";")]
    df = spark.createDataFrame(rows, "difference string, table_name string, column_name string, server_name string, details string")
    back = sinks.write_discrepancies(df.coalesce(1), str(tmp_path / "r"))
    assert sorted(tuple(r) for r in back.collect()) == [(*rows[0], "missing"), (*rows[1], None)]
    assert next((tmp_path / "r").glob("part-*")).read_text().startswith("DIFFERENCE;TABLE_NAME;COLUMN_NAME;SERVER_NAME;DETAILS\n")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    assert columns
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        key = lambda row: tuple((v is None, str(v)) for v in row)
        assert sorted(got, key=key) == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", ["sk6", "fl14_query", "sk9_plan", "sc10", "tx13", "gn11"])
def test_what_is_read_several_times_is_derived_once(spark, sf_dir, name):
    assert not any("lineitem" in f for f in registry.QUERIES[name](spark, sf_dir).inputFiles())
