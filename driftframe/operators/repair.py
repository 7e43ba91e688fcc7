"""Repair of drift: discrepancies become statements that can run again, for Oracle in guard blocks, for PostgreSQL with IF NOT EXISTS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.operators.catalog import deploy_tables, statements
from driftframe.operators.drift import ELEMENTS
from driftframe.operators.shared import few, written

KINDS = {"TABLE": "missing_table", "COLUMN": "missing_column", **{e: e.lower() for e in ELEMENTS[2:]}}


def _text(*parts: F.Column | str) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def literal(c: F.Column) -> F.Column:
    return _text("'", F.replace(c, F.lit("'"), F.lit("''")), "'")


def identifier(c: F.Column) -> F.Column:
    return _text('"', F.replace(c, F.lit('"'), F.lit('""')), '"')


def _filled(c: F.Column) -> F.Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def held(view: str, column: str, name: F.Column, more: F.Column | None = None) -> F.Column:
    """Condition that a catalog view has a name, and perhaps a second one."""
    both = _text(" AND column_name = ", literal(F.upper(F.trim(more)))) if more is not None else F.lit("")
    return _text(f"EXISTS (SELECT 1 FROM {view} WHERE {column} = ", literal(F.upper(F.trim(name))), both, ")")


def guarded(condition: F.Column, statement: F.Column) -> F.Column:
    """An Oracle block that runs the statement where the condition holds."""
    return _text("BEGIN\n  FOR x IN (SELECT 1 FROM dual WHERE ", condition, ") LOOP\n    EXECUTE IMMEDIATE ", literal(statement), ";\n  END LOOP;\nEND;\n/")


def classify(discrepancies: DataFrame) -> DataFrame:
    """With kind, what has to be repaired; ``unknown`` for elements of no known kind."""
    known = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return discrepancies.withColumn("kind", F.coalesce(F.element_at(known, F.col("element")), F.lit("unknown")))


def resolve_targets(discrepancies: DataFrame, servers: DataFrame, reference: int) -> DataFrame:
    """``discrepancies`` with ``target``, the server to repair: a row's own, or where it stands at the reference, that which its details name, blind to case.

    Null where a row at the reference is none of a missing thing, or names no server that is known; of servers with one name the smallest id counts.
    """
    named = F.trim(F.regexp_extract("details", r"found in server (.*?) but not in reference server ", 1))
    at_reference = F.col("server_id") == reference
    key = F.when(at_reference & (F.upper("difference") == "MISSING"), _filled(F.lower(named)))
    by_name = few(servers.where("server_name is not null").groupBy(F.lower("server_name").alias("__name")).agg(F.min("server_id").alias("__id")))
    return discrepancies.withColumn("__name", key).join(by_name, "__name", "left").withColumn("target", F.when(at_reference, F.col("__id")).otherwise(F.col("server_id"))).drop("__name", "__id")


def _type(c: str) -> F.Column:
    return _text(_filled(F.col(f"{c}.data_type")), F.coalesce(_text("(", _filled(F.col(f"{c}.data_length")), ")"), F.lit("")))


def _default(c: str) -> F.Column:
    return F.coalesce(_text(" DEFAULT ", _filled(F.col(f"{c}.data_default"))), F.lit(""))


def _comment(table: F.Column, column: F.Column, comment: F.Column) -> F.Column:
    return _text("COMMENT ON COLUMN ", identifier(table), ".", identifier(column), " IS ", literal(comment))


def created_tables(columns: DataFrame, ddls: DataFrame) -> DataFrame:
    """(table_name, oracle, postgres): how each table of the reference's ``columns`` or of its definitions ``ddls`` (table_name, ddl) is made elsewhere.

    A definition is used where there is one, else the columns; comments and indexes come from the columns, but for PostgreSQL from the definition.
    """
    ddls = written(ddls.select("table_name", "ddl"), "definitions")  # read three times
    rows = columns.select("table_name", F.struct("*").alias("c"))
    t, name = F.col("table_name"), F.col("c.column_name")
    definition = _text(identifier(name), " ", _type("c"), _default("c"))
    note = _filled(F.col("c.comments"))
    on_oracle = F.when(note.isNotNull(), _text("\n\n", guarded(held("user_tab_columns", "table_name", t, name), _comment(t, name, note))))
    on_postgres = F.when(note.isNotNull(), _text("\n", _comment(t, name, note), ";"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c.column_name", c.alias("said")))), lambda x: x["said"]), "")
    defs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c.column_name", definition.alias("said")))), lambda x: x["said"]), ", ")
    made = rows.groupBy("table_name").agg(defs.alias("defs"), in_order(on_oracle).alias("oracle_notes"), in_order(on_postgres).alias("postgres_notes"), F.bool_and(definition.isNotNull()).alias("typed"))
    index = rows.select("table_name", _filled(F.col("c.index_name")).alias("index_name"), identifier(name).alias("column")).where("index_name is not null").groupBy("table_name", "index_name").agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("columns"))
    create = _text(identifier(F.col("index_name")), " ON ", identifier(t), " (", F.col("columns"), ")")
    index = index.select("table_name", "index_name", _text("\n\n", guarded(_text("NOT ", held("user_indexes", "index_name", F.col("index_name"))), _text("CREATE INDEX ", create))).alias("o"), _text("\nCREATE INDEX IF NOT EXISTS ", create, ";").alias("p"))
    by_name = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index_name", c))), lambda x: x[c]), "")
    index = index.groupBy("table_name").agg(by_name("o").alias("oracle_indexes"), by_name("p").alias("postgres_indexes"))

    parts = statements(ddls.select(F.lit(0).alias("server_id"), "table_name", "ddl"))
    bare = F.regexp_replace("statement", r"[\s;/]+$", "")
    first = parts.where("seq = 1").select("table_name", _filled(bare).alias("first")).where("first is not null")
    as_postgres = parts.sparkSession.range(1).select(F.lit(0).alias("server_id"), F.lit("postgres").alias("engine"))
    blocks = deploy_tables(ddls.select(F.lit(0).alias("server_id"), "table_name", "ddl"), as_postgres)
    whole = blocks.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "\n\n").alias("deploy"))
    known = ddls.select("table_name").distinct().withColumn("known", F.lit(True))
    every = made.join(index, "table_name", "left").join(first, "table_name", "full_outer").join(whole, "table_name", "left").join(known, "table_name", "left")
    none = _text("NOT ", held("user_tables", "table_name", t))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    why = F.when(F.col("known"), "-- the definition can't run, so this one is made from the columns\n").otherwise("-- the definition is not known, so this one is made from the columns\n")
    oracle = F.when(F.col("first").isNotNull(), _text(guarded(none, F.col("first")), e("oracle_notes"), e("oracle_indexes")))
    oracle = oracle.when(F.col("typed"), _text(why, guarded(none, _text("CREATE TABLE ", identifier(t), " (", F.col("defs"), ")")), e("oracle_notes"), e("oracle_indexes")))
    postgres = F.when(F.col("first").isNotNull(), F.col("deploy")).when(F.col("typed"), _text(why, "CREATE TABLE IF NOT EXISTS ", identifier(t), " (", F.col("defs"), ");", e("postgres_notes"), e("postgres_indexes")))
    return every.select("table_name", oracle.alias("oracle"), postgres.alias("postgres"))


def fix_rows(numbered: DataFrame, columns: DataFrame, servers: DataFrame, ddls: DataFrame, reference: int, kinds: Sequence[str] | None = None) -> DataFrame:
    """(id, target, table_name, column_name, kind, statement, skip_reason) of numbered discrepancies: a statement, or why there is none.

    ``columns`` is the fleet's catalog and ``ddls`` (table_name, ddl) the reference's definitions. Only rows of ``kinds`` are given, if any are named.
    How a table is made is worked out for tables that are missing somewhere, and joined to their rows alone: all others never carry it.
    """
    ref = columns.where(F.col("server_id") == reference)
    by_column = ref.select("table_name", "column_name", F.struct("data_type", "data_length", "data_default", "comments").alias("r"))
    targets = resolve_targets(classify(numbered), servers, reference)
    targets = targets.join(few(servers.select(F.col("server_id").alias("target"), "engine")), "target", "left")
    rows = targets.where("kind != 'missing_table'").join(by_column, ["table_name", "column_name"], "left")
    if kinds is None or "missing_table" in kinds:
        absent = targets.where("kind = 'missing_table'")
        wanted = written(absent.select("table_name").distinct(), "absent")
        known = created_tables(*(df.join(wanted, "table_name", "left_semi") for df in (ref, ddls)))
        rows = rows.unionByName(absent.join(known, "table_name", "left"), allowMissingColumns=True)
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("oracle", "postgres")})
    rows = rows if kinds is None else rows.where(F.col("kind").isin(*kinds))
    t, c = F.trim("table_name"), F.trim("column_name")
    alter = _text("ALTER TABLE ", identifier(t))
    here = held("user_tab_columns", "table_name", t, c)
    note = F.coalesce(_filled(F.col("r.comments")), F.lit(""))
    add = _text(alter, " ADD (", identifier(c), " ", _type("r"), _default("r"), ")")
    missing = held("user_tables", "table_name", t)
    oracle = {
        "missing_table": F.col("oracle"),
        "missing_column": _text(guarded(_text(missing, " AND NOT ", here), add), F.when(note != "", _text("\n\n", guarded(here, _comment(t, c, note)))).otherwise("")),
        "data_type": guarded(here, _text(alter, " MODIFY (", identifier(c), " ", _type("r"), ")")),
        "data_default": guarded(here, _text(alter, " MODIFY (", identifier(c), " DEFAULT ", F.coalesce(_filled(F.col("r.data_default")), F.lit("NULL")), ")")),
        "comments": guarded(here, _comment(t, c, note)),
    }
    change = _text(alter, " ALTER COLUMN ", identifier(c))
    postgres = {
        "missing_table": F.col("postgres"),
        "missing_column": _text(alter, " ADD COLUMN IF NOT EXISTS ", identifier(c), " ", _type("r"), _default("r"), ";", F.when(note != "", _text("\n", _comment(t, c, note), ";")).otherwise("")),
        "data_type": _text(change, " TYPE ", _type("r"), " USING ", identifier(c), "::", _type("r"), ";"),
        "data_default": _text(change, F.coalesce(_text(" SET DEFAULT ", _filled(F.col("r.data_default"))), F.lit(" DROP DEFAULT")), ";"),
        "comments": _text(_comment(t, c, note), ";"),
    }
    made = F.lit(None).cast("string")
    for kind in oracle:
        same = F.col("kind").isin("data_type", "data_length") if kind == "data_type" else F.col("kind") == kind
        made = F.when(same, F.when(F.col("engine") == "oracle", oracle[kind]).otherwise(postgres[kind])).otherwise(made)
    why = F.when(F.col("kind") == "index_name", "index composition is not known").when(F.col("kind") == "column_name", "a rename is unsafe").when(F.col("kind") == "unknown", "unknown kind of discrepancy")
    why = why.when(F.col("engine").isNull(), "the target server is not loaded").when((F.col("kind") != "missing_table") & (c == ""), "no column name")
    why = why.when((F.col("kind") == "missing_table") & F.col("oracle").isNull(), "no reference metadata").when((F.col("kind") != "missing_table") & F.col("r").isNull(), "no reference metadata").when(made.isNull(), "too little metadata")
    return rows.select("id", "target", "table_name", "column_name", "kind", F.when(why.isNull(), made).alias("statement"), why.alias("skip_reason"))


def script_blocks(fixes: DataFrame, servers: DataFrame, reference: int) -> DataFrame:
    """(target, part, id, block) of each target's script in order: 0 its head, 1 each statement, the first of those that are the same, 2 each skipped discrepancy.

    A script is rows, so none is gathered in one place; ``write_scripts`` writes them in order.
    """
    fixes = written(fixes, "fixes")  # read three times
    name = servers.where(F.col("server_id") == reference).select("server_name").first()
    head = fixes.select("target").distinct().join(few(servers.select(F.col("server_id").alias("target"), "server_name")), "target", "left")
    head = head.select("target", F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), _text(f"-- reference: {name[0] if name else reference}\n-- target: ", F.coalesce("server_name", F.col("target").cast("string"), F.lit("unknown")), "\n-- review before it runs").alias("block"))
    done = fixes.where("statement is not null").groupBy("target", "table_name", "column_name", "kind", "statement").agg(F.min("id").alias("id"))
    column = F.when(F.trim("column_name") == "", "(table-level)").otherwise(F.col("column_name"))
    done = done.select("target", F.lit(1).alias("part"), "id", _text("-- discrepancy #", F.col("id").cast("string"), "\n-- table: ", F.col("table_name"), "\n-- column: ", column, "\n", F.col("statement")).alias("block"))
    skipped = fixes.where("skip_reason is not null").select("target", F.lit(2).alias("part"), "id", _text("-- #", F.col("id").cast("string"), ": ", F.col("skip_reason")).alias("block"))
    return head.unionByName(done).unionByName(skipped)


def write_scripts(blocks: DataFrame, path: str) -> None:
    """A folder of text files for each target, whose names and lines are in the order of its blocks."""
    ranges = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartitionByRange(ranges, "target", "part", "id").sortWithinPartitions("target", "part", "id")
    ordered.select("target", _text(F.col("block"), "\n").alias("value")).write.partitionBy("target").text(path)
