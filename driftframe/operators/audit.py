"""The audit log: outcomes, hash chains by connection, verification, filters and export."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GENESIS = "0" * 64


def outcome(raw: str | F.Column) -> F.Column:
    """Known outcomes as they are; anything else is an error."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.when(raw.isin("allowed", "denied"), raw).otherwise(F.lit("error"))


#: Characters that JSON escapes: a short form for some, the code point in four small hexadecimal digits for all others below the space.
ESCAPES = {chr(c): f"\\u{c:04x}" for c in range(32)} | {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}


#: Those with a short form, the backslash first, as the forms of the others have one.
_SHORT = {c: ESCAPES[c] for c in '\\"\b\f\n\r\t'}


def json_text(c: str | F.Column) -> F.Column:
    """A text as a JSON string. Short forms are plain replacements; only a text with one of the other characters below the space is walked one by one."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))
    walked = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    short = c
    for raw, said in _SHORT.items():
        short = F.replace(short, F.lit(raw), F.lit(said))
    return F.concat(F.lit('"'), F.when(~c.rlike(r'[\x00-\x1f"\\]'), c).when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), walked).otherwise(short), F.lit('"'))


def canonical(log: DataFrame) -> F.Column:
    """JSON array text of an entry's twelve fields, built part by part so that it is the same in every engine; what is null is ``null``."""
    number = lambda c: F.col(c).cast("string")
    when = F.concat(F.lit('"'), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    parts = [number("id"), when, json_text("tool"), number("connection_id"), json_text("connection_name"), json_text("arguments"), json_text(outcome("outcome_raw")), json_text("reason"), number("row_count"), number("bytes"), number("duration_ms"), json_text("client_name")]
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(p, F.lit("null")) for p in parts)), F.lit("]"))


def link(before: str, body: str) -> str:
    """The hash of an entry after another."""
    return hashlib.sha256(f"{before}\n{body}".encode()).hexdigest()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with their links. They come sorted, with their text in the last column; what is kept from batch to batch is the last link."""
    chain, seq, last = None, 0, GENESIS
    for batch in batches:
        keys = list(zip(batch.column("connection_id").to_pylist(), batch.column("day").to_pylist(), strict=True))
        numbers, before, own = [], [], []
        for key, body in zip(keys, batch.column("body").to_pylist(), strict=True):
            if key != chain:
                chain, seq, last = key, 0, GENESIS
            seq += 1
            before.append(last)
            last = link(last, body)
            numbers.append(seq)
            own.append(last)
        columns = [*batch.columns[:-1], pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "seq", "prev_hash", "hash"])


def with_chain(log: DataFrame) -> DataFrame:
    """Entries with day, seq, prev_hash and hash: one chain for each connection and day, by id.

    Entries without a connection are a chain of their own for each day; of those that repeat an id the one with the smaller text comes first, so
    every entry has one link. A chain is a fold, so one task walks it, in time and rows that grow in proportion, and holds a batch and
    the last link; the entries' columns go through it, so that nothing is joined back.
    """
    rows = log.withColumn("day", F.to_date("event_ts"))
    key = ["connection_id", "day"]
    ready = rows.withColumn("body", canonical(log)).repartition(*key).sortWithinPartitions(*key, "id", "body")
    schema = StructType(rows.schema.fields).add("seq", "long").add("prev_hash", "string").add("hash", "string")
    return ready.mapInArrow(_fold, schema)


def verify_chain(chain: DataFrame, issued: DataFrame) -> DataFrame:
    """(connection_id, day, ok, entries, first_bad, problem) of each chain; ``issued`` has (connection_id, day, issued).

    Links are checked row by row in parallel: the numbering, the previous hash, then the entry's own hash; the first
    violation counts, and a chain that stops short of what was issued was truncated.
    """
    w = Window.partitionBy("connection_id", "day").orderBy("seq")
    before = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    own = F.sha2(F.concat("prev_hash", F.lit("\n"), canonical(chain)), 256)
    problem = F.when(F.col("seq") != F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1, "missing").when(F.col("prev_hash") != before, "broken link").when(own != F.col("hash"), "modified")
    rows = chain.withColumn("problem", problem)
    bad = F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "problem")))
    found = rows.groupBy("connection_id", "day").agg(bad.alias("bad"), F.count("*").alias("n"))
    both = found.unionByName(issued.select("connection_id", "day", "issued"), allowMissingColumns=True)  # grouped, as a null connection is one too
    found = both.groupBy("connection_id", "day").agg(F.max("bad").alias("bad"), F.max("n").alias("n"), F.max("issued").alias("issued"))
    n = F.coalesce("n", F.lit(0))
    first = F.coalesce(F.col("bad.seq"), F.when(F.col("issued") > n, n + 1))
    text = F.coalesce(F.col("bad.problem"), F.when(F.col("issued") > n, "truncated"))
    return found.select("connection_id", "day", text.isNull().alias("ok"), F.coalesce(F.col("bad.seq") - 1, n).cast("long").alias("entries"), first.cast("long").alias("first_bad"), text.alias("problem"))


def target_names(arguments: str = "arguments") -> F.Column:
    return F.from_json(F.get_json_object(arguments, "$.target.names"), "array<string>")


def target_summary(arguments: str = "arguments", shown: int = 2) -> F.Column:
    """``TYPE A, B (+n more)`` of the target in the arguments' JSON."""
    names = target_names(arguments)
    more = F.when(F.size(names) > shown, F.concat(F.lit(" (+"), (F.size(names) - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.get_json_object(arguments, "$.target.object_type"), F.lit(" "), F.array_join(F.slice(names, 1, shown), ", "), more)


def filter_audit(log: DataFrame, connection: int | None = None, tool: str | None = None, result: str | None = None, target: str | None = None, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Entries that meet all given conditions; a bare stop date covers its whole day."""
    when = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    for on, condition in (
        (connection is not None, F.col("connection_id") == connection),
        (tool, F.col("tool") == tool),
        (result, outcome("outcome_raw") == result),
        (target, F.lower(F.get_json_object("arguments", "$.target.names")).contains((target or "").lower())),
        (start, when >= (start or "")),
        (stop, F.substring(when, 1, len(stop or "")) <= (stop or "") if stop and len(stop) == 10 else when <= (stop or "")),
    ):
        if on:
            log = log.where(condition)
    return log


def csv_field(c: F.Column) -> F.Column:
    """Quoted where needed, with a guard against spreadsheet formulas."""
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(guarded.rlike(r"[,\"\n\r]") | guarded.startswith("'"), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def audit_csv_rows(log: DataFrame) -> DataFrame:
    """(id, line): the export's lines, oldest first: ranges of ids, each sorted."""
    fields = [F.col("id").cast("string"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"), F.col("tool"), F.col("connection_id").cast("string"), F.col("connection_name"), outcome("outcome_raw"), F.col("reason"), F.col("row_count").cast("string"), F.col("bytes").cast("string"), F.col("duration_ms").cast("string"), target_summary(), F.col("arguments")]
    return log.select("id", F.concat_ws(",", *(csv_field(F.coalesce(f, F.lit(""))) for f in fields)).alias("line")).orderBy("id")


def usage_digest(log: DataFrame) -> DataFrame:
    """Calls, denials, errors, rows, bytes and durations, with the 95th percentile, by tool and connection."""
    o = outcome("outcome_raw")
    return log.groupBy("tool", "connection_id").agg(F.count("*").alias("calls"), F.count_if(o == "denied").alias("denials"), F.count_if(o == "error").alias("errors"), F.sum("row_count").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.sum("duration_ms").alias("duration_ms"), F.round(F.percentile("duration_ms", F.lit(0.95)), 6).alias("p95_ms"), F.max("duration_ms").alias("longest_ms"))
