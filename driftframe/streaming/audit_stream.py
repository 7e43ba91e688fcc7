"""Audit entries and requests as streams."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from driftframe.operators.audit import GENESIS, canonical, link, outcome
from driftframe.operators.rules import TOOLS, capability_matrix
from driftframe.operators.shared import few


def audit_lines(log: DataFrame) -> DataFrame:
    """(value): a JSON line for each entry, with its severity."""
    return log.select(_line().alias("value"))


def _line() -> F.Column:
    severity = F.when(outcome("outcome_raw") == "allowed", 6).otherwise(4)
    return F.to_json(F.struct("id", "tool", "connection_id", outcome("outcome_raw").alias("outcome"), severity.alias("severity"), F.get_json_object("arguments", "$.target.object_type").alias("target")))


# ---------------------------------------------------------------- forwarding

#: Sends a line under a key; a line that is sent again has its old key. What it raises puts the line into quarantine.
Send = Callable[[str, str], None]
_TOLD = "id long, key string, value string, error string"


def _deliver(send: Send | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = frame["error"].tolist()
            for i, (key, value) in enumerate(zip(frame["key"], frame["value"], strict=True)):
                if errors[i] is None and send is not None:
                    try:
                        send(key, value)
                    except Exception as e:  # noqa: BLE001  one line's failure never fails the others
                        errors[i] = f"{type(e).__name__}: {e}"[:2_000]
            frame["error"] = pd.Series(errors, dtype=object, index=frame.index)
            yield frame

    return run


def forward(log: DataFrame, out: str, checkpoint: str, send: Send | None = None) -> None:
    """Deliver the stream's new entries as JSON lines, then stop; no entry fails the stream.

    Each batch is written as one folder by its number, with the error of the lines that could not be rendered or sent: a batch that is
    run again after a failure replaces its folder, so that ``delivered`` has each entry once, and sends under the same keys (batch
    and place of the entry among those of its id), by which a receiver knows what it has. Without ``send`` the folders are the sink.
    """

    def batch(df: DataFrame, number: int) -> None:
        why = F.when(F.col("id").isNull(), "no id").when(F.col("arguments").isNotNull() & F.try_parse_json(F.concat(F.lit("["), F.col("arguments"), F.lit("]"))).isNull(), "arguments are not JSON")
        rows = df.select("id", F.concat(F.lit(f"{number}:"), F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.sha2(_line(), 256)).alias("key"), _line().alias("value"), why.cast("string").alias("error"))
        told = rows if send is None else rows.mapInPandas(_deliver(send), _TOLD)
        told.write.mode("overwrite").parquet(f"{out}/batch={number}")

    log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def told(spark: SparkSession, out: str) -> DataFrame:
    """(id, key, value, error, batch) of all lines that ``forward`` wrote."""
    return spark.read.schema(f"{_TOLD}, batch long").option("basePath", out).parquet(f"{out}/batch=*")


def delivered(spark: SparkSession, out: str) -> DataFrame:
    return told(spark, out).where("error IS NULL")


def quarantine(spark: SparkSession, out: str) -> DataFrame:
    """Lines that failed, with the reason; they can be read as a table and sent again."""
    return told(spark, out).where("error IS NOT NULL")


# ---------------------------------------------------------------- chains as entries arrive

_STATE = "seq long, last_id long, last_hash string"


def chain_stream(log: DataFrame) -> DataFrame:
    """Links of entries as they arrive: the stream's columns with day, seq, prev_hash, hash and refused.

    A chain (connection and day) keeps its last number, id and hash, so that batches give the links that ``audit.with_chain`` gives all entries
    at once. An entry whose id is not above the chain's last one came too late to be linked in its place: it is refused, with the reason and
    without a link. Entries of a batch may come in any order; those that repeat an id in it are linked by their texts.
    """
    rows = log.withColumn("day", F.to_date("event_ts")).withColumn("body", canonical(log))
    schema = StructType(rows.drop("body").schema.fields).add("seq", "long").add("prev_hash", "string").add("hash", "string").add("refused", "string")
    names = schema.fieldNames()

    def run(key: tuple[int | None, datetime.date], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last_id, last = state.get if state.exists else (0, None, GENESIS)
        floor = last_id  # of the batches before
        rows = pd.concat(list(frames)).sort_values(["id", "body"], na_position="first", kind="stable")  # one chain's entries of one batch
        links = []
        for number, body in zip(rows["id"].tolist(), rows["body"].tolist(), strict=True):
            lost = pd.isna(number)
            if floor is not None and (lost or number <= floor):
                links.append((None, None, None, "no id" if lost else f"id {int(number)} comes after {int(floor)}"))
                continue
            before, seq = last, seq + 1
            last = link(before, body)
            last_id = last_id if lost else int(number)
            links.append((seq, before, last, None))
        state.update((seq, last_id, last))
        for at, name in enumerate(("seq", "prev_hash", "hash", "refused")):
            rows[name] = pd.Series([x[at] for x in links], index=rows.index, dtype="Int64" if name == "seq" else object)
        yield rows[names]

    return rows.groupBy("connection_id", "day").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- requests


def screen(requests: DataFrame, policies: DataFrame, rules: DataFrame, data_tools_disabled: bool = False) -> DataFrame:
    """Requests (connection_id, tool, ...) with the verdict of their connection's policy on their tool; stateless, against a static table.

    A connection without a policy, or a tool that none knows, is refused.
    """
    verdicts = few(capability_matrix(policies, rules, data_tools_disabled).select("connection_id", "tool", "allowed", "reason_code"))
    known = requests.join(verdicts, ["connection_id", "tool"], "left")
    return known.withColumn("reason_code", F.when(F.col("allowed").isNull(), "no_policy").otherwise(F.col("reason_code"))).withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as they land in ``path`` as Parquet."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def as_log(events: DataFrame) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "denied").when(F.col("event_type") == "purchase", "bogus").otherwise("allowed")
    return events.select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("tool"), (F.col("user_id") % 5).alias("connection_id"), raw.alias("outcome_raw"), F.lit('{"target":{"object_type":"TABLE"}}').alias("arguments"))


def as_requests(events: DataFrame) -> DataFrame:
    """(id, connection_id, tool): each event as a request for one of the tools."""
    tools = F.array(*(F.lit(t) for t, _, _ in TOOLS))
    return events.select((F.col("event_id") + 1).alias("id"), (F.col("user_id") % 100).cast("int").alias("connection_id"), F.element_at(tools, (F.col("event_id") % len(TOOLS) + 1).cast("int")).alias("tool"))
