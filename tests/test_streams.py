"""Streams: forwarding that no entry fails, chains as entries arrive."""

import datetime
import json

import pytest
from driftframe.operators import audit
from driftframe.plans import registry, surface
from driftframe.streaming import audit_stream
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

ENTRY = "id long, event_ts timestamp_ntz, tool string, connection_id long, connection_name string, arguments string, outcome_raw string, reason string, row_count long, bytes long, duration_ms long, client_name string"
START = datetime.datetime(2024, 1, 1)


def entry(i, connection=1, arguments="{}", reason="", day=0):
    return (i, START + datetime.timedelta(days=day), "view", connection, "c", arguments, "allowed", reason, 1, 2, 3, "x")


def landed(spark, path, *batches):
    """A stream of one file for each batch."""
    for rows in batches:
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(path)


def sender(folder, poison=()):
    """A receiver that keeps a file for each key, and refuses lines of some ids; made here, so that it is sent by its code."""

    def send(key, value):
        import hashlib
        import json
        import os

        if json.loads(value).get("id") in poison:
            raise ConnectionError("refused")
        with open(os.path.join(folder, hashlib.sha256(key.encode()).hexdigest()), "a") as f:
            f.write(value + "\n")

    return send


def test_a_poison_entry_lands_in_quarantine(spark, tmp_path):
    (tmp_path / "sink").mkdir()
    log = landed(spark, f"{tmp_path}/log", [entry(1), entry(2), entry(None), entry(4, arguments="{broken")], [entry(5), entry(6, arguments=None), entry(1)])
    audit_stream.forward(log, f"{tmp_path}/out", f"{tmp_path}/state", sender(f"{tmp_path}/sink", poison=(2,)))
    assert sorted(r.id for r in audit_stream.delivered(spark, f"{tmp_path}/out").collect()) == [1, 1, 5, 6]
    got = sorted(((r.id or 0), r.error, r.batch) for r in audit_stream.quarantine(spark, f"{tmp_path}/out").collect())
    assert got == [(0, "no id", 0), (2, "ConnectionError: refused", 0), (4, "arguments are not JSON", 0)]
    assert len(list((tmp_path / "sink").iterdir())) == 4


def test_a_stream_that_is_killed_and_started_again_delivers_each_entry_once(spark, tmp_path, monkeypatch):
    """The driver dies after a batch was written and before Spark knew."""
    (tmp_path / "sink").mkdir()
    landed(spark, f"{tmp_path}/log", [entry(i) for i in range(1, 6)])
    writer = type(spark.range(1).write)
    plain, left = writer.parquet, [1]

    def dies(self, path, *args, **kwargs):
        plain(self, path, *args, **kwargs)
        if "/out/batch=" in path and left:
            left.pop()
            raise RuntimeError("killed")

    start = lambda: audit_stream.forward(spark.readStream.schema(ENTRY).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/state", sender(f"{tmp_path}/sink"))
    monkeypatch.setattr(writer, "parquet", dies)
    with pytest.raises(PySparkException, match="killed"):
        start()
    monkeypatch.setattr(writer, "parquet", plain)
    start()
    landed(spark, f"{tmp_path}/log", [entry(i) for i in range(6, 9)])
    start()
    assert sorted(r.id for r in audit_stream.delivered(spark, f"{tmp_path}/out").collect()) == list(range(1, 9))
    files = list((tmp_path / "sink").iterdir())
    assert len(files) == 8  # sent twice, under one key
    assert sorted(len(f.read_text().splitlines()) for f in files) == [1] * 3 + [2] * 5


def test_chains_grow_over_batches(spark, tmp_path):
    first = [entry(3), entry(1), entry(2, reason="b"), entry(2, reason="a"), entry(7, None), entry(9, 2, day=1)]
    second = [entry(5), entry(4), entry(8, None), entry(10, 2, day=1), entry(11, 2, day=2)]
    log = landed(spark, f"{tmp_path}/log", first, second)
    links = audit_stream.chain_stream(log)
    links.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(links.schema).parquet(f"{tmp_path}/out")
    whole = audit.with_chain(spark.createDataFrame(first + second, ENTRY))
    assert sorted(map(str, rows.drop("refused").collect())) == sorted(map(str, whole.collect()))
    assert rows.where("refused IS NOT NULL").count() == 0
    issued = rows.groupBy("connection_id", "day").agg(F.max("seq").alias("issued"))
    assert all(r.ok for r in audit.verify_chain(rows, issued).collect())


def test_ids_that_come_too_late_are_refused(spark, tmp_path):
    log = landed(spark, f"{tmp_path}/log", [entry(1), entry(5)], [entry(3), entry(5, reason="again"), entry(None), entry(6)])
    links = audit_stream.chain_stream(log)
    links.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(links.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(((r.id or 0), r.seq, r.refused) for r in rows if r.refused or r.id == 6) == [(0, None, "no id"), (3, None, "id 3 comes after 5"), (5, None, "id 5 comes after 5"), (6, 3, None)]
    assert next(r for r in rows if r.id == 6).prev_hash == next(r for r in rows if r.id == 5 and not r.refused).hash


def test_the_log_lands_in_many_files_and_is_linked_part_by_part(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(surface, "scratch", lambda _: str(tmp_path / "run"))
    rows = registry.QUERIES["au2_stream"](spark, sf_dir)
    assert rows.where("refused IS NOT NULL").isEmpty()
    assert len(list((tmp_path / "run/log").glob("part-*.parquet"))) > 4  # no part is one task's
    assert sorted(p.name for p in (tmp_path / "run/state/commits").glob("[0-9]*")) == list("0123")


def test_json_texts_with_short_forms_are_not_walked(spark):
    texts = [chr(c) for c in range(32)] + ['{"a":"b\\\\n"}', "\\\n\t\"", "a\x01\"\\", "plain é", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", audit.json_text("t").alias("j"))
    assert all(r.j == (None if r.t is None else json.dumps(r.t, ensure_ascii=False)) for r in rows.collect())
    assert "replace(" in rows._jdf.queryExecution().optimizedPlan().toString()
