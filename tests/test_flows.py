"""Flows over calls and runs: streams, with restarts, give what their batch forms give, and replayed batches write once."""

from __future__ import annotations

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import gateway, runs
from ledgerline.sources.buckets import BucketedLog
from ledgerline.streaming.gateway import COMPLETED, completions, journal_of_calls, write_batch, write_log
from ledgerline.streaming.lifecycle import order_faults

GOOD = ["run.created", "worker.started", "worker.exited", "output.validated", "run.completed"]
RUNS = {
    "good": GOOD,
    "failed": ["run.created", "worker.started", "worker.exited", "run.completed"],
    "twice": ["run.created", "run.created", "worker.started"],
    "headless": ["worker.started", "worker.exited"],
    "late": [*GOOD, "worker.exited", "run.completed"],
    "hasty": ["run.created", "run.completed"],
    "unchecked": ["run.created", "worker.started", "output.validated"],
    "odd": ["run.created", "what"],
    "open": ["run.created", "worker.started"],
}
FAULTS = {
    ("twice", 1): "run.created after run.created",
    ("headless", 0): "worker.started after nothing",
    ("late", 5): "worker.exited after completion",
    ("late", 6): "run.completed after completion",
    ("hasty", 1): "run.completed after run.created",
    ("unchecked", 2): "output.validated after worker.started",
    ("odd", 1): "what after run.created",
    ("gap", 2): "gap in the sequence",
}


@pytest.fixture(scope="module")
def events(spark):
    rows = [(run, i, kind) for run, kinds in RUNS.items() for i, kind in enumerate(kinds)] + [("gap", 0, "run.created"), ("gap", 2, "worker.exited")]
    return spark.createDataFrame(rows, "run_id string, seq int, type string")


def _run(stream, out: Path, state: Path):
    """One micro-batch: with timers there is always one more to run."""
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(once=True).start().awaitTermination()


def test_order_faults_are_named(events):
    found = {(r.run_id, r.seq): r.fault for r in runs.order_faults(events).collect()}
    assert len(found) == events.count() and {k: v for k, v in found.items() if v} == FAULTS


def test_order_stream_equals_the_batch_form_over_a_restart_and_finds_abandoned_runs(spark, events, tmp_path):
    for part in ("seq < 2", "seq >= 2"):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _run(order_faults(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 600_000), tmp_path / "out", tmp_path / "state")
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert found == sorted(map(tuple, runs.order_faults(events).collect()), key=str)


def test_runs_that_stay_open_are_abandoned(spark, events, tmp_path):
    own = events.where("run_id IN ('open', 'good', 'failed')")
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: order_faults(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 200)
    _run(stream(), tmp_path / "out", tmp_path / "state")
    time.sleep(0.5)
    spark.createDataFrame([("next", 0, "run.created")], events.schema).write.mode("append").parquet(str(tmp_path / "in"))
    _run(stream(), tmp_path / "out", tmp_path / "state")
    gone = spark.read.parquet(str(tmp_path / "out")).where("type IS NULL").collect()
    assert ("open", 1, None, "abandoned") in map(tuple, gone) and {r.run_id for r in gone} <= {"open", "next"}


def test_calls_to_journal_as_one_stream_equals_the_batch_form(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 8")
    calls = source.select(F.col("event_id").alias("call_id"), F.when(F.col("user_id") > 1, F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("at")).withColumn("ended", F.timestamp_micros(F.unix_micros("at") + 5000))
    catalogue = spark.createDataFrame([("view", "web"), ("click", "web"), ("purchase", "shop")], "tool string, owner string")
    width = 5 * 24 * 3600 * 1000
    expected = sorted(map(tuple, gateway.handled(calls, catalogue, 2, width).collect()))
    assert {r[6] for r in expected} == {None, "UNKNOWN_TOOL", "UNAUTHENTICATED", "QUOTA_EXCEEDED"} and {r[7] for r in expected} == {5}
    assert all(r[2] == "anonymous" for r in expected if r[6] in ("UNKNOWN_TOOL", "UNAUTHENTICATED"))
    ordered = calls.orderBy("at").toPandas()
    for i in range(2):  # the second run goes on from the checkpoint of the first
        spark.createDataFrame(ordered.iloc[i * len(ordered) // 2 : (i + 1) * len(ordered) // 2], calls.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = journal_of_calls(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), catalogue, 2, width)
        stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    names = ["call_id", "at", "subject", "tool", "owner", "outcome", "error_code", "duration_ms"]
    assert sorted(tuple(x.get(n) for n in names) for x in lines) == expected


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    schema = spark.createDataFrame([], "run_id string, seq int").schema
    log = BucketedLog(spark, str(tmp_path / "log"), schema, "run_id", 4)
    rows = spark.range(50).selectExpr("concat('r', id) AS run_id", "int(id) AS seq")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write_log(stream(), log, str(tmp_path / "state")).awaitTermination()
    assert log.rows().count() == 50 and {x for names in log.batches().values() for x in names} == {"stream-0"}
    write_batch(rows, 0, log)  # the batch comes again
    assert log.rows().count() == 50
    # the commit of the last batch is lost, so the stream runs it again
    for p in (tmp_path / "state" / "commits").glob("*"):
        p.unlink()
    write_log(stream(), log, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.seq for r in log.rows().collect()) == list(range(50))
    assert log.compact(0, "stream-0") == [] and log.append(rows).count() == 50 and log.rows().count() == 100


def test_the_first_completion_wins_over_restarts(spark, tmp_path):
    rows = [("a", "running", 0), ("a", "ok", 1), ("a", "failed", 2), ("b", "failed", 3), ("a", "ok", 4), ("b", "ok", 5), ("c", None, 6)]
    attempts = spark.createDataFrame([(r, s, "{}", t) for r, s, t in rows], "run_id string, status string, result string, t int").withColumn("at", F.timestamp_seconds("t")).drop("t")
    for part in ("at < timestamp_seconds(3)", "at >= timestamp_seconds(3)"):
        attempts.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _run(completions(spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in"))), tmp_path / "out", tmp_path / "state")
    out = spark.read.schema(COMPLETED).parquet(str(tmp_path / "out"))
    found = {(r.run_id, int(r["at"].timestamp())): r.error for r in out.collect()}
    assert found == {("a", 0): "INVALID_INPUT", ("a", 1): None, ("a", 2): "INVALID_OPERATION", ("b", 3): None, ("a", 4): "INVALID_OPERATION", ("b", 5): "INVALID_OPERATION", ("c", 6): "INVALID_INPUT"}
    known = spark.createDataFrame([(x,) for x in "abc"], "id string").selectExpr("id", "'s' service", "'t' tool", "'null' input", "'running' status", "string(null) result", "current_timestamp() created_at", "timestamp(null) completed_at")
    state = {r.id: r.status for r in runs.settle(known, attempts, "at")[0].collect()}
    assert state == {"a": "ok", "b": "failed", "c": "running"}
