"""The stateful operators as streams give what their batch forms give."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from ledgerline.operators import quota, runs
from ledgerline.schemas import RUN_EVENT
from ledgerline.streaming.journal import run_states, write_journal
from ledgerline.streaming.quota import decide

SF = "/root/testdata/sf0.001"


def test_quota_stream_equals_batch_over_restarts(spark, tmp_path):
    calls = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "ts").where("user_id < 6")
    width, limit = 24 * 3600 * 1000, 2
    batch = {r.event_id: r.allowed for r in quota.decisions(calls, ["user_id", "event_type"], "ts", "event_id", limit, width).collect()}
    days = calls.orderBy("ts").toPandas()
    found = {}
    for i in range(2):
        part = days.iloc[i * len(days) // 2 : (i + 1) * len(days) // 2]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = decide(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), ["user_id", "event_type"], "ts", "event_id", limit, width)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        found[r.call_id] = r.allowed
    assert found == batch


def test_quota_stream_tells_keys_apart_as_the_batch_form_does(spark, tmp_path):
    rows = [("a:b", "c", "k1", 0), ("a", "b:c", "k2", 1), ("x", None, "k3", 2), (None, "x", "k4", 3), ("x", None, "k5", 4), ("x", None, "k6", None)]
    calls = spark.createDataFrame(rows, "one string, two string, ident string, s int").withColumn("at", F.timestamp_seconds("s"))
    batch = {r.ident: r.allowed for r in quota.decisions(calls, ["one", "two"], "at", "ident", 1, 60_000).collect()}
    assert batch == {"k1": True, "k2": True, "k3": True, "k4": True, "k5": False, "k6": False}
    calls.write.parquet(str(tmp_path / "in"))
    stream = decide(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), ["one", "two"], "at", "ident", 1, 60_000)
    stream.writeStream.format("memory").queryName("quota_keys").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.call_id: r.allowed for r in spark.table("quota_keys").collect()} == batch


def test_journal_stream_writes_json_lines(spark, tmp_path):
    calls = spark.createDataFrame([("u", "recall", "memory", True), (None, "recall", "memory", False)], "subject string, tool string, owner string, allowed boolean").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    write_journal(stream, quota.quota_error(F.col("allowed")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    lines = [json.loads(x) for p in Path(tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["subject"], x["outcome"], x.get("error_code")) for x in lines) == [("anonymous", "error", "QUOTA_EXCEEDED"), ("u", "ok", None)]


def test_run_states_stream(spark, tmp_path):
    rows = [("a", 0, "run.created", "{}"), ("a", 1, "run.completed", '{"status":"ok"}'), ("b", 0, "run.created", "{}")]
    events = spark.createDataFrame(rows, "run_id string, seq int, type string, payload string").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = run_states(spark.readStream.schema(RUN_EVENT).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, runs.lifecycle(events).collect()))
