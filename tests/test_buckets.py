"""Bucketed logs: one key opens one bucket, files stay few, and a compaction that is cut off loses nothing."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.operations import DATA
from ledgerline.sources.buckets import BucketedLog
from ledgerline.sources.tables import Store


@pytest.fixture
def log(spark, tmp_path):
    schema = spark.createDataFrame([], "run_id string, seq int, payload string").schema
    return BucketedLog(spark, str(tmp_path / "log"), schema, "run_id", 8)


def _rows(spark, n: int, at: int = 0):
    return spark.range(n).select(F.concat(F.lit("run-"), (F.col("id") % 20).cast("string")).alias("run_id"), (F.col("id") + at).cast("int").alias("seq"), F.lit("{}").alias("payload"))


def _all(frame) -> list:
    return sorted(map(tuple, frame.collect()))


def test_one_key_opens_one_bucket(spark, log):
    assert log.rows().count() == log.of("run-3").count() == 0
    written = log.append(_rows(spark, 100))
    assert _all(written) == _all(log.rows()) == _all(_rows(spark, 100))
    own = log.of("run-3")
    assert _all(own) == [("run-3", i, "{}") for i in range(3, 100, 20)]
    bucket = f"bucket={log.bucket_of('run-3')}"
    assert own.inputFiles() and all(f"/{bucket}/" in f for f in own.inputFiles())
    assert len({f.split("/bucket=")[1].split("/")[0] for f in log.rows().inputFiles()}) == 8
    assert log.append(_rows(spark, 0)).count() == 0


def test_files_stay_few_over_many_appends(spark, tmp_path):
    store = Store(spark, str(tmp_path), most=5)
    run = DATA.one("runs.create", store, service="s", tool="t", input=None)
    for i in range(14):
        event = DATA.one("runs.appendEvent", store, run_id=run.id.upper(), type="worker.started", payload={"i": i})
        assert event.seq == i
    events = store.of("run_events", run.id)
    assert len(events.inputFiles()) <= 7 and events.count() == 14
    folder = next(Path(tmp_path, "run_events").glob("bucket=*"))
    assert len(list(folder.glob("batch=*"))) <= 7
    assert not list(Path(tmp_path, "run_events", "_compaction").glob("*"))


@pytest.mark.parametrize("cut", ["before the marker", "after the marker", "between buckets"])
def test_a_compaction_that_is_cut_off(spark, log, monkeypatch, cut):
    for i in range(3):
        log.append(_rows(spark, 40, 100 * i))
    expected = _all(log.rows())
    if cut == "before the marker":
        merged = log._read(log.path).drop("batch")
        merged.write.partitionBy("bucket").parquet(f"{log.path}/_compaction/half")
        assert _all(log.rows()) == expected
    else:
        finish = BucketedLog._finish
        monkeypatch.setattr(BucketedLog, "_finish", lambda self: None)
        log.compact(1)
        monkeypatch.setattr(BucketedLog, "_finish", finish)
        assert _all(log.rows()) == expected and len(log._markers()) == 1
        if cut == "between buckets":  # one bucket was moved, and its old batches are still there
            made = next(Path(log.path, "_compaction").glob("*/bucket=*"))
            made.rename(Path(log.path, made.name, f"batch={made.parent.name}"))
    log.compact(1)
    assert _all(log.rows()) == expected
    assert all(len(names) == 1 for names in log.batches().values()) and not log._markers()
    assert log.compact(1) == []
