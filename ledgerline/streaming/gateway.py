"""Calls to the journal as one stream, and sinks that write a replayed batch once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.gateway import entries, split_calls
from ..sources.buckets import BucketedLog
from .quota import decide


def journal_of_calls(calls: DataFrame, catalogue: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The journal of a stream of calls (call_id, subject, tool, at, ended), as :func:`~ledgerline.operators.gateway.handled` gives it
    for a table: tools are looked up in a static catalogue, and the quota is state."""
    counted, refused = split_calls(calls, catalogue)
    decided = decide(counted, ["subject", "tool"], "at", "call_id", limit, window_ms, ("subject", "tool", "owner", "at", "ended"))
    return entries(decided, refused)


def write_log(rows: DataFrame, log: BucketedLog, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append a stream to a log until what is there now has been read. A micro-batch is the log's batch ``<name>-<number>``: one that is
    run again replaces what it wrote before. A compaction of the log must spare the last of them."""
    return rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, log, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, number: int, log: BucketedLog, name: str = "stream") -> None:
    log.append(batch, batch=f"{name}-{number}")


COMPLETED = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("result", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("error", T.StringType())])


class FirstCompletion(StatefulProcessor):
    """Lets the first final attempt of each run through; later ones get an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", T.StructType([T.StructField("status", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts = pd.concat(list(rows)).sort_values(["at", "status"], kind="stable")
        final = attempts["status"].isin(["ok", "needs_clarification", "failed"])
        error = pd.Series("INVALID_INPUT", attempts.index, object).where(~final, "INVALID_OPERATION")
        if not self.done.exists() and final.any():
            place = final.to_numpy().argmax()
            error.iloc[place] = None
            self.done.update((attempts["status"].iloc[place],))
        yield attempts.assign(error=error)[COMPLETED.names]

    def close(self) -> None:
        pass


def completions(attempts: DataFrame) -> DataFrame:
    """Attempts to complete runs (run_id, status, result, at) with an ``error``, null for the first of each run with a final status. In one
    micro-batch attempts go by their time."""
    return attempts.select("run_id", "status", "result", "at").groupBy("run_id").transformWithStateInPandas(FirstCompletion(), COMPLETED, "Append", "None")
