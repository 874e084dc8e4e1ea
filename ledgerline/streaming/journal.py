"""The journal and the state of runs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import journal
from ..operators.runs import lifecycle


def write_journal(calls: DataFrame, error: Column, path: str, checkpoint: str, at: str = "at", ended: str | None = None) -> StreamingQuery:
    """Append a JSON line for each call of a stream, until what is there now has been read."""
    return journal(calls, error, at, ended).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run as its events arrive, as in the batch form; to be written in update or complete mode."""
    return lifecycle(events)
