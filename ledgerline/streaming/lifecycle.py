"""The order of a run's events as a stateful stream, and runs that never end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import EVENT_ORDER

FAULTS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("fault", T.StringType())])
STATE = T.StructType([T.StructField("type", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("done", T.BooleanType())])


class EventOrder(StatefulProcessor):
    """An automaton over the types of a run's events, which are read by number. A run without an event for ``patience_ms``
    that is not complete is abandoned; its next event begins its patience anew."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before, at, done = self.last.get() if self.last.exists() else (None, -1, False)
        faults = []
        for kind, seq in zip(events["type"], events["seq"].tolist(), strict=True):
            if done:
                fault = f"{kind} after completion"
            elif seq != at + 1:
                fault = "gap in the sequence"
            else:
                fault = None if kind in EVENT_ORDER.get(before, []) else f"{kind} after {before or 'nothing'}"
            faults.append(fault)
            before, at, done = kind, max(at, seq), done or kind == "run.completed"
        self.last.update((before, at, done))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if not done:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield events.assign(fault=pd.Series(faults, events.index, object))[FAULTS.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, at, _ = self.last.get()
        yield pd.DataFrame({"run_id": [key[0]], "seq": pd.array([at], "Int32"), "type": [None], "fault": ["abandoned"]})

    def close(self) -> None:
        pass


def order_faults(events: DataFrame, patience_ms: int) -> DataFrame:
    """Each event of a stream (run_id, seq, type) with the fault that :func:`~ledgerline.operators.runs.order_faults` gives it in
    a table, if a run's events arrive in order; and for a run that stays open ``patience_ms`` without an event a row without a type
    and with the fault ``abandoned``."""
    return events.select("run_id", "seq", "type").groupBy("run_id").transformWithStateInPandas(EventOrder(patience_ms), FAULTS, "Append", "ProcessingTime")
