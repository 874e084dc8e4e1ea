"""The anchored quota as a stream: one window start and one counter of state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import json_key, window_starts

STATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("used", T.LongType())])


def decision(ident: T.DataType, carried: tuple[T.StructField, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("call_id", ident), T.StructField("window_start", T.LongType()), T.StructField("allowed", T.BooleanType()), *carried])


class AnchoredQuota(StatefulProcessor):
    """Decides calls (key, call_id, us) in the order in which they arrive; in one batch by time and id. A call without a time
    is denied and leaves the window as it is. The columns ``carry`` go along."""

    def __init__(self, limit: int, window_ms: int, carry: tuple[str, ...] = ()):
        self.limit, self.width, self.carry = limit, window_ms * 1000, list(carry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["us", "call_id"])
        none = calls["us"].isna()
        late, calls = calls[none], calls[~none]
        if len(late):
            yield pd.DataFrame({"key": key[0], "call_id": late["call_id"], "window_start": pd.array([None] * len(late), "Int64"), "allowed": False, **{c: late[c] for c in self.carry}})
        if not len(calls):
            return
        known = self.window.exists()
        start, used = self.window.get() if known else (0, 0)
        # a call that arrives late belongs to the open window; times count from when that began
        us = calls["us"].to_numpy(np.int64)
        line = np.maximum(us, start) if known else us
        one = np.array([0, len(line)])
        starts, numbers = window_starts(line, np.zeros(len(line), np.int64), one, self.width, np.array([start]), np.array([known]), np.array([used]))
        self.window.update((int(starts[-1]), int(numbers[-1])))
        yield pd.DataFrame({"key": key[0], "call_id": calls["call_id"], "window_start": starts, "allowed": numbers <= self.limit, **{c: calls[c] for c in self.carry}})

    def close(self) -> None:
        pass


def decide(calls: DataFrame, keys: list[str], at: str, ident: str, limit: int, window_ms: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decisions over a stream of calls: ``key`` (the keys as JSON, as in the batch form), ``call_id`` (``ident`` as it
    is), ``window_start`` in microseconds and ``allowed``, then the columns ``carry``. The session must use the RocksDB state store."""
    keyed = calls.select(json_key(keys).alias("key"), F.col(ident).alias("call_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), *carry)
    out = decision(calls.schema[ident].dataType, tuple(calls.schema[c] for c in carry))
    return keyed.groupBy("key").transformWithStateInPandas(AnchoredQuota(limit, window_ms, carry), out, "Append", "None")
