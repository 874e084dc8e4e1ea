"""Row contracts of the tables and of what operations return, and their versions."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of statuses, event types and error codes.
RUN_STATUSES = ["running", "ok", "needs_clarification", "failed"]
EVENT_TYPES = ["run.created", "worker.started", "worker.exited", "output.validated", "output.invalid", "run.completed"]
#: What may follow an event in a run's log; None is the beginning.
EVENT_ORDER = {
    None: ["run.created"],
    "run.created": ["worker.started"],
    "worker.started": ["worker.exited"],
    "worker.exited": ["output.validated", "output.invalid", "run.completed"],
    "output.validated": ["run.completed"],
    "output.invalid": ["run.completed"],
    "run.completed": [],
}
DATA_ERRORS = ["NOT_FOUND", "INVALID_INPUT", "INVALID_OPERATION"]
CALL_ERRORS = ["UNKNOWN_TOOL", "UNAUTHENTICATED", "QUOTA_EXCEEDED", "SERVICE_UNAVAILABLE"]
RESULT_ERRORS = ["INVALID_INPUT", "NEEDS_CLARIFICATION", "WORKER_UNAVAILABLE", "WORKER_FAILED", "WORKER_TIMEOUT", "WORKER_OUTPUT_INVALID", "DATA_UNAVAILABLE", "INTERNAL"]

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _row(*fields: tuple) -> T.StructType:
    """Of (name, type) or (name, type, nullable)."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


RUN = _row(("id", _S), ("service", _S), ("tool", _S), ("input", _S, True), ("status", _S), ("result", _S, True), ("created_at", _TS), ("completed_at", _TS, True))
RUN_EVENT = _row(("run_id", _S), ("seq", _I), ("type", _S), ("payload", _S), ("at", _TS))
MEMORY = _row(("id", _S), ("content", _S), ("tags", T.ArrayType(_S, False)), ("embedding", T.ArrayType(T.FloatType(), False), True), ("created_at", _TS))
MEMORY_ITEM = _row(("id", _S), ("content", _S), ("tags", T.ArrayType(_S, False)), ("score", _D))
COMPLETION = _row(("run_id", _S), ("status", _S), ("result", _S, True), ("at", _TS))
MEMORY_ID = _row(("id", _S))
VALUE = _row(("value", _S))
EVIDENCE = _row(("source", _S), ("ref", _S), ("excerpt", _S, True))
COST = _row(("input_tokens", _L), ("output_tokens", _L), ("usd", _D))
ERROR = _row(("code", _S), ("message", _S))
AUDIT = _row(("at", _S), ("subject", _S), ("tool", _S), ("owner", _S, True), ("outcome", _S), ("error_code", _S, True), ("duration_ms", _L))
SCHEMA_VERSION = _row(("version", _S), ("applied_at", _TS))

#: The logs of a store.
LOGS = {"runs": RUN, "run_events": RUN_EVENT, "completions": COMPLETION, "memories": MEMORY}
#: The column by which each is looked up.
KEYS = {"runs": "id", "run_events": "run_id", "completions": "run_id", "memories": "id"}

#: Versions of the tables, in order; a version is added and never changed.
VERSIONS = {"0001_runs": ["runs", "run_events"], "0002_memory": ["memories"], "0003_runs_immutable": []}


def result(data: T.DataType) -> T.StructType:
    """The envelope of an answer that carries ``data``."""
    return _row(("status", _S), ("data", data, True), ("evidence", T.ArrayType(EVIDENCE, False)), ("run_id", _S, True), ("cost", COST), ("error", ERROR, True))
