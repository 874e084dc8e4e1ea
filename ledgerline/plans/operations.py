"""Named operations over a store: what each takes, how it is carried out, what it returns and how it fails."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import memory, runs
from ..schemas import EVENT_TYPES, MEMORY_ID, MEMORY_ITEM, RUN, RUN_EVENT, RUN_STATUSES, VALUE
from ..sources.tables import Store

#: Length of the vectors of memories.
DIMENSION = 384

#: A check returns what is wrong with a value, else None.
Check = Callable[[object], str | None]
#: Builds an answer from the store and the arguments.
Build = Callable[..., DataFrame]


class OperationError(Exception):
    """A failure with a name."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def text(least: int = 0) -> Check:
    return lambda v: None if isinstance(v, str) and len(v) >= least else f"must be a text of {least} characters or more"


def run_id(v: object) -> str | None:
    ok = isinstance(v, str) and re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v)
    return None if ok else "must be a UUID"


def one_of(known: list[str]) -> Check:
    return lambda v: None if v in known else f"must be one of {', '.join(known)}"


def whole(low: int, high: int) -> Check:
    return lambda v: None if isinstance(v, int) and not isinstance(v, bool) and low <= v <= high else f"must be an integer from {low} to {high}"


def texts(v: object) -> str | None:
    return None if isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v) else "must be a list of texts"


def vector(n: int) -> Check:
    def check(v: object) -> str | None:
        ok = isinstance(v, (list, tuple)) and len(v) == n and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v)
        return None if ok else f"must be a list of {n} finite numbers"

    return check


def json_value(v: object) -> str | None:
    try:
        json.dumps(v, allow_nan=False)
    except (TypeError, ValueError):
        return "must be a JSON value"
    return None


def json_object(v: object) -> str | None:
    return json_value(v) if isinstance(v, dict) and all(isinstance(k, str) for k in v) else "must be a JSON object"


@dataclass(frozen=True)
class Operation:
    """Parameters by name and check. Those without a default and not ``optional`` must be given. ``variants`` are tried in
    order, by an optional parameter that must be given, or None."""

    name: str
    parameters: Mapping[str, Check]
    variants: list[tuple[str | None, Build]]
    returns: T.StructType
    defaults: Mapping[str, object] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()

    def __post_init__(self):
        if not self.variants or self.variants[-1][0] is not None:
            raise ValueError(f"the last variant of {self.name} must have no condition")
        for need in [n for n, _ in self.variants if n is not None] + [*self.defaults, *self.optional]:
            if need not in self.parameters:
                raise ValueError(f"{self.name} has no parameter {need}")

    def checked(self, given: Mapping[str, object]) -> dict[str, object]:
        """The values to build with; a wrong, unknown or missing one is ``INVALID_INPUT``."""
        values = {**self.defaults, **given}
        for k in {**values, **self.parameters}:
            wrong = "is not a parameter" if k not in self.parameters else None if k in self.optional and k not in values else "is missing" if k not in values else self.parameters[k](values[k])
            if wrong:
                raise OperationError("INVALID_INPUT", f"{self.name}: {k} {wrong}")
        return {k: v.lower() if self.parameters[k] is run_id else v for k, v in values.items()}  # ids are equal whatever their case

    def view(self, name: str, *keep: str) -> Operation:
        """The same operation under a name that takes only some of its parameters."""
        dropped = set(self.parameters) - set(keep)
        if set(keep) - set(self.parameters) or dropped - self.optional - set(self.defaults):
            raise ValueError(f"{name} can't be {self.name} with {', '.join(keep)}")
        kept = [(need, build) for need, build in self.variants if need not in dropped]
        return replace(self, name=name, parameters={k: self.parameters[k] for k in keep}, variants=kept, defaults={k: v for k, v in self.defaults.items() if k in keep}, optional=self.optional & set(keep))


def named_failure(error: PySparkException, names: Mapping[str, str]) -> OperationError | None:
    """The failure that stands for Spark's error condition in ``names``, a whole condition before its first part. Spark's
    own message is not passed on."""
    condition = error.getCondition() or ""
    code = names.get(condition, names.get(condition.partition(".")[0]))
    return OperationError(code, code.lower().replace("_", " ", 1)) if code else None


class Operations:
    def __init__(self, *known: Operation, failures: Mapping[str, str] | None = None):
        self.known, self.failures = {o.name: o for o in known}, failures or {}
        if len(self.known) != len(known):
            raise ValueError("two operations have one name")

    def only(self, *names: str) -> Operations:
        """A view of some operations."""
        return Operations(*[self.known[n] for n in names], failures=self.failures)

    def execute(self, name: str, store: Store, **given) -> DataFrame:
        """Carry out an operation. Its answer has the schema that it declares; anything else is a fault of ours."""
        if name not in self.known:
            raise OperationError("NOT_FOUND", f"unknown operation {name}")
        operation = self.known[name]
        values = operation.checked(given)
        build = next(b for need, b in operation.variants if need is None or need in values)
        try:
            out = build(store, **values)
        except PySparkException as e:
            named = named_failure(e, self.failures)
            if named is None:
                raise
            raise named from None
        found = [(f.name, f.dataType.simpleString()) for f in out.schema]
        if found != [(f.name, f.dataType.simpleString()) for f in operation.returns]:
            raise AssertionError(f"{name} returned {found}")
        return out

    def one(self, name: str, store: Store, **given) -> Row:
        """The one row of an answer; none is a failure."""
        rows = self.execute(name, store, **given).take(1)
        if not rows:
            raise OperationError("NOT_FOUND", f"{name} found nothing")
        return rows[0]


def _known_run(store: Store, ident: str) -> DataFrame:
    """The current state of a run as a table of one row."""
    own = runs.run(store.of("runs", ident), ident)
    if own.isEmpty():
        raise OperationError("NOT_FOUND", "unknown run")
    return runs.settle(own, store.of("completions", ident), "at")[0]


def _get(store: Store, run_id: str) -> DataFrame:
    return _known_run(store, run_id)


def _create(store: Store, service: str, tool: str, input) -> DataFrame:
    asked = store.spark.createDataFrame([(service, tool, json.dumps(input))], "service string, tool string, input string")
    return store.append("runs", runs.created(asked))


def _append_event(store: Store, run_id: str, type: str, payload: dict) -> DataFrame:
    _known_run(store, run_id)
    new = store.spark.createDataFrame([(run_id, type, json.dumps(payload))], "run_id string, type string, payload string").withColumn("at", F.current_timestamp())
    return store.append("run_events", runs.appended(store.of("run_events", run_id), new, "at"))


def _complete(store: Store, run_id: str, status: str, result) -> DataFrame:
    if _known_run(store, run_id).first()["status"] != "running":
        raise OperationError("INVALID_OPERATION", "the run is complete")
    new = store.spark.createDataFrame([(run_id, status, json.dumps(result))], "run_id string, status string, result string")
    store.append("completions", new.withColumn("at", F.current_timestamp()))
    return _known_run(store, run_id)


def _events(store: Store, run_id: str) -> DataFrame:
    own = store.of("run_events", run_id)
    return runs.events_json(_known_run(store, run_id), own, "id", "run_id", runs.event_item(), F.col("seq").isNotNull()).select("value")


def _insert(store: Store, content: str, tags: list[str], embedding: list[float] | None = None) -> DataFrame:
    item = store.spark.createDataFrame([(content, list(tags), None if embedding is None else [float(x) for x in embedding])], "content string, tags array<string>, embedding array<float>")
    return store.append("memories", memory.inserted(item, DIMENSION)).select("id")


def _by_text(store: Store, query: str, limit: int) -> DataFrame:
    return memory.search_text(store.table("memories"), query, limit).select(*MEMORY_ITEM.names)


def _by_vector(store: Store, query: str, embedding: list[float], limit: int) -> DataFrame:
    return memory.search_vector(store.table("memories"), embedding, limit).select(*MEMORY_ITEM.names)


DATA = Operations(
    Operation("runs.create", {"service": text(), "tool": text(), "input": json_value}, [(None, _create)], RUN),
    Operation("runs.appendEvent", {"run_id": run_id, "type": one_of(EVENT_TYPES), "payload": json_object}, [(None, _append_event)], RUN_EVENT, {"payload": {}}),
    Operation("runs.complete", {"run_id": run_id, "status": one_of(RUN_STATUSES[1:]), "result": json_value}, [(None, _complete)], RUN),
    Operation("runs.get", {"run_id": run_id}, [(None, _get)], RUN),
    Operation("runs.events", {"run_id": run_id}, [(None, _events)], VALUE),
    Operation("memory.insert", {"content": text(1), "tags": texts, "embedding": vector(DIMENSION)}, [(None, _insert)], MEMORY_ID, {"tags": []}, frozenset({"embedding"})),
    Operation("memory.search", {"query": text(), "embedding": vector(DIMENSION), "limit": whole(1, memory.MOST)}, [("embedding", _by_vector), (None, _by_text)], MEMORY_ITEM, {"limit": memory.DEFAULT_LIMIT}, frozenset({"embedding"})),
    failures={"PATH_NOT_FOUND": "NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND": "NOT_FOUND"},
)


@dataclass(frozen=True)
class Tool:
    """An operation under a tool's name. ``internal`` ones are for workers of the owner alone."""

    owner: str
    operation: Operation
    internal: bool = False


_search, _store = DATA.known["memory.search"], DATA.known["memory.insert"]
TOOLS = [
    Tool("memory", replace(_search.view("recall", "query", "limit"), parameters={"query": text(1), "limit": whole(1, memory.MOST)})),
    Tool("memory", _store.view("remember", "content", "tags")),
    Tool("memory", _search.view("memory_search", "query", "limit"), internal=True),
    Tool("memory", _store.view("memory_insert", "content", "tags"), internal=True),
]


def tools_of(owner: str, internal: bool) -> Operations:
    """The tools that an owner serves; to call any other there is ``NOT_FOUND``."""
    return Operations(*[t.operation for t in TOOLS if t.owner == owner and t.internal == internal], failures=DATA.failures)
