"""Contracts of the log, memory, quota, journal and envelope operators on small literal tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerline.functions import text, values
from ledgerline.functions.vector import cosine, has_dimension, literal
from ledgerline.operators import audit, checks, memory, quota, results, runs
from ledgerline.plans.operations import DATA, Operation, OperationError, Operations, tools_of
from ledgerline.plans.operations import text as text_check
from ledgerline.schemas import AUDIT, MEMORY, RUN, RUN_EVENT, RUN_STATUSES, SCHEMA_VERSION, VALUE, result
from ledgerline.sources import statements, tables
from ledgerline.sources.tables import Store

T0 = dt.datetime(2026, 1, 1)


def at(ms: int) -> dt.datetime:
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture
def run_rows(spark):
    rows = [("r1", "memory", "recall", "{}", "running", None, T0, None), ("r2", "memory", "remember", "null", "running", None, T0, None)]
    return spark.createDataFrame(rows, RUN)


def test_created_runs(spark, run_rows):
    asked = spark.createDataFrame([("memory", "recall", None)], "service string, tool string, input string")
    row = runs.created(asked, F.lit(T0)).first()
    assert (row.status, row.input, row.result, row.completed_at) == ("running", "null", None, None) and len(row.id) == 36


def test_sequence_numbers(spark):
    new = spark.createDataFrame([("a", "run.created", None, at(1)), ("a", "worker.started", '{"image":"x"}', at(2)), ("b", "run.created", None, at(3))], "run_id string, type string, payload string, at timestamp")
    log = runs.appended(spark.createDataFrame([], RUN_EVENT), new, "at").select(*RUN_EVENT.names)
    assert sorted((r.run_id, r.seq, r.payload) for r in log.collect()) == [("a", 0, "{}"), ("a", 1, '{"image":"x"}'), ("b", 0, "{}")]
    more = runs.appended(log, new.limit(1), "at")
    assert [(r.run_id, r.seq) for r in more.collect()] == [("a", 2)]
    assert runs.next_sequence_of(log, "none").first()[0] == 0
    assert runs.next_sequence_of(log, "a").first()[0] == 2


def test_first_completion_wins(spark, run_rows):
    tries = [("r1", "ok", '{"x":1}', at(5)), ("r1", "failed", "{}", at(6)), ("r9", "ok", "{}", at(7)), ("r2", "running", "{}", at(8)), ("r2", None, "{}", at(9))]
    state, refused = runs.settle(run_rows, spark.createDataFrame(tries, "run_id string, status string, result string, at timestamp"), "at")
    assert {r.id: (r.status, r.completed_at) for r in state.collect()} == {"r1": ("ok", at(5)), "r2": ("running", None)}
    assert sorted((r.run_id, r.error) for r in refused.collect()) == [("r1", "INVALID_OPERATION"), ("r2", "INVALID_INPUT"), ("r2", "INVALID_INPUT"), ("r9", "NOT_FOUND")]


def test_events_json(spark, run_rows):
    events = spark.createDataFrame([("r1", 1, "worker.started", "{}", at(1)), ("r1", 0, "run.created", "{}", at(0))], RUN_EVENT)
    out = {r.id: r.value for r in runs.events_json(run_rows, events, "id", "run_id", runs.event_item(), F.col("seq").isNotNull()).collect()}
    assert out["r2"] == "[]"
    assert [(e["seq"], e["at"]) for e in json.loads(out["r1"])] == [(0, "2026-01-01T00:00:00.000Z"), (1, "2026-01-01T00:00:00.001Z")]


def test_lifecycle_allows_late_events_and_open_runs(spark):
    events = [("a", 0, "run.created", "{}", T0), ("a", 1, "run.completed", '{"status":"failed"}', T0), ("a", 2, "worker.exited", "{}", T0), ("b", 0, "run.created", "{}", T0)]
    out = {r.run_id: r for r in runs.lifecycle(spark.createDataFrame(events, RUN_EVENT)).collect()}
    assert (out["a"].status, out["a"].late_events, out["b"].status) == ("failed", True, "running")


@pytest.fixture
def memories(spark):
    rows = [("m1", "Deploy KEY 100%_x", ["ops"], [1.0, 0.0], at(1)), ("m2", "straße deploy", [], [0.0, 1.0], at(2)), ("m3", "back\\slash", [], None, at(3)), ("m4", "zero", [], [0.0, 0.0], at(4)), ("m5", "wide", [], [1.0, 0.0, 0.0], at(5))]
    return spark.createDataFrame(rows, MEMORY)


@pytest.mark.parametrize(("query", "found"), [("deploy", ["m2", "m1"]), ("100%_X", ["m1"]), ("%", ["m1"]), ("_", ["m1"]), ("\\", ["m3"]), ("ß", ["m2"]), ("nothing", []), ("", ["m5", "m4", "m3", "m2", "m1"])])
def test_text_search(memories, query, found):
    assert [r.id for r in memory.search_text(memories, query).collect()] == found
    like = memories.where(text.like_ignoring_case(F.col("content"), F.lit(query)))
    assert {r.id for r in like.collect()} == set(found)


def test_vector_search_skips_and_ties(memories):
    out = memory.search_vector(memories, [1.0, 0.0]).collect()
    assert [(r.id, r.score) for r in out] == [("m1", 1.0), ("m2", 0.0), ("m4", 0.0)]
    assert memory.search(memories, "ignored", [0.0, 1.0], 1).first().id == "m2"
    own = memories.withColumnsRenamed({"content": "said", "created_at": "told", "id": "no", "embedding": "v"})
    for v, found in (([0.0, 1.0], "m2"), (None, "m1")):
        assert memory.search(own, "key", v, 1, content="said", newest="told", key="no", vector="v").first().no == found


@pytest.mark.parametrize("limit", [0, 51, -1, 2.0, True])
def test_limits(memories, limit):
    with pytest.raises(ValueError, match="INVALID_INPUT"):
        memory.search_text(memories, "a", limit)


def test_limit_bounds(memories):
    assert memory.search_text(memories, "", 1).count() == 1 and memory.search_text(memories, "", 50).count() == 5
    with pytest.raises(ValueError):
        memory.recall(memories, "")
    assert memory.tagged(memories, "ops").count() == 1


def test_inserts_are_checked(spark):
    rows = [("a", None, None), ("", None, None), (None, None, None), ("b", ["t"], [1.0, 2.0]), ("c", [None], None), ("d", [], [1.0])]
    items = spark.createDataFrame(rows, "content string, tags array<string>, embedding array<float>")
    out = memory.inserted(items, 2, F.lit(T0)).collect()
    assert [(r.content, r.tags) for r in out] == [("a", []), ("b", ["t"])]


def _reference_quota(calls, limit, width):
    windows, out = {}, {}
    for key, ms, ident in sorted(calls, key=lambda c: (c[1], c[2])):
        start, used = windows.get(key, (None, 0))
        if start is None or ms - start >= width:
            start, used = ms, 0
        out[ident] = used < limit
        windows[key] = start, used + (used < limit)
    return out


@pytest.mark.parametrize(("limit", "width"), [(2, 60_000), (1, 1000), (3, 7)])
def test_quota_is_anchored(spark, limit, width):
    import random

    rng = random.Random(width)
    calls = [(k, m, i) for i, (k, m) in enumerate((rng.choice("ab"), rng.choice([0, 1, 999, 1000, 1001, 1999, 2001, 59_999, 60_000, 60_001, rng.randrange(200_000)])) for _ in range(300))]
    table = spark.createDataFrame([(k, at(m), i) for k, m, i in calls] + [("a", None, 9999)], "who string, at timestamp, call_id long")
    out = {r.call_id: r.allowed for r in quota.decisions(table, ["who"], "at", "call_id", limit, width).collect()}
    assert out.pop(9999) is False
    assert out == _reference_quota(calls, limit, width)
    assert quota.decisions(table, ["who"], "at", "call_id", 0, width).where("allowed").count() == 0


def test_quota_over_many_batches_and_long_chains(spark):
    """Groups that run over several Arrow batches, windows that span slices, and columns that pass through."""
    import random

    rng = random.Random(5)
    calls = [(rng.choice("aaab"), rng.randrange(40_000), i) for i in range(4000)] + [("c", 7 * i, 10_000 + i) for i in range(300)] + [("d", 0, 20_000), ("d", 10**9, 20_001)]
    table = spark.createDataFrame([(k, at(m), i, m, "x") for k, m, i in calls], "who string, at timestamp, call_id long, ms long, used string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("37", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        out = quota.decisions(table, ["who"], "at", "call_id", 3, 50)
        assert out.columns == ["who", "at", "call_id", "ms", "window_start", "used", "allowed"]
        found = {r.call_id: r for r in out.collect()}
        assert {i: r.allowed for i, r in found.items()} == _reference_quota(calls, 3, 50)
        assert all(0 <= (r["at"] - r.window_start).total_seconds() * 1000 < 50 for r in found.values())


def test_journal_records_refusals(spark):
    calls = spark.createDataFrame([("u", "recall", at(0), at(12), True), ("u", "recall", at(1), at(1), False), (None, "recall", at(2), at(2), True), ("u", "dig", at(3), at(3), True)], "subject string, tool string, at timestamp, ended timestamp, allowed boolean")
    named = audit.routed(calls, spark.createDataFrame([("recall", "memory")], "tool string, owner string"))
    out = audit.journal(named, audit.call_error(F.col("owner"), F.col("subject"), F.col("allowed")), "at", "ended")
    assert out.columns == AUDIT.names
    rows = {r["at"][-4:-1]: (r.subject, r.outcome, r.error_code, r.duration_ms) for r in out.collect()}
    assert rows == {"000": ("u", "ok", None, 12), "001": ("u", "error", "QUOTA_EXCEEDED", 0), "002": ("anonymous", "error", "UNAUTHENTICATED", 0), "003": ("u", "error", "UNKNOWN_TOOL", 0)}
    assert audit.rollup(out).count() == 4


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "ok", 5), (1, "odd", 0), (2, None, None), (None, "ok", 51)], "id int, status string, n int")
    parents = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in checks.orphans(rows, parents, "id", "id").collect()] == [2]
    assert [(r.id, r.n) for r in checks.repeated_keys(rows, "id").collect()] == [(1, 2)]
    assert checks.outside(rows, "status", RUN_STATUSES).count() == 2
    assert checks.missing(rows, "id", "status").count() == 2
    assert sorted(r.n for r in checks.out_of_range(rows, "n", 1, 50).collect()) == [0, 51]


def test_envelope_rules(spark):
    rows = [("ok", 1, None), ("ok", None, None), ("ok", 1, "INTERNAL"), ("failed", None, None), ("failed", None, "INTERNAL"), ("lost", 1, "INTERNAL")]
    table = spark.createDataFrame(rows, "status string, data int, code string")
    found = [r[0] is None for r in table.select(results.breach(F.col("status"), F.col("data"), F.col("code"))).collect()]
    assert found == [True, False, False, False, True, False]
    codes = spark.createDataFrame([("failed", "WORKER_TIMEOUT"), ("failed", "ODD"), ("needs_clarification", None), ("ok", None)], "status string, code string")
    assert [r[0] for r in codes.select(results.error_code(F.col("status"), F.col("code"))).collect()] == ["WORKER_TIMEOUT", "WORKER_FAILED", "NEEDS_CLARIFICATION", None]
    one = F.lit(1)
    made = spark.range(1).select(results.envelope(F.lit("ok"), F.lit("x"), F.array().cast("array<struct<source:string,ref:string,excerpt:string>>"), F.lit("r"), one, one, one, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("v"))
    assert made.schema["v"].dataType.names == result(made.schema["v"].dataType["data"].dataType).names
    assert json.loads(made.select(F.to_json("v")).first()[0])["data"] == "x"
    assert spark.range(1).select(results.cost_breach(F.struct(F.lit(-1).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("usd")))).first()[0]


def test_evidence_needs_an_id(spark):
    answers = spark.createDataFrame([(1, [("m1", "text"), (None, "x"), ("m2", None)])], "call int, items array<struct<id:string,content:string>>")
    assert [(r.source, r.ref, r.excerpt) for r in results.evidence(answers, "items", "memory", "call").collect()] == [("memory", "m1", "text"), ("memory", "m2", None)]


def test_scalar_functions(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    assert value(text.container_name(F.lit("run/42"))) == "run-42"
    assert value(text.service_variable(F.lit("memory"))) == "MEMORY_URL"
    assert value(text.operation_of(F.lit("/v1/ops/runs.get"))) == "runs.get"
    assert value(text.operation_of(F.lit("/v1/other"))) is None
    assert value(text.bearer_token(F.lit("Bearer abc"))) == "abc"
    assert value(text.token_subjects(F.lit("t1=alice; t2=bob;"))) == {"t1": "alice", "t2": "bob"}
    assert value(text.most_placeholders(F.lit("SELECT $1, $12, $3"))) == 12
    assert value(text.most_placeholders(F.lit("SELECT 1"))) == 0
    assert value(text.spoken(F.lit("NOT_FOUND_YET"))) == "not found_yet"
    for bad in ("{bad", '{"a":1}}', "1,2", "1] [2", '1} {"a":2', '1,"b":2', ""):
        assert value(values.valid_json(F.lit(bad))) is False
    for good in ('{"a":[1,null]}', " 1 ", "null", '"x"', "[]"):
        assert value(values.valid_json(F.lit(good))) is True
    assert value(values.valid_json(F.lit(None).cast("string"))) is None
    assert value(values.json_or_null(F.lit("null"))) is None
    assert value(values.duration_ms(F.lit(T0), F.lit(at(1234)))) == 1234
    assert value(cosine(literal([1, 0]), literal([1, 1]))) == pytest.approx(0.5**0.5)
    assert value(cosine(literal([0, 0]), literal([1, 1]))) == 0.0
    assert value(cosine(literal([1]), literal([1, 1]))) is None
    assert value(has_dimension(literal([1, 2]), 2))


def _fails(code, call):
    with pytest.raises(OperationError) as e:
        call()
    assert e.value.code == code


AXIS = [[float(i == j) for j in range(384)] for i in (0, 1)]
UNKNOWN = "00000000-0000-4000-8000-000000000000"


def test_a_run_from_its_creation_to_its_end(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    made = DATA.one("runs.create", store, service="memory", tool="recall", input={"query": "q"})
    assert (made.status, json.loads(made.input), made.result) == ("running", {"query": "q"}, None)
    assert DATA.one("runs.get", store, run_id=made.id) == made
    assert DATA.one("runs.events", store, run_id=made.id).value == "[]"
    DATA.execute("runs.appendEvent", store, run_id=made.id, type="run.created")
    event = DATA.one("runs.appendEvent", store, run_id=made.id, type="worker.started", payload={"image": "x"})
    assert (event.seq, json.loads(event.payload)) == (1, {"image": "x"})
    told = json.loads(DATA.one("runs.events", store, run_id=made.id).value)
    assert [(e["seq"], e["type"], e["payload"]) for e in told] == [(0, "run.created", {}), (1, "worker.started", {"image": "x"})]
    done = DATA.one("runs.complete", store, run_id=made.id, status="ok", result={"memory_id": "m"})
    assert (done.status, json.loads(done.result), done.created_at) == ("ok", {"memory_id": "m"}, made.created_at) and done.completed_at
    _fails("INVALID_OPERATION", lambda: DATA.execute("runs.complete", store, run_id=made.id, status="failed", result=None))
    assert DATA.one("runs.get", store, run_id=made.id) == done
    DATA.execute("runs.appendEvent", store, run_id=made.id, type="worker.exited")  # late events are allowed
    for name, given in [("runs.get", {}), ("runs.events", {}), ("runs.appendEvent", {"type": "run.created"}), ("runs.complete", {"status": "ok", "result": None})]:
        _fails("NOT_FOUND", lambda name=name, given=given: DATA.execute(name, store, run_id=UNKNOWN, **given))


def test_memories_are_stored_and_found(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert DATA.execute("memory.search", store, query="x").collect() == []
    ident = DATA.one("memory.insert", store, content="The deploy KEY rotates", tags=["ops"]).id
    assert store.table("memories").first()["id"] == ident
    found = DATA.one("memory.search", store, query="key")
    assert (found.id, found.tags, found.score) == (ident, ["ops"], 1.0)
    for content, v in (("far", AXIS[1]), ("near", AXIS[0])):
        DATA.execute("memory.insert", store, content=content, embedding=v)
    assert [(r.content, r.score) for r in DATA.execute("memory.search", store, query="", embedding=AXIS[0], limit=2).collect()] == [("near", 1.0), ("far", 0.0)]
    public, internal = tools_of("memory", False), tools_of("memory", True)
    assert (set(public.known), set(internal.known)) == ({"recall", "remember"}, {"memory_search", "memory_insert"})
    assert public.one("recall", store, query="key").id == ident
    assert len(internal.execute("memory_search", store, query="").collect()) == 3
    public.execute("remember", store, content="alpha")
    internal.execute("memory_insert", store, content="alpha two", tags=["a"])
    assert len(internal.execute("memory_search", store, query="ALPHA", limit=1).collect()) == 1
    _fails("INVALID_INPUT", lambda: public.execute("recall", store, query=""))
    _fails("INVALID_INPUT", lambda: internal.execute("memory_search", store, query="", embedding=AXIS[0]))
    _fails("INVALID_INPUT", lambda: internal.execute("memory_insert", store, content="x", embedding=AXIS[0]))
    _fails("NOT_FOUND", lambda: public.execute("memory_search", store, query=""))
    _fails("NOT_FOUND", lambda: tools_of("other", False).execute("recall", store, query="x"))


@pytest.mark.parametrize(
    ("name", "given"),
    [
        ("runs.get", {}), ("runs.get", {"run_id": 5}), ("runs.get", {"run_id": "r1"}), ("runs.get", {"run_id": UNKNOWN, "odd": 1}),
        ("runs.create", {"service": "s", "tool": None, "input": {}}), ("runs.create", {"service": "s", "tool": "t"}), ("runs.create", {"service": "s", "tool": "t", "input": float("nan")}),
        ("runs.appendEvent", {"run_id": UNKNOWN, "type": "odd"}), ("runs.appendEvent", {"run_id": UNKNOWN, "type": "run.created", "payload": [1]}),
        ("runs.complete", {"run_id": UNKNOWN, "status": "running", "result": None}),
        ("memory.insert", {"content": ""}), ("memory.insert", {"content": "a", "tags": "ops"}), ("memory.insert", {"content": "a", "tags": [None]}), ("memory.insert", {"content": "a", "embedding": [1.0]}),
        ("memory.search", {"query": "a", "limit": 51}), ("memory.search", {"query": "a", "limit": True}), ("memory.search", {"query": "a", "embedding": ["x"] * 384}), ("memory.search", {"query": "a", "embedding": [1.0, 2.0, 3.0]}),
    ],
)
def test_inputs_are_checked(spark, tmp_path, name, given):
    _fails("INVALID_INPUT", lambda: DATA.execute(name, Store(spark, str(tmp_path)), **given))


def test_registries_are_checked(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    _fails("NOT_FOUND", lambda: DATA.execute("nothing", store))
    assert set(DATA.only("runs.get").known) == {"runs.get"}
    search = DATA.known["memory.search"]
    for wrong in (lambda: Operation("x", {"a": text_check()}, [("a", print)], VALUE), lambda: Operation("x", {}, [("a", print), (None, print)], VALUE), lambda: Operations(search, search), lambda: search.view("y", "limit"), lambda: search.view("y", "query", "odd")):
        with pytest.raises(ValueError):
            wrong()
    shape = Operation("z", {}, [(None, lambda s: s.spark.range(1))], VALUE)
    with pytest.raises(AssertionError):
        Operations(shape).execute("z", store)
    gone = Operation("g", {}, [(None, lambda s: s.spark.table("no_such_table"))], VALUE)
    _fails("NOT_FOUND", lambda: Operations(gone, failures=DATA.failures).execute("g", store))
    with pytest.raises(AnalysisException):
        Operations(gone).execute("g", store)


def test_statement_files(spark, tmp_path, memories):
    memories.createOrReplaceTempView("memory_rows")
    files = {"by_tag.sql": "SELECT id FROM memory_rows WHERE array_contains(tags, :tag) -- not :this", "every.sql": "SELECT id, ':no' AS x FROM memory_rows ORDER BY id LIMIT :n", "echo.sql": "SELECT :payload AS value"}
    entries = [{"operation": "find", "when": "tag", "file": "by_tag.sql", "parameters": ["tag"], "returns": "rows"}, {"operation": "find", "file": "every.sql", "parameters": ["n"], "returns": "rows"}, {"operation": "echo", "file": "echo.sql", "parameters": ["payload:json"], "returns": "value"}]

    def load(entries):
        (tmp_path / "statements.json").write_text(json.dumps(entries))
        return statements.load(spark, str(tmp_path))

    for name, body in files.items():
        (tmp_path / name).write_text(body)
    known = load(entries)
    assert [r.id for r in statements.answer(spark, known, "find", {"tag": "ops"}).collect()] == ["m1"]
    assert statements.answer(spark, known, "find", {"tag": "ops' OR 1=1 --"}).collect() == []
    assert [r.id for r in statements.answer(spark, known, "find", {"n": 2}).collect()] == ["m1", "m2"]
    assert statements.answer(spark, known, "echo", {"payload": {"a": [1]}}).first().value == '{"a": [1]}'
    assert statements.answer(spark, known, "echo", {}).first().value is None
    with pytest.raises(ValueError, match="NOT_FOUND"):
        statements.answer(spark, known, "odd", {})
    for wrong in ([entries[0]], [{**entries[1], "parameters": []}], [{**entries[1], "odd": 1}], [{**entries[1], "returns": "all"}]):
        with pytest.raises(ValueError):
            load(wrong)


def test_migrations_run_once_and_in_order(spark, tmp_path):
    folder, ledger = tmp_path / "files", str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "0001_first.sql").write_text("CREATE OR REPLACE TEMP VIEW step AS SELECT 1 AS n;\nCREATE OR REPLACE TEMP VIEW again AS SELECT 'a;b' AS x;\n")
    (folder / "notes.md").write_text("nothing to run")
    assert tables.migrate(spark, str(folder), ledger) == ["0001_first.sql"]
    (folder / "0002_second.sql").write_text("CREATE OR REPLACE TEMP VIEW later AS SELECT n + 1 AS n FROM step")
    (folder / "0003_bad.sql").write_text("SELECT * FROM no_such_table")
    with pytest.raises(AnalysisException):
        tables.migrate(spark, str(folder), ledger)
    assert sorted(r.version for r in tables.log(spark, ledger, SCHEMA_VERSION).collect()) == ["0001", "0002"]
    (folder / "0003_bad.sql").unlink()
    assert tables.migrate(spark, str(folder), ledger) == [] and (spark.table("again").first().x, spark.table("later").first().n) == ("a;b", 2)


def test_database_tables(spark, memories):
    url = "jdbc:derby:memory:ledgerline;create=true"
    rows = spark.range(100).select(F.col("id").alias("N"), (F.col("id") % 7).alias("R"))
    tables.write_jdbc(rows, url, "T")
    out = tables.jdbc(spark, url, "T", "N", 0, 100, 4)
    assert out.rdd.getNumPartitions() == 4 and out.where("R = 3").count() == rows.where("R = 3").count()
    assert tables.jdbc(spark, url, "T").count() == 100


def test_maps_vectors_and_ids(spark):
    row = spark.sql("SELECT map('a', 1, 'b', null) AS m, '[1, 2.5]' AS v, 'x' AS bad")
    out = row.select(values.has_key(F.col("m"), "b").alias("has"), values.has_key(F.col("m"), "c").alias("not"), values.without_nulls(F.col("m")).alias("m"), values.vector_of_json(F.col("v")).alias("v"), values.vector_of_json(F.col("bad")).alias("bad"), text.is_uuid(F.lit(UNKNOWN)).alias("id"), text.internal_tool_of(F.lit("/internal/memory_search")).alias("tool")).first()
    assert (out.has, out["not"], out.m, out.v, out.id, out.tool) == (True, False, {"a": 1}, [1.0, 2.5], True, "memory_search") and not out.bad


def test_logs_files_and_ledger(spark, tmp_path, memories):
    path = str(tmp_path / "memories")
    assert tables.log(spark, path, MEMORY).count() == 0
    tables.append(memories, path, MEMORY)
    tables.append(memories.limit(1), path, MEMORY)
    assert tables.log(spark, path, MEMORY).count() == 6
    for name in ("0002_b.sql", "0001_a.sql", "note.md", "1_bad.sql"):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / name).write_text(" SELECT 1 \n")
    files = tables.migration_files(spark, str(tmp_path / "m"))
    assert [r.file for r in files.collect()] == ["0001_a.sql", "0002_b.sql"]
    assert [r.file for r in tables.pending(files, spark.createDataFrame([("0001",)], "version string")).collect()] == ["0002_b.sql"]
    assert {r.statement.strip() for r in tables.statements(spark, str(tmp_path / "m")).collect()} == {"SELECT 1"}
    tables.write_json_lines(memories.select("id", "embedding"), str(tmp_path / "lines"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "lines")).collect()]
    assert "embedding" not in next(x for x in lines if x["id"] == "m3")
    tables.register({"mem": memories})
    assert spark.sql("SELECT * FROM mem WHERE id = :id", args={"id": "m1' OR 1=1"}).count() == 0


def test_quota_of_a_hot_key_in_divided_slices_and_small_batches(spark, monkeypatch):
    """A third of all calls is of one key, some at one time and some without a time; its slices are divided and walked in many batches."""
    import random

    rng = random.Random(9)
    calls = [(("hot" if i % 3 == 0 else f"k{rng.randrange(20)}"), f"c{i:05}", rng.randrange(4000) if i % 50 else 777) for i in range(3000)]
    table = spark.createDataFrame(calls, "who string, call_id string, ms int").withColumn("at", F.timestamp_millis("ms"))
    none = spark.createDataFrame([("hot", "late")], "who string, call_id string").selectExpr("who", "call_id", "null ms", "null at").withColumns({"ms": F.col("ms").cast("int"), "at": F.col("at").cast("timestamp")})
    monkeypatch.setattr(quota, "CALLS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for width in (1, 5, 90, 1000, 10_000):
            out = quota.decisions(table.unionByName(none), ["who"], "at", "call_id", 3, width)
            found = {r.call_id: r.allowed for r in out.collect()}
            assert found.pop("late") is False
            assert found == _reference_quota([(w, ms, i) for w, i, ms in calls], 3, width)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert quota._busy(table.select(F.col("who").alias("key"), F.lit(0).cast("long").alias("slot"))).where("parts > 1").count() > 0


def test_quota_shuffles_its_calls_once(spark):
    calls = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = quota.decisions(calls, ["user_id", "event_type"], "ts", "event_id", 2, 1000)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning(key" in x and "slice" in x and "REPARTITION" in x]
    assert len([x for x in wide if "ReusedExchange" not in x and "Reused" not in x]) == 1 and "ReusedExchange" in plan


def test_vectors_that_are_not_finite_are_refused_and_never_found(spark, tmp_path):
    store, nan, inf = Store(spark, str(tmp_path)), float("nan"), float("inf")
    for bad in ([nan] * 384, [inf] + [0.0] * 383):
        _fails("INVALID_INPUT", lambda bad=bad: DATA.execute("memory.insert", store, content="x", embedding=bad))
        _fails("INVALID_INPUT", lambda bad=bad: DATA.execute("memory.search", store, query="", embedding=bad))
    rows = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [inf, 1.0]), (4, [1e200, 1e200]), (5, [0.0, 0.0]), (6, [1.0, 1.0]), (7, [1.0, None])]
    table = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert [(r.id, round(r.score, 6)) for r in memory.search_vector(table, [1.0, 0.0], 9).collect()] == [(1, 1.0), (6, 0.707107), (5, 0.0)]
    items = table.selectExpr("'c' content", "cast(null as array<string>) tags", "embedding", "id")
    assert {r.id for r in items.select("id", memory.insert_error(2).alias("e")).where("e IS NOT NULL").collect()} == {2, 3, 7}


def test_run_ids_are_equal_whatever_their_case(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    made = DATA.one("runs.create", store, service="s", tool="t", input=None)
    assert DATA.one("runs.get", store, run_id=made.id.upper()).id == made.id
    event = DATA.one("runs.appendEvent", store, run_id=made.id.upper(), type="run.created")
    assert event.run_id == made.id
    assert json.loads(DATA.one("runs.events", store, run_id=made.id.upper()).value)[0]["payload"] == {}


def test_vectors_of_json_are_strict(spark):
    texts = ["[1,2.5]", "[1,2]x", "[1,null]", '[1,"a"]', "[]", "null", "7", "[NaN]", "[[1]]", None]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", values.vector_of_json(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in out] == [[1.0, 2.5], None, None, None, [], None, None, None, None, None]


def test_payloads_stay_nested_and_completions_need_a_status(spark):
    rows = [("a", 1, "run.completed", "{}"), ("a", 0, "run.created", '{"k":[1,{"x":null}]}'), ("b", 0, "run.created", "no json")]
    events = spark.createDataFrame(rows, "run_id string, seq int, type string, payload string").withColumn("at", F.lit(T0))
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    found = {r.id: json.loads(r.value) for r in runs.events_json(known, events, "id", "run_id", runs.event_item(), F.col("seq").isNotNull()).collect()}
    assert [e["payload"] for e in found["a"]] == [{"k": [1, {"x": None}]}, {}] and found["b"][0]["payload"] == "no json" and found["c"] == []
    assert {r.run_id: r.status for r in runs.lifecycle(events).collect()} == {"a": "invalid", "b": "running"}
