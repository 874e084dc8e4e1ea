"""The registered queries over execution logs and document memory, with DuckDB SQL of the same results.

The driver's tables stand in for the engine's own: orders and lineitem for runs and their events,
conversations for a run log with its own sequence, documents and embeddings for memories, events for calls.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flow_queries, search_queries
from .functions import text, values
from .functions.vector import cosine, has_dimension
from .operators import audit, checks, memory, quota, results, runs
from .sources.tables import pending, table

Query = Callable[[SparkSession, str], DataFrame]

#: Calls allowed in a window, and its width, of the quota queries.
LIMIT, WINDOW_MS = 2, 3 * 24 * 3600 * 1000
RUN, NEEDLE, RECENT = 7, "en", 5
#: What the recall tool is asked for.
RECALLED = ["the", "É", "%", "UND"]


def _numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return runs.numbered(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def _item() -> Column:
    return F.struct("seq", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), values.iso_time(F.col("l_shipdate")).alias("at"))


def run_get(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", values.iso_time(F.col("o_orderdate")).alias("created_at"))
    return runs.run(orders, RUN)


def run_events_json(spark: SparkSession, sf: str) -> DataFrame:
    return runs.events_json(table(spark, sf, "orders"), _numbered_lines(spark, sf), "o_orderkey", "l_orderkey", _item(), F.col("seq").isNotNull(), None)


def run_events_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's calls as one JSON document, in which the calls' properties are objects, deeper in every third, or text where they
    are no JSON."""
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"all":['), F.col("props"), F.lit(',null,"x"],"in":{"props":'), F.col("props"), F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    calls = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("type"), props.alias("payload"), F.col("ts").alias("at"))
    numbered = runs.numbered(calls, "run_id", "at", "event_id")
    return runs.events_json(table(spark, sf, "customer"), numbered, "c_custkey", "run_id", runs.event_item(), F.col("seq").isNotNull())


def event_seq_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq")


def next_seq(spark: SparkSession, sf: str) -> DataFrame:
    return runs.next_sequence(table(spark, sf, "conversations"), "conv_id", "turn")


def next_seq_of_unknown_run(spark: SparkSession, sf: str) -> DataFrame:
    return runs.next_sequence_of(table(spark, sf, "conversations"), -1, "conv_id", "turn")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return calls.select("user_id", F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"), "ts", "event_id")


def run_current_state(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "events").select("user_id").distinct()
    first = runs.first_attempts(_attempts(spark, sf), "user_id", "ts", "event_id")
    return every.join(first, "user_id", "left").select("user_id", F.coalesce("status", F.lit("running")).alias("status"), "event_id")


def completion_rejects(spark: SparkSession, sf: str) -> DataFrame:
    late = runs.later_attempts(_attempts(spark, sf), "user_id", "ts", "event_id")
    return late.select("user_id", "event_id", "status", "attempt", F.lit("INVALID_OPERATION").alias("error"))


def search_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return memory.search_text(docs, NEEDLE, RECENT, "text", "doc_id", "doc_id")


def search_text_escaped(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.where(text.like_ignoring_case(F.col("text"), F.lit("%"))).select("doc_id")


def search_text_accents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.where(text.contains_ignoring_case(F.col("text"), "É")).select("doc_id")


def search_vector(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    query = vectors.orderBy("vec_id").first()["embedding"]
    return memory.search_vector(vectors, query, memory.MOST, "embedding", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def score_against_row(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of each vector against a query that is itself a table row."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    query = F.broadcast(vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("query")))
    return vectors.join(query, F.lit(True)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))


def quota_decisions(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    out = quota.decisions(calls, ["user_id", "event_type"], "ts", "event_id", LIMIT, WINDOW_MS)
    return out.select("event_id", "used", "allowed")


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('view', 'web'), ('click', 'web'), ('purchase', 'shop'), ('error', 'ops') AS t(tool, owner)")


def tool_owner_route(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select("event_id", F.col("event_type").alias("tool"))
    return audit.routed(calls, _catalogue(spark)).select("event_id", "tool", "owner", F.when(F.col("owner").isNull(), "UNKNOWN_TOOL").alias("error"))


def distinct_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Owners of the tools that were called, from a catalogue that is itself a table: each user's tools belong to the user's
    nation in the customers' table."""
    calls = table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("tool"), F.col("user_id").alias("c_custkey"))
    known = calls.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("tool", F.concat(F.lit("nation-"), "c_nationkey").alias("owner")).distinct()
    return audit.owners(audit.routed(calls, known))


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select("user_id", F.col("event_type").alias("tool"), "ts", "event_id")
    judged = quota.decisions(calls, ["user_id", "tool"], "ts", "event_id", LIMIT, WINDOW_MS)
    named = audit.routed(judged, _catalogue(spark)).withColumn("subject", F.col("user_id").cast("string")).withColumnRenamed("ts", "at").withColumn("ended", F.col("at"))
    error = audit.call_error(F.col("owner"), F.col("subject"), F.col("allowed"))
    return audit.journal(named, error, "at", "ended")


def audit_journal(spark: SparkSession, sf: str) -> DataFrame:
    return _journal(spark, sf).select("at", "subject", "tool", "owner", "outcome", "error_code")


def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.rollup(_journal(spark, sf), "tool").select("tool", "outcome", "error_code", "calls")


def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return checks.orphans(docs, table(spark, sf, "labels"), "doc_id", "doc_id")


def pk_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return checks.repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def enum_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.outside(table(spark, sf, "events"), "event_type", ["view", "click", "purchase"]).select("event_id", "event_type")


def null_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose labels are missing."""
    labelled = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return checks.missing(labelled, "quality", "toxic").select("doc_id", "lang")


def range_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.out_of_range(table(spark, sf, "lineitem"), "l_quantity", 1, 40).select("l_orderkey", "l_linenumber", "l_quantity")


def migration_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as files of migrations, regions as the ledger of those that were applied."""
    name = F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("_"), F.when(F.col("n_nationkey") % 6 == 0, F.col("n_name")).otherwise(F.lower("n_name")), F.lit(".sql"))
    files = table(spark, sf, "nation").select(name.alias("file"))
    known = files.where(text.is_migration(F.col("file"))).select("file", text.version_of(F.col("file")).alias("version"))
    return pending(known, table(spark, sf, "region").select(F.lpad(F.col("r_regionkey").cast("string"), 4, "0").alias("version")))


def evidence_explode(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "user", F.concat_ws("-", "conv_id", "turn")).alias("id"), F.col("text").alias("content"))
    answers = turns.groupBy("conv_id").agg(F.collect_list(F.struct("id", "content")).alias("items"))
    return results.evidence(answers, "items", "memory", "conv_id")


def iso_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", values.iso_time(F.col("ts")).alias("at"))


def duration_ms(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", values.duration_ms(start, F.col("ts")).alias("ms"))


def result_invariants(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    data = F.when(F.col("value") > 10, F.col("value"))
    code = F.when(F.col("event_type") == "error", results.error_code(status, F.lit("no such code"))).when(F.col("value") > 90, "INTERNAL")
    return calls.select("event_id", results.breach(status, data, code).alias("breach"), code.alias("code"))


def container_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.container_name(F.col("url")).alias("name"))


def service_variables(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().select("source", text.service_variable(F.col("source")).alias("variable"))


def call_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the properties of a call are JSON; a brace too many spoils some."""
    props = F.concat_ws("", F.col("props"), F.when(F.col("event_id") % 7 == 0, "}"))
    return table(spark, sf, "events").select("event_id", values.valid_json(props).alias("valid"))


def recall_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """The answer of the recall tool to each of a few queries, as a JSON envelope: found memories are data and evidence."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    answers = [results.recall_answer(memory.recall(docs, q, 20, newest="id"), F.lit(q)).select(F.lit(q).alias("query"), F.col("value").alias("answer")) for q in RECALLED]
    return reduce(DataFrame.unionByName, answers)


def runs_created(spark: SparkSession, sf: str) -> DataFrame:
    """Runs made from requests, with their defaults; a request without an input has a JSON null."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("service"), F.col("o_orderpriority").alias("tool"), F.when(F.col("o_custkey") % 3 != 0, F.to_json(F.struct("o_custkey"))).alias("input"), "o_orderdate")
    made = runs.created(asked, F.col("o_orderdate"))
    return made.select("id", "service", "tool", "input", "status", "result", values.iso_time(F.col("created_at")).alias("created_at"), values.iso_time(F.col("completed_at")).alias("completed_at"))


def events_appended(spark: SparkSession, sf: str) -> DataFrame:
    """New events of conversations, with numbers that go on from those of the log and default payloads."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").cast("int").alias("seq"), F.lit("worker.started").alias("type"), F.when(F.col("role") == "user", F.to_json(F.struct("role"))).alias("payload"), F.timestamp_seconds("turn").alias("at"))
    new = turns.where("seq >= 3").drop("seq")
    return runs.appended(turns.where("seq < 3"), new, "at").select("run_id", "seq", "type", "payload", values.iso_time(F.col("at")).alias("at"))


def _settled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Users as runs and their calls as attempts to complete them, some with statuses that are not final. Each fifth user is left out
    of the runs, so that attempts of unknown ones are refused."""
    events = table(spark, sf, "events")
    users = table(spark, sf, "customer").where("c_custkey % 5 != 0")
    known = users.select(F.col("c_custkey").alias("id"), F.lit("memory").alias("service"), F.lit("recall").alias("tool"), F.lit("null").alias("input"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("result"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running")
    tries = events.select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("props").alias("result"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    return runs.settle(known, tries, "at", "event_id")


def runs_settled(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(spark, sf)[0].select("id", "status", "result", values.iso_time(F.col("completed_at")).alias("completed_at"))


def completions_refused(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(spark, sf)[1].select("event_id", "run_id", "status", "error")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with vectors as memories to insert: some texts are empty, some tags null, some vectors too short."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise("").alias("content"), F.when(F.col("doc_id") % 4 != 0, F.array("lang", F.when(F.col("doc_id") % 7 != 0, F.col("source")))).alias("tags"))
    cut = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    return docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), cut.alias("embedding")), "id", "left")


def memories_inserted(spark: SparkSession, sf: str) -> DataFrame:
    made = memory.inserted(_items(spark, sf), 64, F.lit("2024-01-01").cast("timestamp"))
    return made.select("id", "content", F.array_join("tags", ",").alias("tags"), F.size("embedding").alias("dimension"), values.iso_time(F.col("created_at")).alias("created_at"))


def memories_refused(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("id", memory.insert_error(64).alias("error")).where("error IS NOT NULL")


def recall_search(spark: SparkSession, sf: str) -> DataFrame:
    """The recall tool over memories with one tag."""
    tagged = memory.tagged(table(spark, sf, "documents").withColumn("tags", F.array("lang", "source")), "de")
    return memory.recall(tagged, "UND", memory.MOST, "text", "doc_id", "doc_id").select("doc_id", "lang", "score")


def score_odd_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Scores where vectors are missing, zero or of another length; vectors come as JSON text."""
    own = F.when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 9)).when(F.col("vec_id") % 5 != 0, F.col("embedding"))
    vectors = table(spark, sf, "embeddings").select("vec_id", values.vector_of_json(F.to_json(own)).alias("v"), "embedding")
    score = cosine(F.col("v"), F.col("embedding"))
    return vectors.select("vec_id", F.size("v").alias("n"), has_dimension(F.col("v"), 64).alias("right_length"), F.round(score, 6).alias("score"))


def json_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs as JSON: a JSON null is absent like an SQL null."""
    own = F.when(F.col("event_id") % 5 == 0, "null").when(F.col("event_id") % 5 != 1, F.col("props"))
    parsed = values.json_or_null(own)
    return table(spark, sf, "events").select("event_id", parsed.isNotNull().alias("present"), F.try_variant_get(parsed, "$.k", "int").alias("k"))


def url_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The settings in the query of a URL as a map: entries, an own-key test, and nulls left out."""
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    found = text.token_subjects(query, "&")
    kept = values.without_nulls(F.map_from_arrays(F.map_keys(found), F.transform(F.map_values(found), lambda v: F.when(v != "x", v))))
    pages = table(spark, sf, "pages").select("page_id", found.alias("found"), kept.alias("kept"))
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("kept"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")
    return pages.select("page_id", F.size("found").alias("n"), values.has_key(F.col("found"), "ref").alias("has_ref"), values.has_key(F.col("kept"), "ref").alias("keeps_ref"), entries.alias("entries"))


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in routes and headers made from calls."""
    kind = F.col("event_type")
    made = table(spark, sf, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "/v1/ops/").otherwise("/internal/"), kind).alias("route"), F.concat(F.when(F.col("event_id") % 3 == 0, "bearer ").otherwise("Bearer "), kind).alias("header"))
    route = F.col("route")
    return made.select("event_id", text.operation_of(route).alias("operation"), text.internal_tool_of(route).alias("tool"), text.bearer_token(F.col("header")).alias("token"))


def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """The highest placeholder of statements made from line items; some have none."""
    made = F.when(F.col("l_linenumber") % 3 == 0, "SELECT 1").otherwise(F.concat(F.lit("SELECT $"), F.col("l_linenumber"), F.lit(", $"), F.col("l_partkey") % 20))
    return table(spark, sf, "lineitem").select(made.alias("statement")).distinct().select("statement", text.most_placeholders(F.col("statement")).alias("n"))


def spoken_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error codes as they are said: the first underscore alone becomes a space."""
    code = F.concat(F.upper("event_type"), F.lit("_NOT_"), F.col("user_id") % 4, F.lit("_FOUND"))
    return table(spark, sf, "events").select(code.alias("code")).distinct().select("code", text.spoken(F.col("code")).alias("said"))


def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts have the form of a run id; the right ones are made from a digest of the source's name."""
    digest = F.md5(F.concat_ws("-", "source", "lang"))
    form = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    made = table(spark, sf, "documents").select("source", "lang").distinct()
    return made.select(F.explode(F.array(form, digest, F.concat(form, F.lit("0")), F.upper(form))).alias("run_id")).select("run_id", text.is_uuid(F.col("run_id")).alias("valid"))


def run_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    kind = F.when(F.col("turn") == 0, "run.created").when(F.col("turn") == 3, "run.completed").when(F.col("role") == "assistant", "output.validated").otherwise("worker.started")
    events = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), kind.alias("type"), F.lit('{"status":"ok"}').alias("payload"))
    return runs.lifecycle(events)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        run_get, run_events_json, run_events_payload, event_seq_assign, next_seq, next_seq_of_unknown_run, run_current_state, completion_rejects, run_lifecycle,
        search_text, search_text_escaped, search_text_accents, search_vector, score_against_row,
        quota_decisions, tool_owner_route, distinct_owners, audit_journal, audit_rollup,
        fk_violations, pk_duplicates, enum_violations, null_violations, range_violations, migration_pending,
        runs_created, events_appended, runs_settled, completions_refused, memories_inserted, memories_refused, recall_search,
        score_odd_vectors, json_inputs, url_settings, routes, placeholders, spoken_errors, run_ids,
        container_names, service_variables, call_properties, recall_envelopes,
        evidence_explode, iso_timestamps, duration_ms, result_invariants,
    )
} | search_queries.QUERIES | flow_queries.QUERIES

_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1)::INT AS seq FROM lineitem"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_ATTEMPTS = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS status, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS attempt FROM events WHERE event_type IN ('purchase', 'error')"
_TOOLS = "(VALUES ('view', 'web'), ('click', 'web'), ('purchase', 'shop'), ('error', 'ops')) t(tool, owner)"
_QUOTA = f"""o AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_type, event_id, us, n, us AS start FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.us, o.n, CASE WHEN o.us - f.start >= {WINDOW_MS * 1000} THEN o.us ELSE f.start END FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.n = f.n + 1),
q AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type, start ORDER BY us, event_id))::INT AS used FROM f)"""
_JOURNAL = f"""j AS (SELECT {_ISO.format("ts")} AS at, user_id::VARCHAR AS subject, event_type AS tool, owner,
  CASE WHEN owner IS NULL THEN 'UNKNOWN_TOOL' WHEN used > {LIMIT} THEN 'QUOTA_EXCEEDED' END AS error_code FROM events JOIN q USING (event_id) LEFT JOIN (SELECT * FROM {_TOOLS}) ON tool = event_type)"""
_ITEMS = """WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN text ELSE '' END AS content, doc_id % 4 <> 0 AS tagged, lang, source, CASE WHEN vec_id % 9 = 0 THEN 5 WHEN vec_id IS NOT NULL THEN 64 END AS n,
  coalesce(content = '' OR (doc_id % 4 <> 0 AND doc_id % 7 = 0) OR vec_id % 9 = 0, false) OR content IS NULL AS bad FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
#: Spark's size of a null array.
_NO_VECTOR = "NULL"

ORACLE_SQL: dict[str, str] = {
    "run_get": f"SELECT o_orderkey AS id, o_orderstatus, {_ISO.format('o_orderdate')} AS created_at FROM orders WHERE o_orderkey = {RUN}",
    "run_events_json": f"""WITH e AS ({_LINES})
SELECT o_orderkey, coalesce(to_json(list({{'seq': seq, 'line': l_linenumber, 'part': l_partkey, 'at': {_ISO.format('l_shipdate')}}} ORDER BY seq) FILTER (WHERE seq IS NOT NULL))::VARCHAR, '[]') AS value
FROM orders LEFT JOIN e ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "run_events_payload": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CASE event_id % 3 WHEN 0 THEN ('{{"all":[' || props || ',null,"x"],"in":{{"props":' || props || '}}}}')::JSON WHEN 1 THEN to_json(props || '}}') ELSE props::JSON END AS payload FROM events),
g AS (SELECT user_id, to_json(list({{'seq': seq, 'run_id': user_id, 'type': event_type, 'payload': payload, 'at': {_ISO.format('ts')}}} ORDER BY seq))::VARCHAR AS value FROM e GROUP BY user_id)
SELECT c_custkey, replace(coalesce(value, '[]'), '"k": ', '"k":') AS value FROM customer LEFT JOIN g ON user_id = c_custkey""",
    "event_seq_assign": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seq FROM ({_LINES})",
    "next_seq": "SELECT conv_id, max(turn) + 1 AS next_seq FROM conversations GROUP BY conv_id",
    "next_seq_of_unknown_run": "SELECT coalesce(max(turn) + 1, 0) AS next_seq FROM conversations WHERE conv_id = -1",
    "run_current_state": f"SELECT user_id, coalesce(status, 'running') AS status, event_id FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM ({_ATTEMPTS}) WHERE attempt = 1) USING (user_id)",
    "completion_rejects": f"SELECT user_id, event_id, status, attempt, 'INVALID_OPERATION' AS error FROM ({_ATTEMPTS}) WHERE attempt > 1",
    "run_lifecycle": """WITH e AS (SELECT conv_id AS run_id, turn AS seq, CASE WHEN turn = 0 THEN 'run.created' WHEN turn = 3 THEN 'run.completed' WHEN role = 'assistant' THEN 'output.validated' ELSE 'worker.started' END AS type FROM conversations),
g AS (SELECT run_id, count(*) AS n_events, max(seq) AS last_seq, bool_or(type = 'output.validated') AS validated, min(CASE WHEN type = 'run.completed' THEN seq END) AS done FROM e GROUP BY run_id)
SELECT run_id, CASE WHEN done IS NULL THEN 'running' ELSE 'ok' END AS status, n_events, validated, coalesce(last_seq > done, false) AS late_events FROM g""",
    "search_text": f"SELECT doc_id, text, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), lower('{NEEDLE}')) ORDER BY doc_id DESC LIMIT {RECENT}",
    "search_text_escaped": r"SELECT doc_id FROM documents WHERE text ILIKE '%\%%' ESCAPE '\'",
    "search_text_accents": "SELECT doc_id FROM documents WHERE contains(lower(text), lower('É'))",
    "search_vector": f"""WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q) ORDER BY score DESC, vec_id LIMIT {memory.MOST}""",
    "score_against_row": """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q""",
    "quota_decisions": f"WITH RECURSIVE {_QUOTA} SELECT event_id, used, used <= {LIMIT} AS allowed FROM q",
    "tool_owner_route": f"SELECT event_id, event_type AS tool, owner, CASE WHEN owner IS NULL THEN 'UNKNOWN_TOOL' END AS error FROM events LEFT JOIN {_TOOLS} ON tool = event_type",
    "distinct_owners": "SELECT DISTINCT 'nation-' || c_nationkey AS owner FROM events JOIN customer ON user_id = c_custkey UNION SELECT NULL FROM events ANTI JOIN customer ON user_id = c_custkey",
    "audit_journal": f"WITH RECURSIVE {_QUOTA}, {_JOURNAL} SELECT j.at, subject, tool, owner, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS outcome, error_code FROM j",
    "audit_rollup": f"WITH RECURSIVE {_QUOTA}, {_JOURNAL} SELECT tool, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS outcome, error_code, count(*) AS calls FROM j GROUP BY ALL",
    "fk_violations": "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "enum_violations": "SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase')",
    "null_violations": "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL",
    "range_violations": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 40)",
    "migration_pending": """WITH f AS (SELECT lpad(n_nationkey::VARCHAR, 4, '0') || '_' || CASE WHEN n_nationkey % 6 = 0 THEN n_name ELSE lower(n_name) END || '.sql' AS file FROM nation)
SELECT file, substr(file, 1, 4) AS version FROM f WHERE regexp_full_match(file, '[0-9]{4}_[a-z0-9_]+[.]sql') AND substr(file, 1, 4) NOT IN (SELECT lpad(r_regionkey::VARCHAR, 4, '0') FROM region)""",
    "evidence_explode": "SELECT conv_id, 'memory' AS source, conv_id || '-' || turn AS ref, text AS excerpt FROM conversations WHERE role = 'user'",
    "container_names": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '-', 'g') AS name FROM pages",
    "service_variables": "SELECT DISTINCT source, upper(source) || '_URL' AS variable FROM documents",
    "call_properties": "SELECT event_id, json_valid(props || CASE WHEN event_id % 7 = 0 THEN '}' ELSE '' END) AS valid FROM events",
    "recall_envelopes": " UNION ALL ".join(f"""SELECT '{q}' AS query, to_json({{'status': 'ok', 'data': list({{'id': doc_id::VARCHAR, 'content': text, 'score': 1.0::DOUBLE}} ORDER BY doc_id DESC), 'evidence': list({{'source': 'memory', 'ref': doc_id::VARCHAR, 'excerpt': text}} ORDER BY doc_id DESC), 'run_id': '{q}', 'cost': {{'input_tokens': 0, 'output_tokens': 0, 'usd': 0.0}}}})::VARCHAR AS answer
FROM (SELECT doc_id, text FROM documents WHERE contains(lower(text), lower('{q}')) ORDER BY doc_id DESC LIMIT 20)""" for q in RECALLED),
    "iso_timestamps": f"SELECT event_id, {_ISO.format('ts')} AS at FROM events",
    "duration_ms": "SELECT event_id, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000 AS ms FROM events",
    "result_invariants": """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN value <= 10 OR value IS NULL OR value > 90 THEN 'status ok requires data and no error' END AS breach,
  CASE WHEN event_type = 'error' THEN 'WORKER_FAILED' WHEN value > 90 THEN 'INTERNAL' END AS code FROM events""",
    "runs_created": f"SELECT o_orderkey AS id, o_orderstatus AS service, o_orderpriority AS tool, CASE WHEN o_custkey % 3 <> 0 THEN '{{\"o_custkey\":' || o_custkey || '}}' ELSE 'null' END AS input, 'running' AS status, NULL::VARCHAR AS result, {_ISO.format('o_orderdate')} AS created_at, NULL::VARCHAR AS completed_at FROM orders",
    "events_appended": f"""WITH n AS (SELECT conv_id, count(*) FILTER (WHERE turn < 3) AS known FROM conversations GROUP BY conv_id)
SELECT conv_id AS run_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + known)::INT AS seq, 'worker.started' AS type, CASE WHEN role = 'user' THEN '{{"role":"user"}}' ELSE '{{}}' END AS payload, {_ISO.format("make_timestamp(turn * 1000000)")} AS at
FROM conversations JOIN n USING (conv_id) WHERE turn >= 3""",
    "runs_settled": f"""WITH f AS (SELECT user_id, arg_min(CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END, (ts, event_id)) AS status, arg_min(props, (ts, event_id)) AS result, min(ts) AS at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT c_custkey AS id, coalesce(status, 'running') AS status, result, {_ISO.format("f.at")} AS completed_at FROM customer LEFT JOIN f ON user_id = c_custkey WHERE c_custkey % 5 <> 0""",
    "completions_refused": """WITH t AS (SELECT event_id, user_id AS run_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' END AS status, ts FROM events),
r AS (SELECT *, status IN ('ok', 'failed') IS TRUE AS final, row_number() OVER (PARTITION BY run_id, status IN ('ok', 'failed') IS TRUE ORDER BY ts, event_id) AS place FROM t)
SELECT event_id, run_id, status, CASE WHEN NOT final THEN 'INVALID_INPUT' WHEN run_id % 5 = 0 OR run_id NOT IN (SELECT c_custkey FROM customer) THEN 'NOT_FOUND' ELSE 'INVALID_OPERATION' END AS error
FROM r WHERE NOT final OR place > 1 OR run_id % 5 = 0 OR run_id NOT IN (SELECT c_custkey FROM customer)""",
    "memories_inserted": f"""{_ITEMS} SELECT id, content, CASE WHEN tagged THEN lang || ',' || source ELSE '' END AS tags, coalesce(n, {_NO_VECTOR})::INT AS dimension, '2024-01-01T00:00:00.000Z' AS created_at FROM i WHERE NOT bad""",
    "memories_refused": f"{_ITEMS} SELECT id, 'INVALID_INPUT' AS error FROM i WHERE bad",
    "recall_search": f"SELECT doc_id, lang, 1.0::DOUBLE AS score FROM documents WHERE (lang = 'de' OR source = 'de') AND contains(lower(text), 'und') ORDER BY doc_id DESC LIMIT {memory.MOST}",
    "score_odd_vectors": """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 64 WHEN vec_id % 7 = 0 THEN 9 WHEN vec_id % 5 <> 0 THEN 64 END::INT AS n, CASE WHEN vec_id % 11 = 0 THEN true WHEN vec_id % 7 = 0 THEN false WHEN vec_id % 5 <> 0 THEN true END AS right_length,
  CASE WHEN vec_id % 11 = 0 THEN 0.0 WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 <> 0 THEN 1.0 END::DOUBLE AS score FROM embeddings""",
    "json_inputs": "SELECT event_id, event_id % 5 > 1 AS present, CASE WHEN event_id % 5 > 1 THEN (props->>'$.k')::INT END AS k FROM events",
    "url_settings": """WITH q AS (SELECT page_id, list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM pages)
SELECT page_id, len(parts)::INT AS n, len(list_filter(parts, lambda p: split_part(p, '=', 1) = 'ref')) > 0 AS has_ref, len(list_filter(parts, lambda p: split_part(p, '=', 1) = 'ref' AND p <> 'ref=x')) > 0 AS keeps_ref,
  array_to_string(list_sort(list_filter(parts, lambda p: NOT ends_with(p, '=x'))), '&') AS entries FROM q""",
    "routes": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS operation, CASE WHEN event_id % 2 <> 0 THEN event_type END AS tool, CASE WHEN event_id % 3 <> 0 THEN event_type END AS token FROM events""",
    "placeholders": "SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'SELECT 1' ELSE 'SELECT $' || l_linenumber || ', $' || l_partkey % 20 END AS statement, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE greatest(l_linenumber, l_partkey % 20) END::INT AS n FROM lineitem",
    "spoken_errors": "SELECT DISTINCT upper(event_type) || '_NOT_' || user_id % 4 || '_FOUND' AS code, event_type || ' not_' || user_id % 4 || '_found' AS said FROM events",
    "run_ids": """WITH d AS (SELECT DISTINCT md5(source || '-' || lang) AS h FROM documents), u AS (SELECT h, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS f FROM d)
SELECT f AS run_id, true AS valid FROM u UNION ALL SELECT upper(f), true FROM u UNION ALL SELECT h, false FROM u UNION ALL SELECT f || '0', false FROM u""",
} | search_queries.ORACLE_SQL | flow_queries.ORACLE_SQL
