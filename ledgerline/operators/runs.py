"""Runs and their events, as append-only logs from which the current state is derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import iso_time, json_value, ordered_json
from ..schemas import EVENT_ORDER


def created(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """``runs.create``: a running run for each (service, tool, input), to be appended to the run log."""
    at = F.current_timestamp() if now is None else now
    ident = F.col("id") if "id" in requests.columns else F.expr("uuid()")
    return requests.select(ident.alias("id"), "service", "tool", F.coalesce("input", F.lit("null")).alias("input"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("result"), at.cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def next_sequence(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """The sequence number that the next event of each run takes."""
    return events.groupBy(run).agg((F.max(seq) + 1).alias("next_seq"))


def next_sequence_of(events: DataFrame, value, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """The same of one run: always one row, 0 for a run without events."""
    return events.where(F.col(run) == F.lit(value)).agg(F.coalesce(F.max(seq) + 1, F.lit(0)).alias("next_seq"))


def numbered(events: DataFrame, run: str, *order: str | Column, name: str = "seq") -> DataFrame:
    """``runs.appendEvent`` for many events at once: numbers from 0 in each run. ``order`` must be total."""
    return events.withColumn(name, F.row_number().over(W.partitionBy(run).orderBy(*order)) - 1)


def appended(log: DataFrame, new: DataFrame, *order: str | Column) -> DataFrame:
    """New events (run_id, type, payload, at) with numbers that go on from those of the log."""
    known = next_sequence(log)
    fresh = numbered(new, "run_id", *order).join(known, "run_id", "left")
    return fresh.withColumn("seq", (F.col("seq") + F.coalesce("next_seq", F.lit(0))).cast("int")).withColumn("payload", F.coalesce("payload", F.lit("{}"))).drop("next_seq")


def settle(runs: DataFrame, completions: DataFrame, *order: str | Column) -> tuple[DataFrame, DataFrame]:
    """``runs.complete`` for many attempts (run_id, status, result, at): the first attempt of a run is its completion.

    Returns the current state of all runs, open ones included, and the refused attempts with an error: a later
    attempt is ``INVALID_OPERATION``, one for an unknown run ``NOT_FOUND``, a status that is not final
    ``INVALID_INPUT``."""
    final = F.col("status").isin("ok", "needs_clarification", "failed")
    known = completions.join(runs.select(F.col("id").alias("run_id"), F.lit(True).alias("known")), "run_id", "left")
    place = F.row_number().over(W.partitionBy("run_id", F.coalesce(final, F.lit(False))).orderBy(*order))
    ranked = known.withColumn("final", F.coalesce(final, F.lit(False))).withColumn("place", place)
    error = F.when(~F.col("final"), "INVALID_INPUT").when(F.col("known").isNull(), "NOT_FOUND").when(F.col("place") > 1, "INVALID_OPERATION")
    judged = ranked.withColumn("error", error)
    first = judged.where("error IS NULL").select("run_id", F.col("status").alias("_status"), F.col("result").alias("_result"), F.col("at").alias("_at"))
    state = runs.join(first, runs["id"] == first["run_id"], "left").select("id", "service", "tool", "input", F.coalesce("_status", runs["status"]).alias("status"), F.coalesce("_result", runs["result"]).alias("result"), "created_at", F.coalesce("_at", runs["completed_at"]).alias("completed_at"))
    return state, judged.where("error IS NOT NULL").drop("known", "final", "place")


def first_attempts(attempts: DataFrame, run: str, *order: str | Column) -> DataFrame:
    """The attempt that counts for each run."""
    return attempts.withColumn("attempt", F.row_number().over(W.partitionBy(run).orderBy(*order))).where("attempt = 1").drop("attempt")


def later_attempts(attempts: DataFrame, run: str, *order: str | Column) -> DataFrame:
    """The attempts that are refused, with their number."""
    return attempts.withColumn("attempt", F.row_number().over(W.partitionBy(run).orderBy(*order))).where("attempt > 1")


def run(runs: DataFrame, ident) -> DataFrame:
    """``runs.get``."""
    return runs.where(F.col("id") == F.lit(ident))


def events_json(runs: DataFrame, events: DataFrame, run_key: str, event_key: str, item: Column, present: Column, by: str | None = "seq") -> DataFrame:
    """``runs.events`` for every run: its events as one JSON array, ``[]`` for a run without events.

    ``item`` is a struct that begins with the sequence number, which is named ``by``; with None whole items are compared, which is
    faster but impossible where a field, such as parsed JSON, has no order. ``present`` tells events from missing ones. Events meet by
    run before the join, so a run's events move once."""
    gathered = events.where(present).groupBy(F.col(event_key).alias("_run")).agg(F.collect_list(item).alias("_items"))
    joined = runs.select(run_key).join(gathered, F.col(run_key) == F.col("_run"), "left")
    return joined.select(run_key, ordered_json(F.col("_items"), by).alias("value"))


def event_item(seq: str = "seq", at: str = "at") -> Column:
    """An event of the log as an item of :func:`events_json`, its payload as an object and not as text; such items go ``by`` ``seq``."""
    return F.struct(F.col(seq).alias("seq"), "run_id", "type", json_value(F.col("payload")).alias("payload"), iso_time(F.col(at)).alias("at"))


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each run replayed from its events (run_id, seq, type, payload): status, number of events, whether
    the output was validated, and events after completion, which are allowed. A completion that names no status makes the run
    ``invalid``."""
    done = F.min(F.when(F.col("type") == "run.completed", F.col("seq"))).alias("completed_seq")
    status = F.min_by(F.get_json_object("payload", "$.status"), F.when(F.col("type") == "run.completed", F.col("seq"))).alias("_status")
    seen = events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"), F.max((F.col("type") == "output.validated").cast("int")).alias("validated"), done, status)
    return seen.select("run_id", F.coalesce(F.when(F.col("completed_seq").isNotNull(), F.coalesce("_status", F.lit("invalid"))), F.lit("running")).alias("status"), "n_events", (F.col("validated") == 1).alias("validated"), F.coalesce(F.col("last_seq") > F.col("completed_seq"), F.lit(False)).alias("late_events"))


def order_fault(kind: Column, before: Column, first: Column, gap: Column, late: Column) -> Column:
    """What is wrong with an event's place in its run, else null: ``late`` after the run's completion, a ``gap`` in the sequence, or
    a type that may not follow the one ``before``; ``first`` tells the first event of a run."""
    allowed = F.create_map(*[F.lit(x) for t, after in EVENT_ORDER.items() if t for x in (t, ",".join(after))])
    fits = F.when(first, kind.isin(EVENT_ORDER[None])).otherwise(F.array_contains(F.split(F.get(F.array(F.element_at(allowed, before)), F.lit(0)), ","), kind))
    wrong = F.concat(kind, F.lit(" after "), F.when(first, F.lit("nothing")).otherwise(before))
    return F.when(late, F.concat(kind, F.lit(" after completion"))).when(gap, "gap in the sequence").when(~F.coalesce(fits, F.lit(False)), wrong)


def order_faults(events: DataFrame) -> DataFrame:
    """Each event (run_id, seq, type) and the ``fault`` of its place, by the order in which a run's events follow each other. An event
    meets the one before it by run and number, so that a run with very many events is dealt to many tasks; numbers
    are from 0 and unique in a run."""
    own = events.select("run_id", "seq", "type")
    before = own.select("run_id", (F.col("seq") + 1).alias("seq"), F.col("type").alias("before"))
    done = own.where("type = 'run.completed'").groupBy("run_id").agg(F.min("seq").alias("done"))
    met = own.join(before, ["run_id", "seq"], "left").join(done, "run_id", "left")
    first = F.col("seq") == 0
    fault = order_fault(F.col("type"), F.col("before"), first, ~first & F.col("before").isNull(), F.coalesce(F.col("seq") > F.col("done"), F.lit(False)))
    return met.select("run_id", "seq", "type", fault.alias("fault"))
