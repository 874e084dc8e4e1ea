"""The envelope of answers: its rules, its error codes and its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import valid_json
from ..schemas import RESULT_ERRORS


def breach(status: Column, data: Column, error: Column) -> Column:
    """What is wrong with an envelope, else null: ok has data and no error, any other status has an error."""
    ok = status == "ok"
    return F.when(~F.coalesce(status.isin("ok", "needs_clarification", "failed"), F.lit(False)), "unknown status").when(ok & (data.isNull() | error.isNotNull()), "status ok requires data and no error").when(~ok & error.isNull(), F.concat(F.lit("status "), status, F.lit(" requires an error")))


def error_code(status: Column, reported: Column) -> Column:
    """The code that a worker reported if it is a known one, else one by its status."""
    return F.when(reported.isin(RESULT_ERRORS), reported).when(status == "needs_clarification", "NEEDS_CLARIFICATION").when(status == "failed", "WORKER_FAILED")


def envelope(status: Column, data: Column, evidence: Column, run_id: Column, input_tokens: Column, output_tokens: Column, usd: Column, code: Column, message: Column) -> Column:
    cost = F.struct(input_tokens.cast("long").alias("input_tokens"), output_tokens.cast("long").alias("output_tokens"), usd.cast("double").alias("usd"))
    error = F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(message, F.lit("worker reported no message")).alias("message")))
    return F.struct(status.alias("status"), F.when(status == "ok", data).alias("data"), evidence.alias("evidence"), run_id.alias("run_id"), cost.alias("cost"), error.alias("error"))


def evidence(answers: DataFrame, items: str, source: str, *keep: str) -> DataFrame:
    """One row (source, ref, excerpt) for each item that has an id, from an array of structs (id, content)."""
    return answers.select(*keep, F.explode(items).alias("_item")).where("_item.id IS NOT NULL").select(*keep, F.lit(source).alias("source"), F.col("_item.id").alias("ref"), F.col("_item.content").alias("excerpt"))


def evidence_of_answers(answers: DataFrame, answer: str, source: str, *keep: str) -> DataFrame:
    """One row (source, ref, excerpt) for each record in JSON answers of any shape: an answer is a record or an array of them. A record
    counts if its ``id`` is a string, whatever else it holds; its ``content`` is the excerpt if that is a string. Answers that are no
    JSON, other values in an array and records without such an id give nothing."""
    parsed = F.when(valid_json(F.col(answer)), F.try_parse_json(F.col(answer)))
    listed = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed).otherwise(F.try_parse_json(F.concat(F.lit("["), F.col(answer), F.lit("]"))))
    own = answers.select(*keep, F.when(parsed.isNotNull(), listed).alias("_answer")).where("_answer IS NOT NULL")
    records = own.lateralJoin(answers.sparkSession.tvf.variant_explode(F.col("_answer").outer()).select(F.col("value").alias("_record")))

    def text(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_record", path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get("_record", path, "string"))

    return records.select(*keep, F.lit(source).alias("source"), text("$.id").alias("ref"), text("$.content").alias("excerpt")).where("ref IS NOT NULL")


def recall_answer(found: DataFrame, run_id: Column | None = None, content: str = "content", key: str = "id") -> DataFrame:
    """One row (value): the envelope of what a search found, as JSON; each row found is data and evidence."""
    item = F.struct(F.col(key).cast("string").alias("id"), F.col(content).alias("content"), F.col("score"))
    items = found.withColumn("_at", F.monotonically_increasing_id()).agg(F.array_sort(F.collect_list(F.struct("_at", item.alias("item")))).alias("rows"))
    data = F.transform("rows", lambda r: r["item"])
    seen = F.transform("rows", lambda r: F.struct(F.lit("memory").alias("source"), r["item"]["id"].alias("ref"), r["item"]["content"].alias("excerpt")))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    return items.select(F.to_json(envelope(F.lit("ok"), data, seen, none if run_id is None else run_id, zero, zero, zero, none, none)).alias("value"))


def cost_breach(cost: Column) -> Column:
    bad = (cost["input_tokens"] < 0) | (cost["output_tokens"] < 0) | (cost["usd"] < 0)
    return F.when(bad, "costs must not be negative")
