"""The journal of calls: one row each, refusals included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import duration_ms, iso_time


def routed(calls: DataFrame, catalogue: DataFrame, tool: str = "tool") -> DataFrame:
    """Calls with the owner of their tool, null for an unknown tool."""
    return calls.join(catalogue.select(F.col("tool").alias(tool), "owner"), tool, "left")


def owners(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("owner").distinct()


def call_error(owner: Column, subject: Column, allowed: Column) -> Column:
    """The first check that a call fails: known tool, known caller, quota."""
    return F.when(owner.isNull(), "UNKNOWN_TOOL").when(subject.isNull(), "UNAUTHENTICATED").when(~allowed, "QUOTA_EXCEEDED")


def journal(calls: DataFrame, error: Column, at: str = "at", ended: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (at, subject, tool, owner, outcome, error_code, duration_ms) of calls with these columns and their end, after the columns
    ``keep``."""
    spent = duration_ms(F.col(at), F.col(ended)) if ended else F.lit(0).cast("long")
    return calls.select(*keep, iso_time(F.col(at)).alias("at"), F.coalesce("subject", F.lit("anonymous")).alias("subject"), "tool", "owner", F.when(error.isNull(), "ok").otherwise("error").alias("outcome"), error.alias("error_code"), spent.alias("duration_ms"))


def rollup(entries: DataFrame, *by: str) -> DataFrame:
    """Calls, and how long they took, by outcome and error."""
    return entries.groupBy(*by, "outcome", "error_code").agg(F.count("*").alias("calls"), F.max("duration_ms").alias("longest_ms"))
