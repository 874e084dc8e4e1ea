"""From calls to the journal: the tool's owner, the caller, the quota, and a row for each call whatever comes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quota
from .audit import call_error, journal, routed


def split_calls(calls: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (call_id, subject, tool, at, ended) with the ``owner`` of their tool: those of a known tool and caller, which count
    against a quota, and the others."""
    named = routed(calls, catalogue)
    known = F.col("owner").isNotNull() & F.col("subject").isNotNull()
    return named.where(known), named.where(~known)


def entries(counted: DataFrame, refused: DataFrame) -> DataFrame:
    """Journal rows, with their ``call_id``, of counted calls (with ``allowed``) and of those that were refused before. The tool is
    looked up first, so the caller of an unknown tool is not known."""
    columns = ["call_id", "subject", "tool", "owner", "at", "ended", "allowed"]
    both = counted.select(*columns).unionByName(refused.withColumn("allowed", F.lit(True)).select(*columns))
    error = call_error(F.col("owner"), F.col("subject"), F.col("allowed"))
    caller = F.when(F.col("owner").isNotNull(), F.col("subject"))
    return journal(both.withColumn("error", error).withColumn("subject", caller), F.col("error"), "at", "ended", keep=("call_id",))


def handled(calls: DataFrame, catalogue: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The journal of a table of calls, with their ``call_id``."""
    counted, refused = split_calls(calls, catalogue)
    return entries(quota.decisions(counted, ["subject", "tool"], "at", "call_id", limit, window_ms), refused)
