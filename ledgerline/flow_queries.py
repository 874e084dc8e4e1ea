"""Registered queries over flows of calls and runs, answers of any shape and contracts, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import contracts, gateway, results, runs
from .sources.tables import table

#: Calls of a caller and tool that the quota allows in a window, and its width.
LIMIT, WINDOW_MS = 3, 5 * 24 * 3600 * 1000


def gateway_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Calls to the journal: unknown tools, calls without a caller, and calls over the quota are refused and written down."""
    calls = table(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("at"))
    ended = F.timestamp_micros(F.unix_micros("at") + (F.col("call_id") % 100) * 1000)
    catalogue = spark.sql("SELECT * FROM VALUES ('view', 'web'), ('click', 'web'), ('purchase', 'shop') AS t(tool, owner)")
    return gateway.handled(calls.withColumn("ended", ended), catalogue, LIMIT, WINDOW_MS)


def lifecycle_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each turn of a conversation, taken as an event of a run: most are in order, some come twice, too early or after a gap."""
    turns = table(spark, sf, "conversations").where("NOT (turn = 2 AND conv_id % 11 = 0)")
    kinds = F.array(*map(F.lit, ["run.created", "worker.started", "worker.exited", "output.validated", "run.completed", "worker.exited", "run.completed", "what"]))
    at = F.when(F.col("conv_id") % 7 == 0, F.greatest(F.lit(0), F.col("turn") - 1)).when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 3), 4).otherwise(F.col("turn"))
    events = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.get(kinds, at.cast("int")).alias("type"))
    return runs.order_faults(events)


def evidence_of_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence from answers of many shapes, made from turns of conversations: arrays with other values among their records, single
    records, ids that are numbers, contents that are objects, and texts that are no JSON."""
    named = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content")))
    numbered = F.to_json(F.struct(F.col("turn").alias("id"), F.col("text").alias("content")))
    nested = F.to_json(F.struct(F.concat(F.lit("n"), "conv_id").alias("id"), F.struct("turn").alias("content")))
    shape = F.col("turn") % 4
    answer = F.when(shape == 0, F.concat(F.lit("["), named, F.lit(",7,null,"), numbered, F.lit(',["x"],'), nested, F.lit("]"))).when(shape == 1, named).when(shape == 2, numbered).otherwise(F.concat(named, F.lit("}")))
    return results.evidence_of_answers(table(spark, sf, "conversations").withColumn("answer", answer), "answer", "memory", "conv_id", "turn")


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, contracts.Contract]:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.when(F.col("l_partkey") % 17 != 0, F.col("l_shipdate")).alias("l_shipdate"), F.when(F.col("l_suppkey") % 13 == 0, "many").otherwise(F.col("l_suppkey").cast("string")).alias("l_suppkey"))
    schema = T.StructType([T.StructField("l_orderkey", T.LongType(), False), T.StructField("l_linenumber", T.IntegerType(), False), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType(), False), T.StructField("l_shipdate", T.TimestampNTZType(), False), T.StructField("l_suppkey", T.LongType())])
    orders = table(spark, sf, "orders").where("o_orderstatus != 'P'")
    return lines, contracts.Contract(schema, {"l_returnflag": ["A", "N"]}, {"quantity": F.col("l_quantity").between(1, 40)}, ("l_orderkey", "l_linenumber"), {"l_orderkey": (orders, "o_orderkey")})


def contract_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All that is wrong with line items by one contract: types, missing values, values that are not allowed, a rule, keys that repeat and
    orders that are not known."""
    lines, contract = _lines(spark, sf)
    return contracts.counts(contract.checked(lines))


def contract_refused(spark: SparkSession, sf: str) -> DataFrame:
    """How many line items a contract refuses, by all that is wrong with each."""
    lines, contract = _lines(spark, sf)
    return contract.split(lines)[1].groupBy(F.array_join("violations", " ").alias("violations")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (gateway_journal, lifecycle_faults, evidence_of_answers, contract_counts, contract_refused)}

_LINES = """l AS (SELECT *, CASE WHEN l_suppkey % 13 = 0 THEN 'type:l_suppkey' END AS t, CASE WHEN l_partkey % 17 = 0 THEN 'missing:l_shipdate' END AS m,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'allowed:l_returnflag' END AS a, CASE WHEN NOT (l_quantity BETWEEN 1 AND 40) THEN 'rule:quantity' END AS r,
  CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'key:l_orderkey,l_linenumber' END AS k,
  CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'reference:l_orderkey' END AS f FROM lineitem),
v AS (SELECT list_filter([t, m, a, r, k, f], lambda x: x IS NOT NULL) AS v FROM l)"""

ORACLE_SQL = {
    "gateway_journal": f"""WITH RECURSIVE c AS (SELECT event_id AS call_id, CASE WHEN user_id % 9 <> 0 THEN user_id::VARCHAR END AS subject, event_type AS tool, ts, epoch_us(ts) AS us, owner
  FROM events LEFT JOIN (VALUES ('view', 'web'), ('click', 'web'), ('purchase', 'shop')) t(tool, owner) ON tool = event_type),
o AS (SELECT *, row_number() OVER (PARTITION BY subject, tool ORDER BY us, call_id) AS n FROM c WHERE owner IS NOT NULL AND subject IS NOT NULL),
f AS (SELECT subject, tool, call_id, us, n, us AS start FROM o WHERE n = 1
  UNION ALL SELECT o.subject, o.tool, o.call_id, o.us, o.n, CASE WHEN o.us - f.start >= {WINDOW_MS * 1000} THEN o.us ELSE f.start END FROM f JOIN o ON o.subject = f.subject AND o.tool = f.tool AND o.n = f.n + 1),
q AS (SELECT call_id, row_number() OVER (PARTITION BY subject, tool, start ORDER BY us, call_id) AS used FROM f),
e AS (SELECT c.*, CASE WHEN owner IS NULL THEN 'UNKNOWN_TOOL' WHEN subject IS NULL THEN 'UNAUTHENTICATED' WHEN used > {LIMIT} THEN 'QUOTA_EXCEEDED' END AS error_code FROM c LEFT JOIN q ON q.call_id = c.call_id)
SELECT call_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, CASE WHEN owner IS NULL OR subject IS NULL THEN 'anonymous' ELSE subject END AS subject, tool, owner,
  CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS outcome, error_code, call_id % 100 AS duration_ms FROM e""",
    "lifecycle_faults": """WITH e AS (SELECT conv_id AS run_id, turn AS seq, (['run.created', 'worker.started', 'worker.exited', 'output.validated', 'run.completed', 'worker.exited', 'run.completed', 'what'])[1 + CASE WHEN conv_id % 7 = 0 THEN greatest(0, turn - 1) WHEN conv_id % 5 = 0 AND turn = 3 THEN 4 ELSE turn END] AS type
  FROM conversations WHERE NOT (turn = 2 AND conv_id % 11 = 0)),
p AS (SELECT *, lag(type) OVER w AS before, lag(seq) OVER w AS prior, coalesce(bool_or(type = 'run.completed') OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, seq, type, CASE WHEN done THEN type || ' after completion' WHEN seq <> coalesce(prior, -1) + 1 THEN 'gap in the sequence'
  WHEN (coalesce(before, '') || '>' || type) NOT IN ('>run.created', 'run.created>worker.started', 'worker.started>worker.exited', 'worker.exited>output.validated', 'worker.exited>output.invalid', 'worker.exited>run.completed', 'output.validated>run.completed', 'output.invalid>run.completed')
  THEN type || ' after ' || coalesce(before, 'nothing') END AS fault FROM p""",
    "evidence_of_answers": """SELECT conv_id, turn, 'memory' AS source, conv_id || '-' || turn AS ref, text AS excerpt FROM conversations WHERE turn % 4 IN (0, 1)
UNION ALL SELECT conv_id, turn, 'memory', 'n' || conv_id, NULL FROM conversations WHERE turn % 4 = 0""",
    "contract_counts": f"WITH {_LINES} SELECT violation, count(*) AS n FROM (SELECT unnest(v) AS violation FROM v) GROUP BY violation",
    "contract_refused": f"WITH {_LINES} SELECT array_to_string(v, ' ') AS violations, count(*) AS n FROM v WHERE len(v) > 0 GROUP BY violations",
}
