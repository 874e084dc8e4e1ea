"""Contracts, evidence of any shape and the index of texts on small literal tables."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline import flow_queries
from ledgerline.operators import checks, memory, results
from ledgerline.operators.contracts import Contract, counts
from ledgerline.operators import text_index
from ledgerline.operators.text_index import RANGE, TextIndex, triples

SF = "/root/testdata/sf0.001"


def test_a_contract_names_all_that_is_wrong_with_a_row(spark):
    schema = spark.createDataFrame([], "id int NOT NULL, kind string NOT NULL, n int, parent int").schema
    rows = [("1", "a", "5", 1), ("1", "b", "x", 9), (None, "c", "-1", None), (None, None, None, 1), ("7", "a", "-2", 2), ("z", "a", "1", 1)]
    table = spark.createDataFrame([(*r, "old") for r in rows], "id string, kind string, n string, parent int, Violations string")
    parents = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    contract = Contract(schema, {"kind": ["a", "b"]}, {"positive": F.col("n").try_cast("int") > 0}, ("id",), {"parent": (parents, "id")})
    judged = contract.checked(table)
    assert judged.columns == ["id", "kind", "n", "parent", "violations"]
    assert sorted(r.violations for r in judged.collect()) == sorted([["key:id"], ["type:n", "key:id", "reference:parent"], ["missing:id", "allowed:kind", "rule:positive"], ["missing:id", "missing:kind"], ["rule:positive"], ["type:id"]])
    accepted, refused = contract.split(table)
    assert accepted.schema.simpleString() == "struct<id:int,kind:string,n:int,parent:int>" and accepted.count() == 0 and refused.count() == 6
    good = table.where("n = '5'")
    assert [tuple(r) for r in contract.split(good)[0].collect()] == [(1, "a", 5, 1)]
    assert contract.checked(table.where("false")).count() == 0
    with pytest.raises(ValueError, match="missing: kind"):
        contract.checked(table.drop("kind"))


def test_a_contract_reads_its_table_once_and_counts_as_the_single_checks_do(spark):
    lines, contract = flow_queries._lines(spark, SF)
    judged = contract.checked(lines)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 2  # the line items and the orders
    found = {r.violation: r.n for r in counts(judged).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus != 'P'")
    assert found["missing:l_shipdate"] == checks.missing(lines, "l_shipdate").count()
    assert found["allowed:l_returnflag"] == checks.outside(lines, "l_returnflag", ["A", "N"]).count()
    assert found["rule:quantity"] == checks.out_of_range(lines, "l_quantity", 1, 40).count()
    assert found["reference:l_orderkey"] == checks.orphans(lines, orders, "l_orderkey", "o_orderkey").count()
    assert found["key:l_orderkey,l_linenumber"] == checks.repeated_keys(lines, "l_orderkey", "l_linenumber").agg(F.sum("n")).first()[0]


def test_evidence_of_answers_of_any_shape(spark):
    answers = ['[{"id":"x","content":"c"},{"id":5},7,null,["id"],{"id":"y","content":{"z":1}},{"id":null}]', '{"id":"one","more":[1]}', '{"a":[{"id":"deep"}]}', "7", '"id"', "null", "[]", "", "no json", '{"id":"q"} x', None, '[[{"id":"nested"}]]']
    table = spark.createDataFrame(list(enumerate(answers)), "n int, answer string")
    out = results.evidence_of_answers(table, "answer", "memory", "n")
    assert out.columns == ["n", "source", "ref", "excerpt"]
    assert sorted(map(tuple, out.collect())) == [(0, "memory", "x", "c"), (0, "memory", "y", None), (1, "memory", "one", None)]


def test_triples_are_of_lower_case_characters(spark):
    row = spark.createDataFrame([("ABab", "É日本", "ab", "", None)], "a string, b string, c string, d string, e string").select(*[triples(F.col(c)).alias(c) for c in "abcde"]).first()
    assert (sorted(row.a), row.b, row.c, row.d, row.e) == (["aba", "bab"], ["é日本"], [], [], None)


def test_text_index_equals_the_search_of_all_texts_and_reads_few(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    more = spark.range(3000).select((F.col("id") + 10_000).alias("id"), F.concat(F.lit("Filler "), F.sha2(F.col("id").cast("string"), 256)).alias("content"))
    odd = spark.createDataFrame([(90_000, None), (90_001, ""), (90_002, "ÄÖ"), (90_003, "100%_x\\y needle")], docs.schema)
    table = docs.unionByName(more).unionByName(odd).withColumn("range", F.lit("clash"))
    index = TextIndex.build(table, str(tmp_path / "index"))
    total = index.texts().count()
    assert total == table.count()
    needles = ["needle", "%_x\\", "the", "UND", "äö", "ä", "", "filler 5feceb66", "zzzz", "no such text", "%"]
    tested = {}
    for n in needles:
        expected = [r.id for r in memory.search_text(table, n, 7, newest="id").collect()]
        assert [r.id for r in index.search(n, 7, newest="id").collect()] == expected
        tested[n] = index.candidates(n).count()
    assert tested["needle"] <= 3 * RANGE < total and tested["filler 5feceb66"] < total / 2 and tested["zzzz"] == 0 and tested["ä"] == total
    many: dict = {}
    for r in index.search_many(spark.createDataFrame([(n,) for n in needles], "needle string"), 7, newest="id").orderBy("needle", "rank").collect():
        many.setdefault(r.needle, []).append(r.id)
    assert many == {n: ids for n in needles if (ids := [r.id for r in memory.search_text(table, n, 7, newest="id").collect()])}


def test_stored_triples_are_the_numbers_of_those_asked_for(spark):
    texts = ["ABab", "É日本", "x😀y😀x", "ab", "", "aaaa\n"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4, 0], pa.int32()), pa.array([t.lower() for t in texts])], ["range", "text"])
    stored = {(r["range"], r["triple"]) for b in text_index._codes_in([batch]) for r in b.to_pylist()}
    asked = spark.createDataFrame(list(zip([0, 1, 2, 3, 4, 0], texts)), "range int, text string").select("range", F.explode(text_index._codes(F.col("text")))).collect()
    assert stored == {tuple(r) for r in asked} and len(stored) == 8
