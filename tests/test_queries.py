"""Every registered query against DuckDB on the same tables, and that the training-data part may be absent."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ledgerline import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _rows(columns, rows) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(r[i] for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_duckdb(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    found = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(found.columns)
    assert _rows(out.columns, out.collect()) == _rows(found.columns, found.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry_without_the_training_data_part():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "ledgerline.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert set(e.queries()) == set(e.oracle_sql()) and not any(n.startswith("op") for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_text_search_plan_is_a_top_k(spark):
    plan = catalogue.search_text(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
