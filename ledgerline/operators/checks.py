"""Table constraints as queries that return the rows against them; an empty answer means that they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is not null and in no parent."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return children.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def repeated_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(table: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is null or not in ``allowed``."""
    return table.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def missing(table: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in a column that must have a value."""
    return table.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def out_of_range(table: DataFrame, column: str, low, high=None) -> DataFrame:
    bound = F.col(column) < low if high is None else ~F.col(column).between(low, high)
    return table.where(bound)
