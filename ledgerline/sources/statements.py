"""Spark SQL statements kept in files, with named parameters that are bound and never pasted into the text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_SHAPES = ("row", "rows", "value")


@dataclass(frozen=True)
class Statement:
    """``parameters`` are names, with ``:json`` after those whose value is sent as JSON text."""

    operation: str
    text: str
    parameters: tuple[str, ...]
    returns: str
    when: str | None = None


def markers(text: str) -> set[str]:
    """The names of the parameters ``:name`` in a statement, outside strings and comments."""
    return set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", _QUOTED.sub(" ", text)))


def load(spark: SparkSession, folder: str) -> list[Statement]:
    """The statements of ``statements.json`` in a folder: a list of objects with the fields ``operation``, ``file``,
    ``parameters``, ``returns`` (``row``, ``rows`` or ``value``) and perhaps ``when``, a parameter that must be given.

    Refused are other fields, parameters that are not the markers of the file, and an operation whose last
    statement has a ``when``."""

    def text(name: str) -> str:
        return spark.read.text(f"{folder}/{name}", wholetext=True).first()[0]

    out = []
    for entry in json.loads(text("statements.json")):
        if set(entry) - {"when"} != {"operation", "file", "parameters", "returns"} or entry["returns"] not in _SHAPES:
            raise ValueError(f"not a statement: {entry}")
        statement = Statement(entry["operation"], text(entry["file"]), tuple(entry["parameters"]), entry["returns"], entry.get("when"))
        declared = {p.removesuffix(":json") for p in statement.parameters}
        if declared != markers(statement.text):
            raise ValueError(f"{entry['file']} uses {sorted(markers(statement.text))} and declares {sorted(declared)}")
        out.append(statement)
    last = {s.operation: s for s in out}
    if any(s.when for s in last.values()):
        raise ValueError("the last statement of an operation must have no condition")
    return out


def _bound(value) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def answer(spark: SparkSession, known: list[Statement], operation: str, values: Mapping[str, object]) -> DataFrame:
    """Run the first statement of an operation whose condition is met; a parameter that is not given is null. The answer of
    a ``row`` or ``value`` has one row; where there is none that is a failure, ``NOT_FOUND``."""
    statement = next((s for s in known if s.operation == operation and (s.when is None or values.get(s.when) is not None)), None)
    if statement is None:
        raise ValueError(f"NOT_FOUND: unknown operation {operation}")
    given = {}
    for p in statement.parameters:
        name = p.removesuffix(":json")
        value = values.get(name)
        given[name] = _bound(json.dumps(value) if p != name and value is not None else value)
    out = spark.sql(statement.text, args=given)
    if statement.returns == "rows":
        return out
    one = (out.select("value") if statement.returns == "value" else out).limit(1)
    rows = one.collect()
    if not rows:
        raise ValueError(f"NOT_FOUND: {operation} found nothing")
    return spark.createDataFrame(rows, one.schema)
