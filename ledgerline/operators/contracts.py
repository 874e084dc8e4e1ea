"""A table's contract checked in one pass: each row with the names of all that is wrong with it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import free_name


@dataclass(frozen=True)
class Contract:
    """``schema`` gives types and which fields must have a value, ``allowed`` the values of fields with few, ``rules`` conditions that
    must not be false, ``key`` the fields that no two rows share, and ``references`` for a field the table and column that must
    know its value."""

    schema: T.StructType
    allowed: Mapping[str, list] = field(default_factory=dict)
    rules: Mapping[str, Column] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)

    def checked(self, rows: DataFrame) -> DataFrame:
        """All rows and columns with one more column, ``violations``: names in the order type, missing, allowed, rule, key, reference.

        The table is read once. Values of the wrong type, such as a text that is no number, count as ``type:<field>`` where they can't
        be cast. A null is only ever missing: it breaks no rule, repeats no key and needs no reference. Rows of one key meet to be
        counted, sorted and spilled where they are many; rows without a key do not. A column that is named ``violations`` gives way."""
        names = {c.lower() for c in rows.columns}
        lost = [f.name for f in self.schema if f.name.lower() not in names]
        if lost:
            raise ValueError(f"columns are missing: {', '.join(lost)}")
        out = rows.drop(*[c for c in rows.columns if c.lower() == "violations"])
        kept = out.columns
        found: list[Column] = []
        for f in self.schema:
            if out.schema[f.name].dataType != f.dataType:
                found.append(F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f"type:{f.name}"))
        found += [F.when(F.col(f.name).isNull(), f"missing:{f.name}") for f in self.schema if not f.nullable]
        found += [F.when(F.col(name).isNotNull() & ~F.col(name).isin(values), f"allowed:{name}") for name, values in self.allowed.items()]
        found += [F.when(~condition, f"rule:{name}") for name, condition in self.rules.items()]
        if self.key:
            count = free_name(out, "_count")
            whole = F.forall(F.array(*[F.col(k).isNull() for k in self.key]), lambda x: ~x)
            spread = F.when(whole, F.lit(0)).otherwise(F.monotonically_increasing_id())
            out = out.withColumn(count, F.when(whole, F.count("*").over(W.partitionBy(*self.key, spread))))
            found.append(F.when(F.col(count) > 1, f"key:{','.join(self.key)}"))
        for name, (table, column) in self.references.items():
            seen, own = free_name(out, "_seen"), free_name(out, "_known")
            known = table.select(F.col(column).alias(own)).where(F.col(own).isNotNull()).distinct().withColumn(seen, F.lit(True))
            out = out.join(known, F.col(name) == F.col(own), "left").drop(own)
            found.append(F.when(F.col(name).isNotNull() & F.col(seen).isNull(), f"reference:{name}"))
        return out.select(*[F.col(f"`{c}`") for c in kept], F.array_compact(F.array(*found) if found else F.array().cast("array<string>")).alias("violations"))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The accepted rows in the types of the schema, other columns dropped, and the refused ones with their ``violations``."""
        judged = self.checked(rows)
        typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in self.schema]
        return judged.where(F.size("violations") == 0).select(*typed), judged.where(F.size("violations") > 0)


def counts(judged: DataFrame) -> DataFrame:
    """How many rows each violation has."""
    return judged.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))
