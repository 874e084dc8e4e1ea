"""Times and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(at: Column) -> Column:
    """ISO 8601 with milliseconds, as in ``2026-01-02T03:04:05.678Z``; the session's time zone must be UTC."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def json_or_null(text: Column) -> Column:
    """JSON text as a variant; a JSON null, like SQL null, is absent."""
    parsed = F.parse_json(text)
    return F.when(~F.is_variant_null(parsed), parsed)


def valid_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. The parser stops after the first value, so the text is also
    parsed inside an array and inside an object: what follows a value breaks one of the two."""
    listed = F.concat(F.lit("["), text, F.lit("]"))
    named = F.concat(F.lit('{"v":'), text, F.lit("}"))
    whole = F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull()
    return F.when(text.isNotNull(), whole & F.coalesce(F.json_array_length(listed) == 1, F.lit(False)))


def json_value(text: Column) -> Column:
    """JSON text as a value that stays nested in JSON made from it; what is no JSON stays the text that it is."""
    return F.coalesce(F.when(valid_json(text), F.try_parse_json(text)), text.cast("variant"))


def ordered_json(items: Column, by: str | None = None) -> Column:
    """An array of structs as JSON, in the order of the structs' fields, or of the number in the field ``by`` alone where others, such
    as parsed JSON, have no order; null fields are left out."""
    ordered = F.array_sort(items) if by is None else F.array_sort(items, lambda x, y: F.when(x[by] < y[by], -1).when(x[by] > y[by], 1).otherwise(0))
    return F.coalesce(F.to_json(ordered), F.lit("[]"))


def vector_of_json(text: Column) -> Column:
    """A JSON array of numbers as a vector; null for anything else, such as more text after it or a component that is no
    number."""
    parsed = F.from_json(text, "array<float>")
    return F.when(valid_json(text) & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def has_key(values: Column, key: Column | str) -> Column:
    """Whether a map has a key of its own, be its value null."""
    return F.coalesce(F.map_contains_key(values, key), F.lit(False))


def without_nulls(values: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(values, lambda _, v: v.isNotNull())
