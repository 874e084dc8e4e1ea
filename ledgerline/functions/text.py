"""Strings: substring tests that ignore case, cutting, routes and configuration values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ignoring_case(text: Column, needle: Column | str) -> Column:
    """Whether ``text`` holds ``needle``, both in lower case; ``%``, ``_`` and ``\\`` are ordinary characters."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(needle))


def escape_like(needle: Column) -> Column:
    """For a LIKE pattern with the escape character ``\\``."""
    escaped = F.replace(F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%"))
    return F.replace(escaped, F.lit("_"), F.lit("\\_"))


def like_ignoring_case(text: Column, needle: Column) -> Column:
    """The same test as :func:`contains_ignoring_case` by an escaped pattern."""
    return F.call_function("like", F.lower(text), F.lower(F.concat(F.lit("%"), escape_like(needle), F.lit("%"))))


def version_of(file_name: Column) -> Column:
    """The four digits that a migration file's name begins with."""
    return F.substring(file_name, 1, 4)


def is_migration(file_name: Column) -> Column:
    return file_name.rlike(r"^\d{4}_[a-z0-9_]+\.sql$")


def container_name(text: Column) -> Column:
    """With ``-`` for each character that a container's name may not have."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "-")


def service_variable(service: Column) -> Column:
    return F.concat(F.upper(service), F.lit("_URL"))


def operation_of(route: Column) -> Column:
    """The operation in a route ``/v1/ops/<name>``, else null."""
    return F.nullif(F.regexp_extract(route, r"^/v1/ops/([A-Za-z.]+)$", 1), F.lit(""))


def internal_tool_of(route: Column) -> Column:
    """The tool in a route ``/internal/<tool>``, else null."""
    return F.nullif(F.regexp_extract(route, r"^/internal/([a-z_]+)$", 1), F.lit(""))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def bearer_token(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"^Bearer (.+)$", 1), F.lit(""))


def token_subjects(setting: Column, between: str = ";") -> Column:
    """``token=subject;token=subject`` as a map; empty parts are left out."""
    parts = F.filter(F.transform(F.split(setting, between), F.trim), lambda p: p != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))))


def most_placeholders(statement: Column) -> Column:
    """The highest n of the placeholders ``$n`` in a statement; 0 without any."""
    found = F.regexp_extract_all(statement, F.lit(r"\$(\d+)"), F.lit(1))
    return F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))), F.lit(0)))


def spoken(code: Column) -> Column:
    """An error code in lower case with its first underscore as a space."""
    return F.regexp_replace(F.lower(code), r"^([^_]*)_", "$1 ")
