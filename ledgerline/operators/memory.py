"""Document memory: checked inserts, substring search and exact cosine search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from ..functions.vector import cosine, literal

DEFAULT_LIMIT, MOST = 5, 50


def limit_of(limit: int | None) -> int:
    """A limit of 1 to 50, by default 5."""
    limit = DEFAULT_LIMIT if limit is None else limit
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST:
        raise ValueError(f"INVALID_INPUT: limit must be an integer from 1 to {MOST}, not {limit!r}")
    return limit


def inserted(items: DataFrame, dimension: int = 384, now: Column | None = None) -> DataFrame:
    """``memory.insert``: rows (content, tags, embedding) with defaults, an id and a time, to be appended."""
    at = F.current_timestamp() if now is None else now
    ident = F.col("id") if "id" in items.columns else F.expr("uuid()")
    return items.where(insert_error(dimension).isNull()).select(ident.alias("id"), "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("embedding").cast("array<float>").alias("embedding"), at.cast("timestamp").alias("created_at"))


def insert_error(dimension: int = 384) -> Column:
    """``INVALID_INPUT`` for a row that :func:`inserted` refuses, else null."""
    empty = F.col("content").isNull() | (F.col("content") == "")
    size = F.col("embedding").isNotNull() & (F.size("embedding") != dimension)
    endless = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(empty | size | F.coalesce(endless, F.lit(False)) | F.coalesce(F.exists("tags", lambda t: t.isNull()), F.lit(False)), "INVALID_INPUT")


def search_text(memories: DataFrame, query: str, limit: int | None = None, content: str = "content", newest: str = "created_at", key: str = "id") -> DataFrame:
    """The newest memories whose content holds ``query``, case ignored; every score is 1. An empty query is in all."""
    found = memories.where(contains_ignoring_case(F.col(content), query))
    return found.orderBy(F.col(newest).desc(), F.col(key)).limit(limit_of(limit)).withColumn("score", F.lit(1.0))


def search_vector(memories: DataFrame, query: Sequence[float], limit: int | None = None, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The memories nearest to ``query`` by cosine, exactly; those without an embedding or of another dimension
    are skipped, like those with a component that is not finite; a zero vector has score 0, and ties go by key."""
    scored = memories.where(F.col(embedding).isNotNull()).withColumn("score", cosine(F.col(embedding), literal(query))).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(limit_of(limit))


def search(memories: DataFrame, query: str, embedding: Sequence[float] | None = None, limit: int | None = None, content: str = "content", newest: str = "created_at", key: str = "id", vector: str = "embedding") -> DataFrame:
    """``memory.search``: by vector where an embedding is given (the text is then ignored), else by text."""
    return search_text(memories, query, limit, content, newest, key) if embedding is None else search_vector(memories, embedding, limit, vector, key)


def recall(memories: DataFrame, query: str, limit: int | None = None, content: str = "content", newest: str = "created_at", key: str = "id") -> DataFrame:
    """The public tool over :func:`search_text`: an empty query is refused here."""
    if not query:
        raise ValueError("INVALID_INPUT: query must not be empty")
    return search_text(memories, query, limit, content, newest, key)


def tagged(memories: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    """Memories with a tag."""
    return memories.where(F.array_contains(tags, tag))
