"""Registered queries over vectors and texts by index, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.nearest import nearest
from .operators.text_index import TextIndex
from .operators.vector_index import VectorIndex
from .sources.scratch import scratch_path
from .sources.tables import table

#: Neighbours of a query. The vectors of the test tables point anywhere, so most of the cells are read for 90 % of all
#: neighbours; for those of cosine ``CLOSE`` or more a few do.
NEIGHBOURS, SHARE, FEW, CLOSE = 50, 0.75, 3, 0.8
#: Texts that are looked for, rare and frequent, and how many of each are wanted.
NEEDLES, RECENT = ["the", "UND", "é", "É", "ción", "100%", "###", "&&&", "license", "copyright", "@", "http", "zq", "Keit ", "password", ".\n", "\u00df", "mente que", "qqqq", "a b"], 5


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0")


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of all vectors to each whose id is divisible by 20."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = nearest(_asked(vectors), vectors, NEIGHBOURS, "vec_id", "embedding", "vec_id", "embedding")
    return found.select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def _index(spark: SparkSession, sf: str) -> VectorIndex:
    return VectorIndex.build(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), scratch_path(spark, "vector-index"), "vec_id")


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The index asked with all its cells for what is nearest to its first vector."""
    index = _index(spark, sf)
    query = table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]
    found = index.search(query, NEIGHBOURS, len(index.centroids()))
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many vectors are in a cell of the index, how many neighbours are wanted, and whether a search in three quarters of the cells
    gives 90 % of them, and one in three cells 90 % of the close ones."""
    index = _index(spark, sf)
    seen = index.rows().agg(F.count("*").alias("stored"), F.count("cell").alias("celled"))
    queries, probes = _asked(table(spark, sf, "embeddings")), int(SHARE * len(index.centroids()))
    path = scratch_path(spark, "neighbours")
    nearest(queries, index.rows(), NEIGHBOURS, "vec_id", "embedding", "vec_id", "embedding").write.parquet(path)
    exact = spark.read.parquet(path)
    found = index.recall(queries, NEIGHBOURS, "vec_id", probes=probes, exact=exact)
    close = index.recall(queries, NEIGHBOURS, "vec_id", probes=FEW, least=CLOSE, exact=exact).select(F.col("recall").alias("close"))
    return seen.crossJoin(found).crossJoin(close).select("stored", "celled", "wanted", (F.col("recall") >= 0.9).alias("reached"), (F.col("close") >= 0.9).alias("close_reached"))


def text_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The newest documents that hold each of some needles, by an index of character triples."""
    index = TextIndex.build(table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "text-index"), "doc_id", "text")
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    return index.search_many(needles, RECENT, "doc_id").select("needle", "rank", "doc_id")


QUERIES = {f.__name__: f for f in (nearest_vectors, index_search, index_recall, text_index_search)}

_COSINE = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"

ORACLE_SQL = {
    "nearest_vectors": f"""SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query, r.vec_id, {_COSINE.format('q.embedding', 'r.embedding')} AS score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format('q.embedding', 'r.embedding')} DESC, r.vec_id))::INT AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0) WHERE rank <= {NEIGHBOURS}""",
    "index_search": f"""WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, label, round({_COSINE.format('embedding', 'v')}, 6) AS score FROM embeddings, q ORDER BY {_COSINE.format('embedding', 'v')} DESC, vec_id LIMIT {NEIGHBOURS}""",
    "text_index_search": f"""WITH n(needle) AS (VALUES {", ".join("('" + n + "')" for n in NEEDLES)})
SELECT * FROM (SELECT needle, (row_number() OVER (PARTITION BY needle ORDER BY doc_id DESC))::INT AS rank, doc_id FROM documents, n WHERE contains(lower(text), lower(needle))) WHERE rank <= {RECENT}""",
    "index_recall": f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 20 = 0) AS q FROM embeddings)
SELECT n AS stored, n AS celled, q * least(n, {NEIGHBOURS}) AS wanted, true AS reached, true AS close_reached FROM n""",
}
