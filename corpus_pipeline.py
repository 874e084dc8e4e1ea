"""From raw documents to packed training sequences, in stages that each read what the one before kept.

Every stage but the last keeps the columns of its input, whatever they are named. What the stages do with odd rows:

- a null text is scored like an empty one, has no near-duplicates, leaves substring dedup as an empty text and is packed
  as the end token alone;
- a null id is an id like any other for the classifiers and substring dedup, and stays in near-dedup;
- rows that share an id are judged each by its own text; rows that repeat id and text are judged alike, and near-dedup
  keeps one of them;
- an empty table gives an empty one; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.minhash_dedup import drop_near_duplicates
from ledgerline.llm.packing import pack
from ledgerline.llm.quality import quality_scores
from ledgerline.llm.storage import alone, discard, free_name, materialise
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.toxicity import toxicity_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    name = free_name(docs, "_hash")
    return docs.withColumn(name, F.xxhash64("text")), name


def _without(docs: DataFrame, rejected: DataFrame, hashed: str) -> DataFrame:
    """All columns of the documents whose id, null or not, and text are not in ``rejected``."""
    gone = rejected.select(F.col("doc_id").alias("gone_id"), F.col(hashed).alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score under 0.5)."""
    rows, name = _hashed(docs)
    scores = quality_scores(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(name,))
    return _without(docs, scores.where("predicted = 0"), name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score of 0.3 or more)."""
    rows, name = _hashed(docs)
    scores = toxicity_scores(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(name,))
    return _without(docs, materialise(scores.where("predicted = 1").select("doc_id", name)), name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates, and one of those that repeat id and text."""
    return drop_near_duplicates(docs, repeats=False)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; ``n_chars``, where there is one, follows the text."""
    out = remove_repeats(docs, n_words=free_name(docs, "_words_before"), n_removed=free_name(docs, "_words_gone"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4,096 tokens; columns other than id and text end here."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Two stages train classifiers and one tokenises by a vocabulary file, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. Each stage's output is written; its input and what was written to make it then go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return docs
