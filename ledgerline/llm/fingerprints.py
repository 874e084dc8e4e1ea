"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once. The top bits of a hash name its bin and a bin keeps its least hash: in
the sorted hashes of a text these are the first of each bin. An empty bin tries the other bins in an order
of its own (by a hash of the two bin numbers) and copies the first that is not empty; this is optimal
densification. Of each bin the low 8 bits are stored. Two fingerprints agree in a bin by chance once in 256
bins, and the likeness is corrected for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import discard, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, BITS, WORDS = 128, 8, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(text: Column) -> Column:
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def of(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        return F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), of)


def bin_codes(text: Column) -> Column:
    """The low bits of each bin, an array of ``BINS`` small integers; empty for a text without words."""
    shift = 64 - (BINS.bit_length() - 1)

    def bin_of(x: Column) -> Column:
        return (F.shiftright(x, shift) + BINS // 2).cast("int")

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit(2**BITS - 1)).cast("smallint")

    def fill(least: Column, bins: Column) -> Column:
        def borrowed(j: Column) -> Column:
            order = F.array_min(F.transform(bins, lambda b, i: F.struct(F.xxhash64(j, b).alias("h"), i.alias("i"))))
            return F.get(least, order["i"])

        def one(j: Column) -> Column:
            return _let(F.array_position(bins, j).cast("int"), lambda at: low(F.when(at > 0, F.get(least, at - 1)).otherwise(borrowed(j))))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one)

    def of(ordered: Column) -> Column:
        least = F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(ordered, i - 1), shift)))

        def codes(own: Column) -> Column:
            return F.when(F.size(own) == BINS, F.transform(own, low)).when(F.size(own) == 0, F.array().cast("array<smallint>")).otherwise(_let(F.transform(own, bin_of), lambda bins: fill(own, bins)))

        return _let(least, codes)

    return _let(F.sort_array(_shingles(text)), of)


def packed(codes: Column) -> Column:
    """The codes as lower-case hex, two digits each."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets of two texts, 0 to 1. Two texts without words are alike (1)."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(a, i) == F.get(b, i)))
    chance = 2.0**-BITS
    seen = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(seen)


def _previous(keys: DataFrame, parts: int) -> DataFrame:
    """Each different (id, h, n) with the one before it in descending order of id; before the first comes
    the last. Ids are dealt by range; only the last of each range, one row a partition, meet in one task."""
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    ranged = keys.distinct().repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    written = materialise(ranged)
    own = W.partitionBy("part").orderBy(*order)
    row = F.struct("id", "h", "n")
    rowed = written.withColumn("before", F.lag(row).over(own)).withColumn("last", F.lead(F.lit(1)).over(own).isNull())
    rowed = materialise(rowed)
    discard(written)
    ends = rowed.where("last").select("part", row.alias("end"))
    around = W.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(around), F.last("end").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"))
    out = materialise(rowed.join(ends, "part").withColumn("p", F.coalesce("before", "end")).select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), F.col("p.id").alias("to_id"), F.col("p.h").alias("to_h"), F.col("p.n").alias("to_n")))
    discard(rowed)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, and an edited copy of it: its last floor(n_chars / 3) characters give way to the
    first as many (or all) of the next document in descending order of id, after the last the first.

    Returns for each input row ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. A null text counts as empty; a text without words has the empty
    fingerprint. Rows without an id come last; rows that share an id go by a hash of their text; rows that
    are equal in both count as one document in the order, and each gets its result. One document is its own next.
    An empty table gives an empty one. Columns other than the two are not read, whatever their names. A very long text is
    one value of a column, as are the arrays of its hashes. The result is written, so that it does not keep the
    shuffle of the texts.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    before = _previous(keyed.select("id", "h", F.length("text").alias("n")), parts)
    # both joins below read the same columns by the same keys, so the texts are shuffled once
    coded = keyed.withColumn("codes", bin_codes(F.col("text")))
    heads = coded.join(before, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")))
    heads = heads.select("to_id", "to_h", F.expr("substring(text, 1, int(to_n div 3))").alias("head"), F.col("codes").alias("next_codes")).dropDuplicates(["to_id", "to_h"])
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 3))"), F.col("head"))
    both = coded.join(heads, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h"))).withColumn("edited", edited).withColumn("edited_codes", bin_codes(F.col("edited")))
    out = materialise(both.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("codes")).alias("fingerprint"),
        packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    ))
    discard(before)
    return out
