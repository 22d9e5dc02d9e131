"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts (``repartitionByRange`` on their
leading characters and digest, which bounds what a sample carries), the sort of the window
places equal texts next to each other, spilling to disk where needed, and the window
compares neighbouring texts in full to find where a group ends.

A group with more rows than an average partition is split over several salts.  Its size and
its best row come from an aggregate by digest that is combined before its shuffle; such
groups are fewer than partitions, so their table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, partitions, squeezed, unpacked

HEAD = 16  # leading characters that order the range partitions; the digest orders the rest
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int | None = None) -> DataFrame:
    """All rows of ``docs`` with the group of equal texts that each belongs to.

    Texts are equal when identical without U+0020 and U+0009 to U+000D; null counts as empty,
    and empty texts are equal to each other.  Of a group stays the row with the most code
    points, then the smallest id; a null id comes last, and of rows that repeat id and text
    one stays.  Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, which take the
    place of columns so named; all other columns pass through.  An empty table gives an empty
    table.  ``hot_rows`` is the group size beyond which a group is split (default: the rows of
    an average partition, 100 at least).
    """
    parts = partitions(docs.sparkSession)
    limit = hot_rows or max(100, docs.count() // parts + 1)
    rows = docs.select(packed(docs, RESULTS).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    squeezed_text = squeezed(F.col("text"))
    points = F.coalesce(F.length("text"), F.lit(0))
    rank = F.struct((-points).alias("points"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    keyed = rows.withColumn("digest", F.sha2(squeezed_text, 256))

    hot = (
        keyed.groupBy("digest")
        .agg(F.count("*").alias("hot_size"), F.min(rank).alias("hot_best"))
        .where(F.col("hot_size") > limit)
        .withColumn("salts", F.ceil(F.col("hot_size") / limit))
    )
    salted = keyed.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0))
    )
    dealt = salted.withColumn("head", F.substring(squeezed_text, 1, HEAD)).repartitionByRange(parts, "head", "digest", "salt")
    group = Window.partitionBy("head", "digest", "norm", "salt").orderBy(points.desc(), F.col("id").asc_nulls_last())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = (
        dealt.withColumn("norm", squeezed_text)
        .withColumn("place", F.row_number().over(group))
        .withColumn("best", F.coalesce("hot_best", F.first(rank).over(whole)))
        .withColumn("size", F.coalesce("hot_size", F.count("*").over(whole)))
    )
    return compared.select(
        *unpacked(compared, "row"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("place") == 1) & (rank == F.col("best"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    marked = exact_groups(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("the_id"), F.col(text_col).alias("the_text")), "the_id", "the_text")
    return marked.where("kept").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
