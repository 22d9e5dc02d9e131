"""Bounded samples of labelled texts, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], id_col: str, text_col: str, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled rows (id, text, label) for a fit, chosen by a hash of the id."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & train(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Broadcast: fit_rows bounds it.  Rows that repeat an id count once.
    return checkpointed(texts.join(F.broadcast(chosen), F.col("of") == F.col("id")).dropDuplicates(["id"]).select("id", "text", "label"))
