"""Row filters and cohort selection by set membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_per_key

P = "unique_id"

#: A participant is told by an id, or by several columns, such as experiment and id.
Key = str | list[str]


def key_list(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def keep_phases(df: DataFrame, phases, phase: str = "phase") -> DataFrame:
    return df.where(F.col(phase).isin(*phases))


def keep_where(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals the value; a missing value drops the row."""
    return df.where(F.col(column) == F.lit(value))


def drop_where(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from the value; a missing value drops the row."""
    return df.where(F.col(column) != F.lit(value))


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def in_cohort(df: DataFrame, ids: DataFrame, key: Key = P) -> DataFrame:
    """Rows whose id occurs in another result."""
    return join_per_key(df, distinct_values(ids, *key_list(key)), key_list(key), "left_semi")


def not_in_cohort(df: DataFrame, ids: DataFrame, key: Key = P) -> DataFrame:
    """Rows whose id does not occur in another result; safe for missing ids."""
    return join_per_key(df, distinct_values(ids, *key_list(key)), key_list(key), "left_anti")


def completers(df: DataFrame, target: str, key: Key = P, phase: str = "phase") -> DataFrame:
    """All rows of the participants who have at least one row in the target phase."""
    return in_cohort(df, df.where(F.col(phase) == target), key)


def has_phase_then_keep(
    df: DataFrame, must: str, keep: list[str], key: Key = P, phase: str = "phase"
) -> DataFrame:
    """Participants who entered phase ``must``, reduced to their rows in ``keep``."""
    entered = df.where(F.col(phase) == must)
    return in_cohort(keep_phases(df, keep, phase), entered, key)


def full_length(df: DataFrame, phase: str, n: int, key: Key = P, phase_col: str = "phase") -> DataFrame:
    """Ids with exactly ``n`` trials in the phase."""
    counts = df.where(F.col(phase_col) == phase).groupBy(*key_list(key)).agg(F.count(F.lit(1)).alias("trialCount"))
    return counts.where(F.col("trialCount") == n)


def cohort_difference(a: DataFrame, b: DataFrame, key: Key = P) -> DataFrame:
    """Ids of ``a`` that are missing from ``b``."""
    ids_a, ids_b = distinct_values(a, *key_list(key)), distinct_values(b, *key_list(key))
    return ids_a.subtract(ids_b)


def ids_with_nth_value(df: DataFrame, column: str, n: int, order: str, key: Key = P) -> DataFrame:
    """Ids whose text is the n-th distinct text in order of first appearance.

    A missing text takes a place in that order but matches nobody.  A text whose order
    values are all missing was never seen in any order and takes no place; texts first seen
    together are ordered by themselves.  Only the first ``n`` texts are ever gathered.
    """
    first_seen = df.groupBy(column).agg(F.min(order).alias("_first")).where(F.col("_first").isNotNull())
    place = F.struct("_first", F.col(column).isNotNull().alias("_known"), F.col(column).alias("_text"))
    first_n = first_seen.select(place.alias("_place")).orderBy("_place").limit(n)
    nth = first_n.agg(F.when(F.count(F.lit(1)) == n, F.max("_place")).alias("_nth")).select(F.col("_nth._text").alias("_text"))
    return df.where(F.col(column) == nth.scalar()).select(*key_list(key)).distinct()


def exclude_by_nth_value(df: DataFrame, column: str, n: int, order: str, key: Key = P) -> DataFrame:
    return not_in_cohort(df, ids_with_nth_value(df, column, n, order, key), key)


def label_membership(
    df: DataFrame, cohorts: list[tuple[str, DataFrame]], out: str = "experiment", key: Key = P
) -> DataFrame:
    """Label every row with the first cohort that holds its id, else null."""
    tagged = None
    for rank, (_, ids) in enumerate(cohorts, start=1):
        part = ids.select(*key_list(key)).withColumn("_rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy(*key_list(key)).agg(F.min("_rank").alias("_rank"))
    labels = F.array(*[F.lit(label) for label, _ in cohorts])
    joined = join_per_key(df, first, key_list(key), "left")
    return joined.withColumn(out, F.try_element_at(labels, F.col("_rank"))).drop("_rank")
