"""Joins and group statistics that stay balanced when one key holds much of the data.

A join of many rows per key with one row per key is left to Spark: its adaptive execution
splits the tasks of a hot key, because the other side is one row that can be read by each
part.  Keys are compared null-safely, which also puts that side behind an exchange of its
own, as splitting needs.  No job runs while such a plan is built.

Only work on the order inside groups has to know the hot groups, see :func:`hot_groups`.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By counting, fewer groups than this can be hot, so that tables of them may be broadcast.
MAX_HOT_GROUPS = 50_000

#: Session setting: rows that one task may hold of a single group.
HOT_ROWS_CONF = "spark.trialforge.hotGroupRows"
HOT_ROWS_DEFAULT = 1_000_000

CHECKPOINT_CONF = "spark.checkpoint.dir"


def hot_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def total_rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("_total")).scalar()


def hot_groups(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of the groups too large for one task; None if there are none.

    A group is hot with more rows than ``max(hot_group_rows, total / MAX_HOT_GROUPS)``, so
    there are fewer than ``MAX_HOT_GROUPS`` of them.  Only partial counts are shuffled, so
    finding a hot group is itself balanced.  Runs one job.
    """
    floor = float(hot_group_rows(df))
    count = F.count(F.lit(1)).alias("_n")
    if df.groupBy(*keys).agg(count).where(F.col("_n") > floor).isEmpty():
        return None
    limit = F.greatest(F.lit(floor), total_rows(df) / F.lit(float(MAX_HOT_GROUPS)))
    sizes = df.groupBy(*keys).agg(count).withColumn("_limit", limit)
    return materialize(sizes.where(F.col("_n") > F.col("_limit")).select(*keys))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder; on a cluster, where executors
    don't share one, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trialforge-"))
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a reduced frame once, where later steps read it several times.

    Spark removes the files with the frame when ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def null_safe_on(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def join_per_key(rows: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many ``rows`` per key with a ``right`` side that has one row per key.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; missing keys match each
    other.  Spark broadcasts the right side when it measures it small enough, and else splits
    the hot keys of the rows.
    """
    on = null_safe_on(keys, "_r_")
    return rows.join(prefixed(right, keys, "_r_"), on, how).drop(*["_r_" + k for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Add group aggregates to every row of the group.

    Same result as aggregates over ``Window.partitionBy(keys)``, but a group is
    never gathered in one task: the aggregate combines on the map side and comes
    back by :func:`join_per_key`.  Existing columns of the same name are replaced.
    """
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    kept = df.drop(*[n for n in stats if n in df.columns])
    return join_per_key(kept, table, keys, "left")


def with_rolled_stats(df: DataFrame, fine: list[str], partial: dict[str, Column], **stats: Column) -> DataFrame:
    """Add aggregates of several nested or crossing groups to every row in one join.

    ``partial`` are sums, counts and extremes by the ``fine`` keys, which hold the keys of all
    the groups.  ``stats`` roll them up by windows over those few rows, never over ``df``.
    """
    table = df.groupBy(*fine).agg(*[c.alias(n) for n, c in partial.items()]).select(*fine, *[c.alias(n) for n, c in stats.items()])
    kept = df.drop(*[n for n in stats if n in df.columns])
    return join_per_key(kept, table, fine, "left")
