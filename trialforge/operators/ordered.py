"""Numbering and trailing sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.logs import with_row_index
from .skew import hot_group_rows, hot_groups, null_safe_on, prefixed


def number_and_roll(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    number: str = "trial_n",
    roll: tuple[str, int, str] | None = None,
) -> DataFrame:
    """Number rows 1..n inside each group and, optionally, add a trailing sum.

    ``roll`` is ``(column, length, output)``: the sum of the column over the last
    ``length`` rows, the current one included.  Order columns may be of any type that sorts;
    nulls come first.  ``order`` must order the rows of a group completely.

    Ordinary groups take one shuffle and one window.  The rows of hot groups are sorted over
    all tasks by key and order, which cuts bursts and ties like any other rows; a row's number
    is its place less that of the first row of its group.  For the sum they are cut into runs
    of consecutive numbers, each run carrying the last rows of the run before it.
    """
    hot = hot_groups(df, keys)
    if hot is None:
        return _number_whole(df, keys, order, number, roll)
    hot = F.broadcast(prefixed(hot, keys, "_g_"))
    is_hot = null_safe_on(keys, "_g_")
    cold = _number_whole(df.join(hot, is_hot, "left_anti"), keys, order, number, roll)

    big = with_row_index(df.join(hot, is_hot, "left_semi"), [F.col(c).asc_nulls_first() for c in [*keys, *order]], "_index")
    # One row per hot group: fewer than MAX_HOT_GROUPS.
    starts = prefixed(big.groupBy(*keys).agg(F.min("_index").alias("_start")), keys, "_o_")
    big = big.join(F.broadcast(starts), null_safe_on(keys, "_o_")).withColumn(number, F.col("_index") - F.col("_start") + 1)
    big = big.select(*df.columns, number)
    if roll:
        big = _roll_runs(big, keys, number, roll)
    return cold.unionByName(big)


def _number_whole(
    df: DataFrame, keys: list[str], order: list[str], number: str, roll: tuple[str, int, str] | None
) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(number, F.row_number().over(w).cast("long"))
    if roll:
        value, length, name = roll
        out = out.withColumn(name, F.sum(value).over(w.rowsBetween(-(length - 1), 0)))
    return out


def _roll_runs(df: DataFrame, keys: list[str], number: str, roll: tuple[str, int, str]) -> DataFrame:
    value, length, out = roll
    run_rows = max(hot_group_rows(df), length)
    run = F.floor((F.col(number) - 1) / F.lit(run_rows)).cast("long")
    feeds_next = F.pmod(F.col(number) - 1, F.lit(run_rows)) >= run_rows - (length - 1)
    own = df.withColumn("_own", run)
    spread = own.withColumn(
        "_run",
        F.explode(F.when(feeds_next, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))),
    )
    w = W.partitionBy(*keys, "_run").orderBy(number).rowsBetween(-(length - 1), 0)
    rolled = spread.withColumn(out, F.sum(value).over(w))
    return rolled.where(F.col("_own") == F.col("_run")).drop("_own", "_run")
