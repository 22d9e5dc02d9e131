"""Projection, long-to-wide reshaping and row-wise arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rsem import numeric_columns, row_sum
from .cohort import P


def project(
    df: DataFrame, columns: list[str] | None = None, rename: dict[str, str] | None = None,
    drop: list[str] | None = None,
) -> DataFrame:
    out = df.select(*columns) if columns else df
    out = out.drop(*drop) if drop else out
    return out.withColumnsRenamed(rename) if rename else out


def fill_null(df: DataFrame, value: float = 0) -> DataFrame:
    """Replace missing numbers, NaN included, in every numeric column."""
    columns = numeric_columns(df)
    return df.fillna(value, subset=columns) if columns else df


def with_literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def _wide(df: DataFrame, ids: list[str], names: str, cells: dict[str, tuple[str, str]], levels: list[str]) -> DataFrame:
    """One column per ``output: (value, level)``; two rows for one level are an error."""
    here = {level: F.col(names) == level for level in levels}
    picked = [F.max(F.when(here[level], F.col(v))).alias(out) for out, (v, level) in cells.items()]
    most = F.array_max(F.array(*[F.count_if(here[level]) for level in levels])).alias("_most")
    unique = F.assert_true(F.col("_most") <= 1, F.lit(f"an id has several rows for one {names}"))
    return df.groupBy(*ids).agg(*picked, most).where(unique.isNull()).drop("_most")


def pivot_metrics(
    df: DataFrame, ids: list[str], names: str, values: list[str], levels: list[str]
) -> DataFrame:
    """Long to wide with columns ``value_level``, all levels of one value side by side.

    The literal level list fixes the columns and their order and saves the job that
    would look for the levels.  An id with two rows for a level is an error.
    """
    cells = {f"{v}_{level}": (v, level) for v in values for level in levels}
    return _wide(df, ids, names, cells, levels)


def pivot_single(df: DataFrame, ids: list[str], names: str, value: str, levels: list[str]) -> DataFrame:
    """Long to wide for one value, columns named by the level alone."""
    return _wide(df, ids, names, {level: (value, level) for level in levels}, levels)


def total_trials(df: DataFrame, columns: list[str], out: str = "totalTrials") -> DataFrame:
    """Row-wise sum; missing if any part is missing."""
    return df.withColumn(out, row_sum(columns))


def difference(df: DataFrame, a: str, b: str, out: str = "difference") -> DataFrame:
    return df.withColumn(out, F.col(a) - F.col(b))


def paired_difference(
    df: DataFrame, a: str, b: str, value: str = "accuracy", names: str = "phase", key: str = P
) -> DataFrame:
    """Per participant the value in two phases and their difference."""
    rows = df.where(F.col(names).isin(a, b)).select(key, names, value).distinct()
    return difference(pivot_single(rows, [key], names, value, [a, b]), a, b)


def bias_index(df: DataFrame, phase: str, out: str = "bubbleReductionBias") -> DataFrame:
    """Point gaps minus bubble gaps of the test phase."""
    return difference(df, f"countPointGap_{phase}", f"countBubbleGap_{phase}", out)
