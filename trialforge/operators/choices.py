"""Decoding of the options participants chose, and choice frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.rsem import half_even, percent, row_sum, share
from .cohort import Key, P, key_list
from .metrics import choice_stats
from .reshape import fill_null


def cast_many(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def picked(key: str, options: dict[str, str]) -> Column:
    """Value of the column that the key names; null for an unknown key."""
    branches = [F.when(F.col(key) == name, F.col(source)) for name, source in options.items()]
    return F.coalesce(*branches)


def pick_by_key(df: DataFrame, key: str, options: dict[str, str], out: str) -> DataFrame:
    return df.withColumn(out, picked(key, options))


def _lookup(entries: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in entries.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def decode_task(df: DataFrame, column: str, dictionary: dict[str, str], out: str | None = None) -> DataFrame:
    """Task code -> task name; null for an unknown code."""
    return df.withColumn(out or column, _lookup(dictionary, F.col(column)))


def decode_task_by_experiment(
    df: DataFrame, column: str, dictionaries: dict[object, dict[str, str]],
    default: dict[str, str], experiment: str, out: str | None = None,
) -> DataFrame:
    """As :func:`decode_task`, with a dictionary of its own for some experiments."""
    value = _lookup(default, F.col(column))
    for which, entries in dictionaries.items():
        value = F.when(F.col(experiment) == which, _lookup(entries, F.col(column))).otherwise(value)
    return df.withColumn(out or column, value)


def pick_optimal_task(
    df: DataFrame, dictionary: dict[str, str] = codes.TASK_CODES_LARGE_POINTS,
    key: str = "correct_response", out: str = "optimalTask",
) -> DataFrame:
    """Name of the optimal option; null unless it is one of the optimal tasks."""
    entries = {code: task for code, task in dictionary.items() if task in codes.OPTIMAL_TASKS}
    return df.withColumn(out, _lookup(entries, picked(key, codes.OPTION_COLUMNS)))


def pick_optimal_cue(
    df: DataFrame, cues: dict[str, str] = codes.CUE_COLUMNS,
    key: str = "correct_response", out: str = "optimalCue",
) -> DataFrame:
    return pick_by_key(df, key, cues, out)


def ordinal(df: DataFrame, column: str, levels: list[str], out: str) -> DataFrame:
    """Position of the value in the level list, from 1; null for an unlisted value."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return df.withColumn(out, F.nullif(position, F.lit(0)).cast("int"))


def decode_choices(
    df: DataFrame, dictionary: dict[str, str] = codes.TASK_CODES_LARGE_POINTS,
    cues: dict[str, str] = codes.CUE_COLUMNS,
) -> DataFrame:
    """Chosen cue and task, optimal cue and task of every trial, all in one projection."""
    chosen = _lookup(dictionary, picked("response", codes.OPTION_COLUMNS))
    out = df.withColumns({"choiceCue": picked("response", cues), "chosenTask": chosen})
    out = pick_optimal_task(out, dictionary)
    return pick_optimal_cue(out, cues)


def _task_counts(tasks: list[str]) -> list[Column]:
    return [F.count_if(F.col("chosenTask") == t).alias(t) for t in tasks]


def choice_matrix_training(
    df: DataFrame, phase: str, tasks: list[str] = codes.ENTAILED_TASKS, key: Key = P
) -> DataFrame:
    """One row per participant: whole percentage of training trials on each task.

    Counts, trial total and participant metrics come from a single aggregate that
    combines on the map side, so no trial row is shuffled.
    """
    rows = df.where(F.col("phase") == phase)
    stats = [c.alias(n) for n, c in choice_stats().items()]
    wide = rows.groupBy(*key_list(key)).agg(*_task_counts(tasks), F.count(F.lit(1)).alias("_n"), *stats)
    shares = [percent(share(t, "_n")).alias(t) for t in tasks]
    return fill_null(wide.select(*key_list(key), *shares, *choice_stats()), 0)


def choice_matrix_test(
    df: DataFrame, phase: str, tasks: list[str] = codes.TASK_LEVELS, key: Key = P
) -> DataFrame:
    """One row per participant: number of test trials on each task."""
    rows = df.where(F.col("phase") == phase)
    stats = [c.alias(n) for n, c in choice_stats().items()]
    wide = rows.groupBy(*key_list(key)).agg(*_task_counts(tasks), *stats)
    return fill_null(wide.select(*key_list(key), *tasks, *choice_stats()), 0)


def derived_shares(df: DataFrame, denom: int = 60, key: Key = P) -> DataFrame:
    """Whole percentage of test trials spent on nine sets of tasks.

    Every share is taken from the counts, also the one that keeps the name of its
    single task.
    """
    shares = [
        half_even(row_sum(tasks) / F.lit(denom) * 100).alias(name)
        for name, tasks in codes.SHARE_TASKS.items()
    ]
    return df.select(*key_list(key), *shares, *choice_stats())


def cue_meaning(
    df: DataFrame, symbol: str = "symbol", condition: str = "condition", out: str = "meaning"
) -> DataFrame:
    """Function of a symbol under its counterbalancing condition (eight literal rows)."""
    rows = ", ".join(f"('{c}', '{s}', '{m}')" for c, s, m in codes.CUE_MEANINGS)
    dim = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(_condition, _symbol, {out})")
    on = (F.col(condition) == F.col("_condition")) & (F.col(symbol) == F.col("_symbol"))
    return df.join(F.broadcast(dim), on, "left").drop("_condition", "_symbol")
