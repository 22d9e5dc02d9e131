"""Participant reports, stacked studies, sorted output and figure tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rsem import ascending, col, descending, half_even, strict_mean, strict_sd
from .cohort import Key, P, key_list
from .ranks import value_counts, walked_bins
from .skew import materialize, with_group_stats
from .stats import Z_FIGURE, mean_sd, reaching

BIN_SLACK = 1e-8  # a value beyond a bin by less than this still belongs to it

# --- joins ------------------------------------------------------------------


def once(df: DataFrame, key: Key = P) -> DataFrame:
    """``df`` by key, with one row for each; a key that occurs twice is an error."""
    keys = key_list(key)
    rest = [c for c in df.columns if c not in keys]
    message = F.concat(F.lit("several rows for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("_row"))
    unique = F.when(F.col("_times") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return counted.select(*keys, unique.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def bind_participants(frames: list[DataFrame], key: Key = P) -> DataFrame:
    """Side by side on the participant, who must occur once in each frame; else it is an error.

    Scripts bind such frames by row position; joining on the id gives the same rows
    when all frames hold the same ids in the same order, and right ones otherwise.
    """
    return reduce(lambda a, b: a.join(b, key), [once(f, key) for f in frames])


def lookup_or_null(
    df: DataFrame, right: DataFrame, column: str, out: str | None = None, key: Key = P
) -> DataFrame:
    """The other frame's value for the id, null where the id is absent.

    An id that the other frame holds twice is an error.  Looked up by key, not by position.
    """
    found = right.select(*key_list(key), F.col(column).alias(out or column))
    return df.join(once(found, key), key, "left")


def participant_summary(
    training: DataFrame, test: DataFrame, relational: DataFrame, generalisation: DataFrame,
    reports: DataFrame, text_columns: list[str], generalisation_is_percent: bool = True, key: str = P,
) -> DataFrame:
    """Final report, one row per participant, best test accuracy first.

    ``training`` holds ``criterion`` (of 20), ``test`` holds ``accuracy`` in percent,
    ``relational`` ``blockAcc`` as a proportion, ``generalisation`` ``accuracy``.
    """
    base = bind_participants(
        [training.select(key, "criterion"), test.select(key, "accuracy"), reports.select(key, *text_columns)], key
    )
    base = lookup_or_null(base, relational, "blockAcc", key=key)
    base = lookup_or_null(base, generalisation, "accuracy", "_gen", key)
    gen = F.col("_gen") if generalisation_is_percent else half_even(F.col("_gen") * 100)
    out = base.select(
        F.col(key).alias("participantCode"),
        half_even(F.col("blockAcc") * 100).alias("CrelTestAccuracy"),
        half_even(F.col("criterion") * 100 / 20).alias("CfuncTrainAccuracy"),
        F.col("accuracy").alias("CfuncTestAccuracy"),
        *text_columns,
        gen.alias("GenTestAcc"),
    )
    return order_desc(out, ["CfuncTestAccuracy", "CrelTestAccuracy"])


# --- set operations and order -----------------------------------------------


def stack_studies(studies: dict[str, DataFrame], columns: list[str], label: str = "study") -> DataFrame:
    parts = [df.select(*columns).withColumn(label, F.lit(name)) for name, df in studies.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack(frames: list[DataFrame], columns: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b), [df.select(*columns) for df in frames])
    return out.withColumnsRenamed(rename) if rename else out


def appendix(frames: list[DataFrame], columns: list[str], order: list[str], key: str = P) -> DataFrame:
    """Distinct free-text answers of several experiments in report order."""
    return order_asc(stack(frames, [key, *columns]).distinct(), order)


def pooled_stats(frames: list[DataFrame], column: str) -> DataFrame:
    return mean_sd(stack(frames, [column]), column)


def order_desc(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(*descending(*columns))


def order_asc(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(*ascending(*columns))


# --- tables -----------------------------------------------------------------


def experiment_table(
    overview: DataFrame, training: DataFrame, test: DataFrame, training_phase: str, test_phase: str,
    by: str = "experiment", num: int = 50, den: int = 60, key: str = P,
) -> DataFrame:
    """Nine statistics per experiment from the overview and the two choice frames.

    Each frame gives its own aggregate, as in separate summaries: an id missing
    from one frame does not change the statistics of another.
    """
    a = overview.groupBy(by).agg(
        strict_mean(f"accuracy_{training_phase}").alias("trainAccuracy"),
        strict_mean(f"trialCount_{training_phase}").alias("trainTrials"),
        F.count_if(F.col(f"pass_{training_phase}") == "passed").alias("nPassed"),
        strict_mean(f"accuracy_{test_phase}").alias("testAccuracy"),
        reaching(f"accuracy_{test_phase}", num, den).alias("nTestCriterion"),
    )
    b = training.groupBy(by).agg(strict_mean("clickSuccess").alias("trainClickSuccess"))
    c = test.groupBy(by).agg(
        strict_mean("clickSuccess").alias("testClickSuccess"),
        strict_mean("entDevOptimal").alias("optimalPath"),
        reaching("entDevOptimal", num, den).alias("nOptimalPathCriterion"),
    )
    return a.join(b, by, "full").join(c, by, "full")


def band_frame(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """Mean with a band of one standard deviation on both sides."""
    m = mean_sd(df, column, by)
    return m.withColumns({"ymin": col("mean") - col("sd"), "ymax": col("mean") + col("sd")})


def study_frame(df: DataFrame, by: str, metrics: dict[str, tuple[str, str]], z: float = Z_FIGURE) -> DataFrame:
    """Mean and half width of the interval of each metric beside every row of its study.

    ``metrics`` maps a column to the names of its half width and its mean.
    """
    stats = {}
    for column, (width, mean) in metrics.items():
        stats[width] = strict_sd(column) / F.sqrt(F.count(F.lit(1))) * z
        stats[mean] = strict_mean(column)
    return with_group_stats(df, [by], **stats)


def dot_bins(df: DataFrame, column: str, by: list[str], width: float = 1.0) -> DataFrame:
    """Dot-density bins: walking up the values, one beyond bin start + width opens a bin.

    A value exactly at start + width, or beyond by less than 1e-8, still belongs to the bin, and the centre of a
    bin is the middle of its smallest and largest member.  Missing and infinite values have no
    dots.  Equal values are counted first; see :func:`~.ranks.walked_bins` for groups of any size.
    """
    bins = walked_bins(materialize(value_counts(df, column, by)), by, width + BIN_SLACK)
    return bins.select(*by, ((F.col("first") + F.col("last")) / 2).alias("bin_centre"), F.col("dots").cast("long").alias("dots"))


def trajectories(
    df: DataFrame, column: str, study: str = "study", min_points: int = 2, key: str = P
) -> DataFrame:
    """Points of each participant across studies in study order, where there are several.

    A participant has one value per study, which is checked, so a line has at most as
    many points as there are studies.
    """
    points = df.groupBy(key, study).agg(F.min(column).alias("_low"), F.max(column).alias(column))
    single = F.assert_true(F.col("_low").eqNullSafe(F.col(column)), F.lit("a participant has several values in one study"))
    points = points.where(single.isNull())
    lines = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(study, column))).alias("points"))
    return lines.where(F.size("points") >= min_points)
