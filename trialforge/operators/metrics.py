"""Block, phase and participant metrics of a trial log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rsem import (
    FAILED,
    PASSED,
    exact_parts,
    half_even,
    half_even_mean,
    half_even_ratio,
    if_else,
    is_in,
    pass_label,
    percent,
    share,
    strict_max,
    strict_mean,
    succeeded,
)
from .cohort import Key, P, has_phase_then_keep, key_list
from .ordered import number_and_roll
from .skew import join_per_key, with_group_stats, with_rolled_stats

BLOCK_KEYS = [P, "phase", "is_test", "block"]
PHASE_KEYS = [P, "phase", "is_test"]


# --- labels and flags -------------------------------------------------------


def label_pass(df: DataFrame, cond: Column, out: str = "pass") -> DataFrame:
    return df.withColumn(out, pass_label(cond))


def pass_by_phase(
    phase: Column, criterion: Column, accuracy: Column, training: str, test: str,
    min_criterion: int = 17, min_accuracy: float = 80,
) -> Column:
    """Training passes on the best criterion, the test on rounded accuracy, all else fails.

    The accuracy is looked at only where the training rule did not pass, and a
    missing value that decides the outcome leaves the label missing.
    """
    test_rule = if_else(is_in(phase, [test]) & (accuracy >= min_accuracy), F.lit(PASSED), F.lit(FAILED))
    return if_else(is_in(phase, [training]) & (criterion >= min_criterion), F.lit(PASSED), test_rule)


def label_pass_by_phase(
    df: DataFrame, training: str, test: str, min_criterion: int = 17, min_accuracy: float = 80,
    criterion: str = "maxCriterion", accuracy: str = "accuracy", out: str = "pass",
) -> DataFrame:
    label = pass_by_phase(
        F.col("phase"), F.col(criterion), F.col(accuracy), training, test, min_criterion, min_accuracy
    )
    return df.withColumn(out, label)


def flag_hit(df: DataFrame, column: str, threshold: float, out: str = "hit") -> DataFrame:
    return df.withColumn(out, if_else(F.col(column) >= threshold, F.lit(1), F.lit(0)))


def to_percent(df: DataFrame, column: str, out_of: float = 1, out: str | None = None) -> DataFrame:
    """``round(x * 100 / out_of)``, halves to even."""
    value = percent(column) if out_of == 1 else half_even(F.col(column) * 100 / out_of)
    return df.withColumn(out or column, value)


# --- metrics beside every row -----------------------------------------------


def block_metrics(
    df: DataFrame, keys: list[str] = BLOCK_KEYS, hit: str = "correct",
    as_percent: bool = False, round_duration: bool = False,
) -> DataFrame:
    """Per block: best criterion, mean duration and accuracy."""
    accuracy = strict_mean(hit)
    return with_group_stats(
        df, keys,
        criterion=strict_max("criterion"),
        duration=half_even_mean("duration") if round_duration else strict_mean("duration"),
        blockAcc=percent(accuracy) if as_percent else accuracy,
    )


def phase_metrics(
    df: DataFrame, keys: list[str] = PHASE_KEYS, hit: str = "correct",
    threshold: float = 0.80, as_percent: bool = False,
) -> DataFrame:
    """Per phase, after :func:`block_metrics`: accuracy, pass label, trials and best criterion."""
    accuracy = strict_mean(hit)
    return with_group_stats(
        df, keys,
        accuracy=percent(accuracy) if as_percent else accuracy,
        **{"pass": pass_label(strict_max("blockAcc") >= threshold)},
        trialCount=F.count(F.lit(1)),
        maxCriterion=strict_max("criterion"),
    )


def block_and_phase_metrics(
    df: DataFrame, keys: list[str] = BLOCK_KEYS, phase_keys: list[str] = PHASE_KEYS, hit: str = "correct",
    threshold: float = 0.80, as_percent: bool = False, round_duration: bool = False,
) -> DataFrame:
    """:func:`block_metrics`, then :func:`phase_metrics`, from one aggregate by block and one join."""
    partial = {
        "_n": F.count(F.lit(1)), "_known": F.count(hit), "_hits": F.sum(hit),
        "_criteria": F.count("criterion"), "_best": F.max("criterion"),
        "_timed": F.count("duration"), **(exact_parts("duration", "_time") if round_duration else {"_time": F.sum("duration")}),
    }
    n, phase = F.col("_n"), W.partitionBy(*phase_keys)

    def whole(known: Column, of: Column, value: Column) -> Column:
        return F.when(known == of, value)

    block_accuracy = whole(F.col("_known"), n, F.col("_hits") / n)
    block_accuracy = percent(block_accuracy) if as_percent else block_accuracy
    duration = whole(F.col("_timed"), n, half_even_ratio(F.col("_time"), F.col("_time_rest"), n) if round_duration else F.col("_time") / n)
    trials = F.sum("_n").over(phase)
    accuracy = whole(F.sum("_known").over(phase), trials, F.sum("_hits").over(phase) / trials)
    all_blocks = F.count(block_accuracy).over(phase) == F.count(F.lit(1)).over(phase)
    return with_rolled_stats(
        df, keys, partial,
        criterion=whole(F.col("_criteria"), n, F.col("_best")),
        duration=duration,
        blockAcc=block_accuracy,
        accuracy=percent(accuracy) if as_percent else accuracy,
        **{"pass": pass_label(F.when(all_blocks, F.max(block_accuracy).over(phase)) >= threshold)},
        trialCount=trials,
        maxCriterion=whole(F.sum("_criteria").over(phase), trials, F.max("_best").over(phase)),
    )


def suboptimal(gap: str, denom: int = 60) -> Column:
    """Share of trials with a gap among choices marked as not optimal."""
    return F.count_if((F.col(gap) != 0) & (F.col("optimal_choice") == "0")) / F.lit(float(denom))


def suboptimal_rate(df: DataFrame, keys: list[str] = PHASE_KEYS, denom: int = 60) -> DataFrame:
    return with_group_stats(
        df, keys,
        countPointGap=suboptimal("pointGap", denom), countBubbleGap=suboptimal("bubbleGap", denom),
    )


def mean_losses(df: DataFrame, keys: list[str] = PHASE_KEYS) -> DataFrame:
    return with_group_stats(df, keys, meanLosses=half_even_mean("pointLoss"))


def grand_stats(
    df: DataFrame, column: str, mean: str = "mAcc", sd: str = "sd_band", weight: str | None = None,
    by: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Mean and sample sd of the whole column, or of each group in ``by``, beside every row.

    ``weight`` names a count column when each row stands for that many trial rows:
    the statistics are then those of the uncollapsed rows.

    One aggregate keeps count, mean and squared deviations by weight, which Spark merges as such; the few
    rows for each distinct weight are then merged in the same way.  So nothing is centred in a second pass,
    and a large mean costs no digits.
    """
    x, keys = F.col(column), list(by)
    parts = df.groupBy(*keys, (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(x).alias("_n"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_var")
    )
    # One row for each distinct weight.
    part = F.struct((F.col("_n") * F.col("_w")).alias("n"), F.col("_mean").alias("mean"), (F.col("_n") * F.col("_w") * F.col("_var")).alias("squares"))
    table = parts.groupBy(*keys).agg(
        (F.sum("_rows") == F.sum("_n")).alias("_complete"),
        F.aggregate(F.array_sort(F.collect_list(F.when(F.col("_n") * F.col("_w") > 0, part))), _no_moments(), _merged_moments).alias("_s"),
    )
    moments = F.struct(
        F.when(F.col("_complete"), F.col("_s.mean")).alias("mean"),
        F.when(F.col("_complete") & (F.col("_s.n") > 1), F.sqrt(F.col("_s.squares") / F.nullif(F.col("_s.n") - 1, F.lit(0.0)))).alias("sd"),
    ).alias("_moments")
    kept = df.drop(*[c for c in (mean, sd) if c in df.columns])
    if keys:
        joined = join_per_key(kept, table.select(*keys, moments), keys, "left")
    else:
        joined = kept.withColumn("_moments", table.select(moments).scalar())
    return joined.select(*kept.columns, F.col("_moments.mean").alias(mean), F.col("_moments.sd").alias(sd))


def _no_moments() -> Column:
    return F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("squares"))


def _merged_moments(a: Column, b: Column) -> Column:
    """Count, mean and sum of squared deviations of two sets of rows together."""
    n, delta = a["n"] + b["n"], b["mean"] - F.coalesce(a["mean"], b["mean"])
    return F.struct(
        n.alias("n"), (F.coalesce(a["mean"], b["mean"]) + delta * b["n"] / n).alias("mean"),
        (a["squares"] + b["squares"] + delta * delta * a["n"] * b["n"] / n).alias("squares"),
    )


def phase_trial_count(df: DataFrame, key: Key = P) -> DataFrame:
    return with_group_stats(df, [*key_list(key), "phase"], trialCount=F.count(F.lit(1)))


def _collapse_weighted(df: DataFrame, keys: list[str], passthrough: list[str], value: str) -> DataFrame:
    """Mean of ``value`` per key on one row per key and passthrough combination, with ``_n`` trials."""
    part = df.groupBy(*keys, *passthrough).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"), F.sum(value).alias("_sum")
    )
    # One row per combination of the passthrough columns, never trial rows.
    w = W.partitionBy(*keys)
    n, known, total = F.sum("_n").over(w), F.sum("_known").over(w), F.sum("_sum").over(w)
    return part.withColumn("_mean", F.when(n == known, total / n)).select(*keys, *passthrough, "_n", "_mean")


def phase_accuracy(
    df: DataFrame, phase: str, as_percent: bool = False, key: Key = P, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Accuracy of each participant in one phase and its sd over trial rows.

    The sd is that of the whole frame, or of each group in ``by``, which ``key`` must hold.
    """
    keys = key_list(key)
    rows = _collapse_weighted(df.where(F.col("phase") == phase), [*keys, "phase"], ["condition"], "correct")
    rows = rows.withColumn("accuracy", percent("_mean") if as_percent else F.col("_mean"))
    out = grand_stats(rows, "accuracy", "mean", "sd", weight="_n", by=by)
    return out.select("condition", *keys, "phase", "accuracy", "sd")


def composite_accuracy(
    df: DataFrame, must: str, phases: list[str], key: Key = P, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Rounded accuracy over several phases together, with trial-weighted mean and sd.

    Mean and sd are those of the whole frame, or of each group in ``by``, which ``key`` must hold.
    """
    kept = has_phase_then_keep(df, must, phases, key).withColumn("_points", F.col("correct") * 100)
    rows = _collapse_weighted(kept, key_list(key), ["condition"], "_points")
    rows = rows.withColumn("compositeAccuracy", half_even("_mean"))
    out = grand_stats(rows, "compositeAccuracy", "mean", "sd", weight="_n", by=by)
    return out.select("condition", *key_list(key), "compositeAccuracy", "mean", "sd")


def phase_best_criterion(df: DataFrame, threshold: int = 17, key: Key = P) -> DataFrame:
    best = with_group_stats(df, [*key_list(key), "phase"], criterion=strict_max("criterion"))
    return best.withColumn("pass", pass_label(F.col("criterion") >= threshold))


def proportion_passing(df: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Per phase, and per group in ``by``: whole percentage of rows labelled as passed."""
    passed = strict_mean(if_else(F.col("pass") == PASSED, F.lit(1), F.lit(0)))
    return with_group_stats(df, [*by, "phase"], proportionPassing=percent(passed))


def choice_stats() -> dict[str, Column]:
    return {
        "optimalChoice": percent(strict_mean("correct")),
        "clickSuccess": percent(share(F.count_if(succeeded("remaining")), F.count(F.lit(1)))),
        "accuracy": percent(strict_mean("accurate")),
    }


def participant_choice_metrics(df: DataFrame, key: Key = P) -> DataFrame:
    """Per participant: optimal choices, finished tasks and both together, in percent."""
    return with_group_stats(df, key_list(key), **choice_stats())


def choice_count(df: DataFrame, key: Key = P) -> DataFrame:
    return with_group_stats(df, [*key_list(key), "chosenTask"], proportionChoice=F.count(F.lit(1)))


def choice_share_by_phase(df: DataFrame, key: Key = P) -> DataFrame:
    """:func:`phase_trial_count`, then :func:`choice_share`, from one aggregate and one join."""
    keys = key_list(key)
    trials = F.sum("_n").over(W.partitionBy(*keys, "phase"))
    chosen = F.sum("_n").over(W.partitionBy(*keys, "chosenTask"))
    return with_rolled_stats(
        df, [*keys, "phase", "chosenTask"], {"_n": F.count(F.lit(1))}, trialCount=trials, proportionChoice=percent(chosen / trials)
    )


def choice_share(df: DataFrame, key: Key = P) -> DataFrame:
    """Needs ``trialCount`` from :func:`phase_trial_count`."""
    counted = choice_count(df, key)
    return counted.withColumn("proportionChoice", percent(share("proportionChoice", "trialCount")))


# --- collapsed frames -------------------------------------------------------


def collapse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows over the metric columns."""
    return df.select(*columns).distinct()


def verbal_reports(
    df: DataFrame, columns: list[str], required: list[str] | None = None, key: Key = P
) -> DataFrame:
    """Distinct free-text answers of each participant."""
    out = df.select(*key_list(key), *columns).distinct()
    return out.dropna(subset=required) if required else out


# --- derivations from the raw log -------------------------------------------


def rolling_criterion(
    df: DataFrame, n: int = 20, keys: tuple[str, ...] = (P, "phase", "block"),
    order: tuple[str, ...] = ("trial_n",), out: str = "criterion",
) -> DataFrame:
    """Correct responses among the last ``n`` trials of the block."""
    base = df.drop(out)
    return number_and_roll(base, list(keys), list(order), "_n", ("correct", n, out)).drop("_n")


def criterion_trial(
    df: DataFrame, k: int = 17, keys: tuple[str, ...] = (P, "phase", "block"), out: str = "criterion_trial"
) -> DataFrame:
    """First trial at which the rolling criterion reaches ``k``; null if it never does."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col("criterion") >= k, F.col("trial_n"))).alias(out))


def mark_accurate(df: DataFrame, out: str = "accurate") -> DataFrame:
    """1 where the optimal option was chosen and the task was finished."""
    return df.withColumn(out, if_else((F.col("correct") == 1) & (F.col("remaining") == 0), F.lit(1), F.lit(0)))


def set_point(df: DataFrame, passed: Column, bubbles: str = "n_bubbles", key: Key = P) -> DataFrame:
    """Bubble count of the hardest calibration level that was passed."""
    return df.groupBy(*key_list(key)).agg(F.max(F.when(passed, F.col(bubbles))).alias("set_point"))
