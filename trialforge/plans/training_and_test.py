"""Training and test metrics of the relational-responding experiments, from trial log to report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rsem import PASSED, exact_parts, half_even_ratio, pass_label, percent
from ..operators.cohort import Key, P, keep_phases, key_list
from ..operators.metrics import grand_stats, proportion_passing
from ..operators.reshape import pivot_metrics, total_trials
from ..operators.skew import join_per_key, materialize


def base_metrics(
    trials: DataFrame, passthrough: list[str] = ["condition"], threshold: float = 0.80,
    round_duration: bool = False, target: str | None = None, key: Key = P,
) -> DataFrame:
    """One row per block with the metrics of the block and of its phase.

    A log of several experiments that share ids needs ``key`` to hold the experiment too.

    Trial rows are aggregated on the map side straight to block sums, which are written
    once; phase metrics roll those up, so the trial rows are read a single time.
    Participants with several passthrough values get one row for each, all carrying
    the metrics of the whole block.  With ``target`` only participants who reached
    that phase are kept, which their few phase rows tell.
    """
    phase_keys = [*key_list(key), "phase", "is_test"]
    block_keys = [*phase_keys, "block"]
    part = trials.groupBy(*block_keys, *passthrough).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("correct").alias("_n_correct"),
        F.sum("correct").alias("_correct"),
        F.count("criterion").alias("_n_criterion"),
        F.max("criterion").alias("_criterion"),
        F.count("duration").alias("_n_duration"),
        *[c.alias(k) for k, c in (exact_parts("duration", "_duration") if round_duration else {"_duration": F.sum("duration")}).items()],
    )
    part = materialize(part)
    # One row per passthrough combination of a block.
    w = W.partitionBy(*block_keys)
    n = F.sum("_n").over(w)

    def whole(count: str, value):
        return F.when(F.sum(count).over(w) == n, value)

    total = F.sum("_duration").over(w)
    duration = whole("_n_duration", half_even_ratio(total, F.sum("_duration_rest").over(w), n) if round_duration else total / n)
    blocks = part.select(
        *block_keys, *passthrough,
        whole("_n_criterion", F.max("_criterion").over(w)).alias("criterion"),
        whole("_n_correct", F.sum("_correct").over(w) / n).alias("blockAcc"),
        duration.alias("duration"),
        "_n", "_n_correct", "_correct",
    )
    complete = F.sum("_n") == F.sum("_n_correct")
    phases = blocks.groupBy(*phase_keys).agg(
        F.when(complete, F.sum("_correct") / F.sum("_n")).alias("accuracy"),
        pass_label(F.when(complete, F.max("blockAcc")) >= threshold).alias("pass"),
        F.sum("_n").alias("trialCount"),
    )
    if target is not None:
        reached = F.max(F.when(F.col("phase") == target, 1).otherwise(0)).over(W.partitionBy(*key_list(key)))
        phases = phases.withColumn("_reached", reached).where("_reached = 1").drop("_reached")
    return join_per_key(blocks.drop("_n", "_n_correct", "_correct"), phases, phase_keys, "inner")


def base_log(
    trials: DataFrame, phases: list[str], target: str, threshold: float = 0.80,
    round_duration: bool = False, key: Key = P,
) -> DataFrame:
    """Base metrics of the participants who reached the target phase."""
    kept = keep_phases(trials, phases)
    return base_metrics(kept, ["condition"], threshold, round_duration, target, key)


def _semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Cohort filter for frames with a handful of rows per participant."""
    return rows.join(ids.select(*key_list(key)).distinct(), key, "left_semi")


def test_cohort(
    base: DataFrame, phase: str, cohort: DataFrame | None = None, key: Key = P, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Whole-percent test accuracy per participant with mean and sd over block rows.

    The sd is that of the rounded accuracies, each counted once per block row.
    """
    rows = keep_phases(base, [phase]).withColumn("accuracy", percent("accuracy"))
    rows = rows.groupBy("condition", *key_list(key), "phase", "accuracy").agg(F.count(F.lit(1)).alias("_rows"))
    rows = _semi(rows, cohort, key) if cohort is not None else rows
    return grand_stats(rows, "accuracy", weight="_rows", by=by).drop("_rows")


def relational_test(
    base: DataFrame, phase: str, is_test: int = 1, key: Key = P, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Block accuracy of the relational test; mean and sd of accuracy and response time over block rows."""
    rows = base.where((F.col("phase") == phase) & (F.col("is_test") == is_test))
    rows = grand_stats(rows, "duration", "meanRT", "sdRT", by=by)
    columns = ["condition", *key_list(key), "phase", "is_test", "blockAcc", "pass", "meanRT", "sdRT"]
    rows = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    return grand_stats(rows, "blockAcc", "meanAcc", "sdAcc", weight="_rows", by=by).drop("_rows")


def eligible(
    base: DataFrame, relational_phase: str, test_phase: str, test_trials: int, is_test: int = 1,
    excluded: DataFrame | None = None, key: Key = P,
) -> DataFrame:
    """Ids that passed the relational test and completed the whole final test.

    ``excluded`` lists ids to leave out, such as those hit by a program error.
    """
    relational = (F.col("phase") == relational_phase) & (F.col("is_test") == is_test) & (F.col("pass") == PASSED)
    complete = (F.col("phase") == test_phase) & (F.col("trialCount") == test_trials)
    people = base.groupBy(*key_list(key)).agg(
        F.max(F.when(relational, 1)).alias("_relational"), F.max(F.when(complete, 1)).alias("_complete")
    )
    ids = people.where((F.col("_relational") == 1) & (F.col("_complete") == 1)).select(*key_list(key))
    return ids if excluded is None else ids.join(excluded.select(*key_list(key)).distinct(), key, "left_anti")


def training_long(
    base: DataFrame, phases: list[str], cohort: DataFrame, threshold: int = 17, key: Key = P,
    by: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Per participant and phase: best criterion, pass label and trials, with the phase's pass rate."""
    rows = keep_phases(base, phases).groupBy("condition", "phase", *key_list(key), "trialCount").agg(
        F.max("criterion").alias("_best"), (F.count(F.lit(1)) == F.count("criterion")).alias("_known")
    )
    rows = _semi(rows, cohort, key)
    w = W.partitionBy(*key_list(key), "phase")
    best = F.when(F.min("_known").over(w), F.max("_best").over(w))
    rows = rows.withColumn("criterion", best).withColumn("pass", pass_label(F.col("criterion") >= threshold))
    return proportion_passing(rows.drop("_best", "_known"), by)


def training_wide(
    base: DataFrame, phases: list[str], cohort: DataFrame, counted: list[str],
    threshold: int = 17, key: Key = P, by: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """One row per participant with pass, criterion and trials of every phase, and total trials."""
    long = training_long(base, phases, cohort, threshold, key, by)
    wide = pivot_metrics(long, key_list(key), "phase", ["pass", "criterion", "trialCount"], phases)
    return total_trials(wide, [f"trialCount_{p}" for p in counted])
