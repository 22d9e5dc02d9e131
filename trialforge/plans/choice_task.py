"""Overview, choice shares and figure data of the choice-task experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rsem import exact_parts, half_even_ratio, percent
from ..operators.choices import choice_matrix_test, derived_shares
from ..operators.cohort import Key, P, key_list
from ..operators.metrics import pass_by_phase, suboptimal
from ..operators.report import bind_participants, study_frame
from ..operators.reshape import bias_index, pivot_metrics, with_literal
from ..operators.skew import materialize, with_group_stats
from ..operators.stats import half_width

METRICS = [
    "accuracy", "trialCount", "pass", "maxCriterion", "countPointGap", "countBubbleGap", "meanLosses",
]


def usable(trials: DataFrame, phases: list[str], bad_id=None, key: Key = P) -> DataFrame:
    """Trials of the phases without excluded data and, optionally, without one broken record."""
    rows = trials.where(F.col("phase").isin(*phases) & (F.col("exclude_data") != "yes"))
    return rows if bad_id is None else rows.where(F.col(key_list(key)[-1]) != bad_id)


def phase_overview(
    trials: DataFrame, training: str, test: str, passthrough: list[str],
    min_criterion: int = 17, min_accuracy: float = 80, test_trials: int = 60, key: Key = P,
) -> DataFrame:
    """One row per participant, phase and passthrough combination with the phase metrics.

    Trials are reduced on the map side to a few rows per participant; those are
    laid out by participant once, and every later step keeps to that layout.
    """
    keys = [*key_list(key), "phase", "is_test"]
    part = trials.groupBy(*keys, *passthrough).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("accurate").alias("_n_accurate"),
        F.sum("accurate").alias("_accurate"),
        F.count("criterion").alias("_n_criterion"),
        F.max("criterion").alias("_criterion"),
        F.count("pointLoss").alias("_n_loss"),
        *[c.alias(k) for k, c in exact_parts("pointLoss", "_loss").items()],
        suboptimal("pointGap", 1).alias("_point_gap"),
        suboptimal("bubbleGap", 1).alias("_bubble_gap"),
    )
    part = part.repartition(*key_list(key))
    w = W.partitionBy(*keys)
    n = F.sum("_n").over(w)

    def whole(count: str, value):
        return F.when(F.sum(count).over(w) == n, value)

    metrics = part.select(
        *keys, *passthrough,
        percent(whole("_n_accurate", F.sum("_accurate").over(w) / n)).alias("accuracy"),
        n.alias("trialCount"),
        whole("_n_criterion", F.max("_criterion").over(w)).alias("maxCriterion"),
        (F.sum("_point_gap").over(w) / test_trials).alias("countPointGap"),
        (F.sum("_bubble_gap").over(w) / test_trials).alias("countBubbleGap"),
        whole("_n_loss", half_even_ratio(F.sum("_loss").over(w), F.sum("_loss_rest").over(w), n)).alias("meanLosses"),
    )
    label = pass_by_phase(
        F.col("phase"), F.col("maxCriterion"), F.col("accuracy"), training, test, min_criterion, min_accuracy
    )
    return metrics.withColumn("pass", label)


def overview(
    trials: DataFrame, phases: list[str], training: str, test: str, target: str,
    bad_id=None, experiment: str = "experiment", test_trials: int = 60,
    min_criterion: int = 17, min_accuracy: float = 80, key: Key = P,
) -> DataFrame:
    """One row per participant who reached ``target``, with the metrics of training and test.

    The number of test trials is the protocol's constant, and the interval half width
    is that of the experiment.  A log of several experiments that share ids needs ``key`` to
    hold the experiment, the id last.  The participant rows are written once, because the
    interval and most later analyses read them again.
    """
    passthrough = [c for c in (experiment, "age", "gender") if c not in key_list(key)]
    rows = phase_overview(
        usable(trials, phases, bad_id, key), training, test, passthrough,
        min_criterion, min_accuracy, test_trials, key,
    )
    # A few rows per participant, already laid out by participant.
    reached = F.max(F.when(F.col("phase") == target, 1).otherwise(0)).over(W.partitionBy(*key_list(key)))
    rows = rows.withColumn("_reached", reached)
    rows = rows.where((F.col("_reached") == 1) & F.col("phase").isin(training, test))
    ids = [*key_list(key), *passthrough]
    rows = rows.select(*ids, "phase", *METRICS).distinct()
    wide = pivot_metrics(rows, ids, "phase", METRICS, [training, test])
    wide = materialize(with_literal(wide, f"trialCount_{test}", test_trials))
    wide = with_group_stats(wide, [experiment], CI90=half_width(f"accuracy_{test}"))
    return bias_index(wide, test)


def test_choices(
    decoded: DataFrame, over: DataFrame, training: str, test: str, test_trials: int = 60, key: Key = P
) -> DataFrame:
    """Shares of the test choices with the training result beside them."""
    shares = derived_shares(choice_matrix_test(decoded, test, key=key), test_trials, key)
    trained = over.select(
        *key_list(key),
        F.col(f"accuracy_{training}").alias("trainingAccuracy"),
        F.col(f"pass_{training}").alias("trainingPassed"),
    )
    return bind_participants([shares, trained], key)


def figure_rows(choices: DataFrame, by: str) -> DataFrame:
    """Accuracy and alternative accuracy with mean and interval of their experiment."""
    return study_frame(
        materialize(choices), by, {"accuracy": ("CI90", "mAcc"), "entDevOptimal": ("altCI90", "altmAcc")}
    )
