"""Queries for group metrics, collapsed frames and derivations from the raw log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, protocol
from ..plans import training_and_test
from ..sources.event_trials import CRITERION, PHASES, TEST, TRAINING, event_trials, ordered_event_trials
from .registry import query, rounded

_KEYS = ["event_id", "unique_id", "phase"]


@query(
    "D1_block_metrics",
    """
    SELECT event_id, unique_id, phase, block,
      MAX(criterion) OVER w AS criterion, ROUND(AVG(duration) OVER w, 6) AS duration,
      ROUND(AVG(correct) OVER w, 6) AS blockAcc
    FROM trials WINDOW w AS (PARTITION BY unique_id, phase, is_test, block)
    """,
)
def d1(spark, d):
    df = metrics.block_metrics(ordered_event_trials(spark, d))
    return rounded(df.select(*_KEYS, "block", "criterion", "duration", "blockAcc"), "duration", "blockAcc")


@query(
    "D1_block_metrics_percent",
    """
    SELECT event_id, unique_id, phase, block, MAX(criterion) OVER w AS criterion,
      round_even(SUM(CAST(duration AS DECIMAL(28, 9))) OVER w / COUNT(*) OVER w, 0) AS duration, round_even(AVG(accurate) OVER w * 100, 0) AS blockAcc
    FROM trials WINDOW w AS (PARTITION BY unique_id, phase, is_test, block)
    """,
)
def d1_percent(spark, d):
    df = metrics.block_metrics(ordered_event_trials(spark, d), hit="accurate", as_percent=True, round_duration=True)
    return df.select(*_KEYS, "block", "criterion", "duration", "blockAcc")


@query(
    "D2_phase_metrics",
    """
    b AS (SELECT *, AVG(correct) OVER (PARTITION BY unique_id, phase, is_test, block) AS blockAcc FROM trials)
    SELECT event_id, unique_id, phase, ROUND(AVG(correct) OVER w, 6) AS accuracy,
      CASE WHEN MAX(blockAcc) OVER w >= 0.8 THEN 'passed' ELSE 'failed' END AS pass,
      COUNT(*) OVER w AS trialCount, MAX(criterion) OVER w AS maxCriterion
    FROM b WINDOW w AS (PARTITION BY unique_id, phase, is_test)
    """,
)
def d2(spark, d):
    df = metrics.block_and_phase_metrics(ordered_event_trials(spark, d))
    return rounded(df.select(*_KEYS, "accuracy", "pass", "trialCount", "maxCriterion"), "accuracy")


@query(
    "D3_suboptimal_rate",
    """
    SELECT event_id, unique_id, phase,
      ROUND(COUNT(*) FILTER (pointGap <> 0 AND optimal_choice = '0') OVER w / 60.0::DOUBLE, 6) AS countPointGap,
      ROUND(COUNT(*) FILTER (bubbleGap <> 0 AND optimal_choice = '0') OVER w / 60.0::DOUBLE, 6) AS countBubbleGap
    FROM trials WINDOW w AS (PARTITION BY unique_id, phase, is_test)
    """,
)
def d3(spark, d):
    df = metrics.suboptimal_rate(event_trials(spark, d))
    return rounded(df.select(*_KEYS, "countPointGap", "countBubbleGap"), "countPointGap", "countBubbleGap")


@query(
    "D4_mean_losses",
    """
    SELECT event_id, unique_id, phase, round_even(SUM(CAST(pointLoss AS DECIMAL(28, 9))) OVER w / COUNT(*) OVER w, 0) AS meanLosses
    FROM trials WINDOW w AS (PARTITION BY unique_id, phase, is_test)
    """,
)
def d4(spark, d):
    return metrics.mean_losses(event_trials(spark, d)).select(*_KEYS, "meanLosses")


@query(
    "D5_grand_stats",
    """
    SELECT event_id, duration, ROUND(AVG(duration) OVER (), 6) AS mAcc,
           ROUND(STDDEV_SAMP(duration) OVER (), 6) AS sd_band FROM trials
    """,
)
def d5(spark, d):
    df = metrics.grand_stats(event_trials(spark, d).select("event_id", "duration"), "duration")
    return rounded(df, "mAcc", "sd_band")


@query(
    "D6_phase_trial_count",
    "SELECT event_id, unique_id, phase, COUNT(*) OVER (PARTITION BY unique_id, phase) AS trialCount FROM trials",
)
def d6(spark, d):
    return metrics.phase_trial_count(event_trials(spark, d)).select(*_KEYS, "trialCount")


@query(
    "D7_phase_accuracy",
    """
    a AS (SELECT condition, unique_id, phase, round_even(AVG(correct) OVER (PARTITION BY unique_id, phase) * 100, 0) AS accuracy
          FROM trials WHERE phase = 'Generalisation'),
    s AS (SELECT *, ROUND(STDDEV_SAMP(accuracy) OVER (), 6) AS sd FROM a)
    SELECT DISTINCT condition, unique_id, phase, accuracy, sd FROM s
    """,
)
def d7(spark, d):
    return rounded(metrics.phase_accuracy(event_trials(spark, d), "Generalisation", as_percent=True), "sd")


@query(
    "D8_composite_accuracy",
    """
    k AS (SELECT * FROM trials WHERE phase IN ('Crel', 'Generalisation')
          AND unique_id IN (SELECT unique_id FROM trials WHERE phase = 'Generalisation')),
    a AS (SELECT condition, unique_id, round_even(AVG(correct * 100) OVER (PARTITION BY unique_id), 0) AS compositeAccuracy FROM k),
    s AS (SELECT *, ROUND(AVG(compositeAccuracy) OVER (), 6) AS mean,
                 ROUND(STDDEV_SAMP(compositeAccuracy) OVER (), 6) AS sd FROM a)
    SELECT DISTINCT condition, unique_id, compositeAccuracy, mean, sd FROM s
    """,
)
def d8(spark, d):
    df = metrics.composite_accuracy(event_trials(spark, d), "Generalisation", ["Crel", "Generalisation"])
    return rounded(df, "mean", "sd")


@query(
    "D9_phase_best_criterion",
    """
    SELECT event_id, unique_id, phase, MAX(criterion) OVER w AS criterion,
      CASE WHEN MAX(criterion) OVER w >= 12 THEN 'passed' ELSE 'failed' END AS pass
    FROM trials WINDOW w AS (PARTITION BY unique_id, phase)
    """,
)
def d9(spark, d):
    df = metrics.phase_best_criterion(ordered_event_trials(spark, d), CRITERION)
    return df.select(*_KEYS, "criterion", "pass")


@query(
    "D10_proportion_passing",
    """
    p AS (SELECT condition, phase, unique_id, MAX(criterion) AS criterion, COUNT(*) AS trialCount,
                 CASE WHEN MAX(criterion) >= 12 THEN 'passed' ELSE 'failed' END AS pass
          FROM trials WHERE phase IN ('CfuncDirection', 'CfuncSpeed', 'CfuncMixed', 'CfuncTest') GROUP BY 1, 2, 3)
    SELECT *, round_even(SUM(CASE WHEN pass = 'passed' THEN 1 ELSE 0 END) OVER (PARTITION BY phase)
                         / COUNT(*) OVER (PARTITION BY phase) * 100, 0) AS proportionPassing FROM p
    """,
)
def d10(spark, d):
    base = training_and_test.base_metrics(ordered_event_trials(spark, d))
    return training_and_test.training_long(base, PHASES[1:], base, CRITERION)


@query(
    "D11_participant_choice_metrics",
    """
    SELECT event_id, unique_id, phase, round_even(AVG(correct) OVER w * 100, 0) AS optimalChoice,
      round_even(SUM(CASE WHEN remaining IS NULL OR remaining = 0 THEN 1 ELSE 0 END) OVER w / COUNT(*) OVER w * 100, 0) AS clickSuccess,
      round_even(AVG(accurate) OVER w * 100, 0) AS accuracy
    FROM trials WHERE phase = 'CfuncMixed' WINDOW w AS (PARTITION BY unique_id)
    """,
)
def d11(spark, d):
    df = metrics.participant_choice_metrics(event_trials(spark, d).where(F.col("phase") == TRAINING))
    return df.select(*_KEYS, "optimalChoice", "clickSuccess", "accuracy")


@query(
    "D12_choice_share",
    """
    SELECT event_id, unique_id, phase, response AS chosenTask,
      round_even(COUNT(*) OVER (PARTITION BY unique_id, response)
                 / COUNT(*) OVER (PARTITION BY unique_id, phase) * 100, 0) AS proportionChoice
    FROM trials WHERE phase = 'CfuncMixed'
    """,
)
def d12(spark, d):
    df = event_trials(spark, d).where(F.col("phase") == TRAINING).withColumnRenamed("response", "chosenTask")
    df = metrics.choice_share_by_phase(df)
    return df.select(*_KEYS, "chosenTask", "proportionChoice")


@query(
    "D13_choice_count",
    """
    SELECT event_id, unique_id, phase, response AS chosenTask,
      COUNT(*) OVER (PARTITION BY unique_id, response) AS proportionChoice
    FROM trials WHERE phase = 'CfuncTest'
    """,
)
def d13(spark, d):
    df = event_trials(spark, d).where(F.col("phase") == TEST).withColumnRenamed("response", "chosenTask")
    return metrics.choice_count(df).select(*_KEYS, "chosenTask", "proportionChoice")


BASE = """
    f AS (SELECT * FROM trials WHERE phase IN ('Crel', 'CfuncDirection', 'CfuncSpeed', 'CfuncMixed', 'CfuncTest')),
    bm AS (SELECT *, AVG(correct) OVER w AS blockAcc, MAX(criterion) OVER w AS bestCriterion, AVG(duration) OVER w AS meanDuration
          FROM f WINDOW w AS (PARTITION BY unique_id, phase, is_test, block)),
    pm AS (SELECT condition, unique_id, phase, is_test, block, bestCriterion AS criterion, blockAcc,
                 ROUND(meanDuration, 6) AS duration, COUNT(*) OVER w AS trialCount, AVG(correct) OVER w AS accuracy,
                 CASE WHEN MAX(blockAcc) OVER w >= 0.8 THEN 'passed' ELSE 'failed' END AS pass
          FROM bm WINDOW w AS (PARTITION BY unique_id, phase, is_test)),
    base AS (SELECT DISTINCT * FROM pm
             WHERE unique_id IN (SELECT unique_id FROM trials WHERE phase = 'CfuncTest'))
"""


@query(
    "E1_collapse",
    f"""{BASE}
    SELECT condition, unique_id, phase, is_test, block, criterion, ROUND(blockAcc, 6) AS blockAcc, duration,
           trialCount, ROUND(accuracy, 6) AS accuracy, pass FROM base
    """,
)
def e1(spark, d):
    base = training_and_test.base_log(ordered_event_trials(spark, d), PHASES, TEST)
    columns = [
        "condition", "unique_id", "phase", "is_test", "block", "criterion", "blockAcc", "duration",
        "trialCount", "accuracy", "pass",
    ]
    return metrics.collapse(rounded(base, "blockAcc", "duration", "accuracy"), columns)


@query(
    "E2_verbal_reports",
    "SELECT DISTINCT unique_id, x_2 FROM trials WHERE x_2 IS NOT NULL",
)
def e2(spark, d):
    return metrics.verbal_reports(event_trials(spark, d), ["x_2"], ["x_2"])


@query(
    "N1_rolling_criterion",
    """
    SELECT event_id, unique_id, phase, block, trial_n,
      CAST(SUM(correct) OVER (PARTITION BY unique_id, phase, block ORDER BY trial_n
           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS criterion
    FROM trials
    """,
)
def n1(spark, d):
    df = metrics.rolling_criterion(ordered_event_trials(spark, d), 3)
    return df.select(*_KEYS, "block", "trial_n", "criterion")


@query(
    "N2_criterion_trial",
    """
    SELECT unique_id, phase, MIN(CASE WHEN criterion >= 12 THEN trial_n END) AS criterion_trial
    FROM trials GROUP BY unique_id, phase
    """,
)
def n2(spark, d):
    return metrics.criterion_trial(ordered_event_trials(spark, d), CRITERION, ("unique_id", "phase"))


@query(
    "N3_mark_accurate",
    """
    SELECT event_id, CASE WHEN correct = 1 AND remaining IS NULL THEN NULL
                          WHEN correct = 1 AND remaining = 0 THEN 1 ELSE 0 END AS accurate FROM trials
    """,
)
def n3(spark, d):
    return metrics.mark_accurate(event_trials(spark, d)).select("event_id", "accurate")


@query(
    "N4_set_point",
    """
    SELECT unique_id, MAX(CASE WHEN correct = 1 THEN 7 + 2 * (event_id % 7) END) AS set_point
    FROM trials WHERE phase = 'Crel' GROUP BY unique_id
    """,
)
def n4(spark, d):
    df = event_trials(spark, d).where("phase = 'Crel'")
    df = df.withColumn("n_bubbles", 7 + 2 * (F.col("event_id") % 7))
    return metrics.set_point(df, F.col("correct") == 1)


@query(
    "N4_calibration_rules",
    """
    att AS (SELECT unique_id, trial_n AS rn, correct = 1 AS ok,
             CASE WHEN event_id % 23 = 0 THEN 7 + 2 * (event_id % 7) ELSE 7 + 2 * LEAST(coalesce(SUM(correct) OVER (
               PARTITION BY unique_id ORDER BY trial_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) END AS level
           FROM trials WHERE phase = 'Crel'),
    fo AS (SELECT DISTINCT unique_id, 0::BIGINT AS rn, 0 AS step, 0 AS tries, NULL::BIGINT AS best, false AS ended, NULL::VARCHAR AS broken FROM att
           UNION ALL
           SELECT f.unique_id, f.rn + 1,
             CASE WHEN a.ok AND NOT f.ended AND a.level = 7 + 2 * f.step THEN f.step + 1 ELSE f.step END,
             CASE WHEN a.ok THEN f.tries ELSE f.tries + 1 END,
             CASE WHEN a.ok AND NOT f.ended AND a.level = 7 + 2 * f.step THEN a.level ELSE f.best END::BIGINT,
             CASE WHEN f.ended THEN true WHEN a.ok THEN f.step + 1 >= 7 ELSE f.step > 0 OR f.tries + 1 >= 3 END,
             CASE WHEN f.ended THEN 'attempt after the end' WHEN a.level <> 7 + 2 * f.step THEN 'wrong level' END
           FROM fo f JOIN att a ON a.unique_id = f.unique_id AND a.rn = f.rn + 1 WHERE f.broken IS NULL),
    la AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY rn DESC) AS back FROM fo)
    SELECT unique_id, best AS set_point, CAST(CASE WHEN broken IS NULL THEN rn ELSE rn - 1 END AS INT) AS attempts,
      ended AND broken IS NULL AS finished, broken AS broken_rule, CAST(CASE WHEN broken IS NOT NULL THEN rn END AS INT) AS broken_at
    FROM la WHERE back = 1
    """,
)
def n4_rules(spark, d):
    """Calibration by its rules, with three tries on the first level."""
    trials = ordered_event_trials(spark, d).where("phase = 'Crel'")
    before = Window.partitionBy("unique_id").orderBy("trial_n").rowsBetween(Window.unboundedPreceding, -1)
    risen = 7 + 2 * F.least(F.coalesce(F.sum("correct").over(before), F.lit(0)), F.lit(6))
    attempts = trials.withColumn("level", F.when(F.col("event_id") % 23 == 0, 7 + 2 * (F.col("event_id") % 7)).otherwise(risen))
    return protocol.follow_calibration(attempts, ["unique_id"], ["trial_n"], "level", F.col("correct") == 1, first_tries=3)


@query(
    "N2_training_rules",
    """
    att AS (SELECT unique_id, phase, trial_n AS rn, correct, CASE WHEN event_id % 29 = 0 THEN block + 1 ELSE block END AS block FROM trials),
    fo AS (SELECT DISTINCT unique_id, phase, 0::BIGINT AS rn, 0::BIGINT AS blocks, 0 AS trial, []::INT[] AS recent, NULL::BIGINT AS criterion,
             false AS ended, NULL::VARCHAR AS broken FROM att
           UNION ALL
           SELECT unique_id, phase, rn + 1, CASE WHEN bad IS NULL THEN expected ELSE blocks END, next_trial, next_recent,
             CASE WHEN bad IS NULL AND list_sum(next_recent) >= 3 THEN rn + 1 END,
             ended OR list_sum(next_recent) >= 3 OR (expected = 3 AND next_trial = 5), bad
           FROM (SELECT f.*, CASE WHEN f.trial = 5 OR f.blocks = 0 THEN f.blocks + 1 ELSE f.blocks END AS expected,
                   CASE WHEN f.trial = 5 THEN 1 ELSE f.trial + 1 END AS next_trial,
                   list_append(CASE WHEN f.trial = 5 THEN [] ELSE f.recent END, a.correct)[-4:] AS next_recent,
                   CASE WHEN f.ended THEN 'attempt after the end'
                        WHEN a.block <> CASE WHEN f.trial = 5 OR f.blocks = 0 THEN f.blocks + 1 ELSE f.blocks END THEN 'wrong block' END AS bad,
                   f.criterion AS before
                 FROM fo f JOIN att a ON a.unique_id = f.unique_id AND a.phase = f.phase AND a.rn = f.rn + 1 WHERE f.broken IS NULL)),
    la AS (SELECT *, ROW_NUMBER() OVER w AS back, MAX(criterion) OVER (PARTITION BY unique_id, phase) AS reached
           FROM fo WINDOW w AS (PARTITION BY unique_id, phase ORDER BY rn DESC))
    SELECT unique_id, phase, CAST(reached AS INT) AS criterion_trial, CAST(blocks AS INT) AS blocks,
      CAST(CASE WHEN broken IS NULL THEN rn ELSE rn - 1 END AS INT) AS attempts,
      ended AND broken IS NULL AS finished, broken AS broken_rule, CAST(CASE WHEN broken IS NOT NULL THEN rn END AS INT) AS broken_at
    FROM la WHERE back = 1
    """,
)
def n2_rules(spark, d):
    """Training by its rules, scaled down: three blocks of five trials, three of the last four correct."""
    trials = ordered_event_trials(spark, d).withColumn("block", F.when(F.col("event_id") % 29 == 0, F.col("block") + 1).otherwise(F.col("block")))
    return protocol.follow_training(
        trials, ["unique_id", "phase"], ["trial_n"], "block", "correct", block_trials=5, most_blocks=3, window=4, needed=3
    )
