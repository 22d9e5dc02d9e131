"""Queries for choice decoding, reshaping and row-wise arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import choices, reshape
from ..operators.skew import materialize
from ..plans import training_and_test, choice_task
from ..sources.event_trials import (
    CRITERION,
    CUES,
    FULL_LENGTH,
    PHASES,
    TEST,
    TRAINING,
    event_trials,
    ordered_event_trials,
    with_cues,
)
from .registry import query, rounded
from .trial_metrics import BASE

_OPTION = """CASE {key} WHEN 'relation1select' THEN relation1 WHEN 'relation2select' THEN relation2
    WHEN 'r1d1select' THEN r1d1 WHEN 'r1d2select' THEN r1d2 WHEN 'r2d1select' THEN r2d1
    WHEN 'r2d2select' THEN r2d2 END"""
_LARGE = ", ".join(f"('{c}', '{t}')" for c, t in codes.TASK_CODES_LARGE_POINTS.items())
_SMALL = ", ".join(f"('{c}', '{t}')" for c, t in codes.TASK_CODES_SMALL_POINTS.items())

DECODED = f"""
    large AS (SELECT * FROM (VALUES {_LARGE}) AS v(code, task)),
    small AS (SELECT * FROM (VALUES {_SMALL}) AS v(code, task)),
    picked AS (SELECT *, {_OPTION.format(key="response")} AS code,
                      {_OPTION.format(key="correct_response")} AS optimal_code FROM trials),
    decoded AS (SELECT p.*, l.task AS chosenTask FROM picked p LEFT JOIN large l USING (code))
"""


@query("F1_pick_by_key", f"{DECODED} SELECT event_id, code AS choiceCue FROM picked")
def f1(spark, d):
    df = choices.pick_by_key(with_cues(event_trials(spark, d)), "response", CUES, "choiceCue")
    return df.select("event_id", "choiceCue")


@query(
    "F2_decode_task",
    f"""{DECODED}
    SELECT p.event_id, p.experiment_no, CASE WHEN p.experiment_no = 1 THEN s.task ELSE l.task END AS chosenTask
    FROM picked p LEFT JOIN small s ON s.code = p.code LEFT JOIN large l ON l.code = p.code
    """,
)
def f2(spark, d):
    df = choices.pick_by_key(event_trials(spark, d), "response", codes.OPTION_COLUMNS, "code")
    df = choices.decode_task_by_experiment(
        df, "code", {1: codes.TASK_CODES_SMALL_POINTS}, codes.TASK_CODES_LARGE_POINTS, "experiment_no", "chosenTask"
    )
    return df.select("event_id", "experiment_no", "chosenTask")


@query(
    "F3_pick_optimal_task",
    f"""{DECODED}
    SELECT event_id, CASE WHEN task IN ('lessBubbles', 'morePoints', 'lessBubblesTwice', 'lessBubblesmorePoints',
      'morePointsTwice') THEN task END AS optimalTask
    FROM picked LEFT JOIN large ON large.code = optimal_code
    """,
)
def f3(spark, d):
    return choices.pick_optimal_task(event_trials(spark, d)).select("event_id", "optimalTask")


@query("F4_pick_optimal_cue", f"{DECODED} SELECT event_id, optimal_code AS optimalCue FROM picked")
def f4(spark, d):
    df = choices.pick_optimal_cue(with_cues(event_trials(spark, d)), CUES)
    return df.select("event_id", "optimalCue")


@query(
    "F5_ordinal",
    f"""{DECODED}
    SELECT event_id, chosenTask, CASE chosenTask
      {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(codes.TASK_LEVELS, start=1))} END AS level FROM decoded
    """,
)
def f5(spark, d):
    df = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    return choices.ordinal(df, "chosenTask", codes.TASK_LEVELS, "level").select("event_id", "chosenTask", "level")


@query(
    "N5_cue_meaning",
    """
    c AS (SELECT event_id, condition, CASE event_id % 4 WHEN 0 THEN '◗' WHEN 1 THEN '■' WHEN 2 THEN '✦' ELSE '▾' END AS symbol FROM trials)
    SELECT *, CASE condition
      WHEN '1' THEN CASE symbol WHEN '◗' THEN 'more points' WHEN '■' THEN 'more bubbles' WHEN '✦' THEN 'less bubbles' ELSE 'less points' END
      WHEN '2' THEN CASE symbol WHEN '◗' THEN 'less bubbles' WHEN '■' THEN 'less points' WHEN '✦' THEN 'more points' ELSE 'more bubbles' END
      END AS meaning FROM c
    """,
)
def n5(spark, d):
    symbol = F.element_at(F.array(*[F.lit(s) for s in "◗■✦▾"]), (F.col("event_id") % 4 + 1).cast("int"))
    df = event_trials(spark, d).select("event_id", "condition", symbol.alias("symbol"))
    return choices.cue_meaning(df)


_WIDE = {
    v: ", ".join(f"MAX(CASE WHEN phase = '{p}' THEN {v} END) AS {v}_{p}" for p in PHASES[1:])
    for v in ("pass", "criterion", "trialCount")
}
TRAINED = f"""{BASE},
    tl AS (SELECT unique_id, phase, MAX(criterion) AS criterion, trialCount,
              CASE WHEN MAX(criterion) >= 12 THEN 'passed' ELSE 'failed' END AS pass
           FROM base WHERE phase <> 'Crel' GROUP BY unique_id, phase, trialCount),
    tw AS (SELECT unique_id, {_WIDE["pass"]}, {_WIDE["criterion"]}, {_WIDE["trialCount"]} FROM tl GROUP BY unique_id)
"""


def base_log(spark, d):
    """Block rows that several later steps read, so written once."""
    return materialize(training_and_test.base_log(ordered_event_trials(spark, d), PHASES, TEST))


@query("G1_pivot_metrics", f"{TRAINED} SELECT * FROM tw")
def g1(spark, d):
    base = base_log(spark, d)
    long = training_and_test.training_long(base, PHASES[1:], base.select("unique_id"), CRITERION)
    return reshape.pivot_metrics(long, ["unique_id"], "phase", ["pass", "criterion", "trialCount"], PHASES[1:])


_COUNTS = ", ".join(f"COUNT(*) FILTER (chosenTask = '{t}') AS {t}" for t in codes.TASK_LEVELS)


@query(
    "G2_pivot_single",
    """
    SELECT unique_id, MAX(CASE WHEN phase = 'Crel' THEN n END) AS Crel, MAX(CASE WHEN phase = 'CfuncTest' THEN n END) AS CfuncTest,
           MAX(CASE WHEN phase = 'Generalisation' THEN n END) AS Generalisation
    FROM (SELECT unique_id, phase, COUNT(*) AS n FROM trials GROUP BY ALL) GROUP BY unique_id
    """,
)
def g2(spark, d):
    rows = event_trials(spark, d).groupBy("unique_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    return reshape.pivot_single(rows, ["unique_id"], "phase", "n", ["Crel", "CfuncTest", "Generalisation"])


METRIC_SQL = """round_even(AVG(correct) * 100, 0) AS optimalChoice,
      round_even(COUNT(*) FILTER (remaining IS NULL OR remaining = 0) / COUNT(*) * 100, 0) AS clickSuccess,
      round_even(AVG(accurate) * 100, 0) AS accuracy"""
_SHARES = ", ".join(
    f"round_even(COUNT(*) FILTER (chosenTask = '{t}') / COUNT(*) * 100, 0) AS {t}" for t in codes.ENTAILED_TASKS
)


@query(
    "G3_choice_matrix_training",
    f"{DECODED} SELECT unique_id, {_SHARES}, {METRIC_SQL} FROM decoded WHERE phase = 'CfuncMixed' GROUP BY unique_id",
)
def g3(spark, d):
    df = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    return choices.choice_matrix_training(df, TRAINING)


TEST_COUNTS = f"""{DECODED},
    tc AS (SELECT experiment_no, unique_id, {_COUNTS}, {METRIC_SQL}
           FROM decoded WHERE phase = 'CfuncTest' GROUP BY experiment_no, unique_id)
"""


@query("G4_choice_matrix_test", f"{TEST_COUNTS} SELECT * EXCLUDE (experiment_no) FROM tc")
def g4(spark, d):
    df = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    return choices.choice_matrix_test(df, TEST)


SHARES_SQL = f"""
    round_even((lessPoints + moreBubbles + morePoints + lessBubbles) / {FULL_LENGTH} * 100, 0) AS entailedChoices,
    round_even((morePoints + lessBubbles) / {FULL_LENGTH} * 100, 0) AS entailedOptimal,
    round_even((lessPointsTwice + moreBubblesTwice + moreBubbleslessPoints + morePointsmoreBubbles + lessBubbleslessPoints
      + lessBubblesmorePoints + lessBubblesTwice + morePointsTwice) / {FULL_LENGTH} * 100, 0) AS derivedChoices,
    round_even((morePointsmoreBubbles + lessBubbleslessPoints + lessBubblesmorePoints + lessBubblesTwice
      + morePointsTwice) / {FULL_LENGTH} * 100, 0) AS derivedOptimal,
    round_even((lessBubbles + lessBubbleslessPoints + lessBubblesTwice) / {FULL_LENGTH} * 100, 0) AS lessBubblesChoices,
    round_even((morePoints + morePointsmoreBubbles + morePointsTwice) / {FULL_LENGTH} * 100, 0) AS morePointsChoices,
    round_even((lessBubblesmorePoints + lessBubbles + lessBubbleslessPoints + lessBubblesTwice + morePoints
      + morePointsmoreBubbles + morePointsTwice) / {FULL_LENGTH} * 100, 0) AS choicesOptimalCues,
    round_even((lessBubblesmorePoints + lessBubbles + lessBubblesTwice + morePoints + morePointsTwice)
      / {FULL_LENGTH} * 100, 0) AS entDevOptimal,
    round_even(lessBubblesmorePoints / {FULL_LENGTH} * 100, 0) AS lessBubblesmorePoints,
    optimalChoice, clickSuccess, accuracy"""


@query("G5_derived_shares", f"{TEST_COUNTS} SELECT unique_id, {SHARES_SQL} FROM tc")
def g5(spark, d):
    df = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    return choices.derived_shares(choices.choice_matrix_test(df, TEST), FULL_LENGTH)


@query(
    "G6_total_trials",
    f"{TRAINED} SELECT *, trialCount_CfuncDirection + trialCount_CfuncSpeed + trialCount_CfuncMixed AS totalTrials FROM tw",
)
def g6(spark, d):
    base = base_log(spark, d)
    return training_and_test.training_wide(base, PHASES[1:], base.select("unique_id"), PHASES[1:4], CRITERION)


_PAIRS = """
    pa AS (SELECT unique_id, phase, round_even(AVG(correct) * 100, 0) AS accuracy FROM trials GROUP BY 1, 2),
    pw AS (SELECT unique_id, MAX(CASE WHEN phase = 'CfuncTest' THEN accuracy END) AS CfuncTest,
                  MAX(CASE WHEN phase = 'CfuncMixed' THEN accuracy END) AS CfuncMixed
           FROM pa WHERE phase IN ('CfuncTest', 'CfuncMixed') GROUP BY 1)
"""


@query("G7_paired_difference", f"{_PAIRS} SELECT *, CfuncTest - CfuncMixed AS difference FROM pw")
def g7(spark, d):
    rows = event_trials(spark, d).groupBy("unique_id", "phase").agg(F.bround(F.avg("correct") * 100).alias("accuracy"))
    return reshape.paired_difference(rows, TEST, TRAINING)


_METRIC_COLUMNS = {
    "accuracy": "accuracy", "trialCount": "trialCount", "pass": "pass", "maxCriterion": "maxCriterion",
    "countPointGap": "countPointGap", "countBubbleGap": "countBubbleGap", "meanLosses": "meanLosses",
}
_OVER_WIDE = ", ".join(
    f"MAX(CASE WHEN phase = '{p}' THEN {v} END) AS {v}_{p}" for v in _METRIC_COLUMNS for p in (TRAINING, TEST)
)
OVERVIEW = f"""
    us AS (SELECT * FROM trials WHERE phase IN ('Crel', 'CfuncMixed', 'CfuncTest') AND unique_id <> 97 AND exclude_data <> 'yes'),
    om AS (SELECT experiment_no, unique_id, age, gender, phase, round_even(AVG(accurate) * 100, 0) AS accuracy,
              COUNT(*) AS trialCount, MAX(criterion) AS maxCriterion,
              COUNT(*) FILTER (pointGap <> 0 AND optimal_choice = '0') / {FULL_LENGTH} AS countPointGap,
              COUNT(*) FILTER (bubbleGap <> 0 AND optimal_choice = '0') / {FULL_LENGTH} AS countBubbleGap,
              round_even(AVG(pointLoss), 0) AS meanLosses FROM us GROUP BY ALL),
    op AS (SELECT *, CASE WHEN phase = 'CfuncMixed' AND maxCriterion >= 12 THEN 'passed'
                          WHEN phase = 'CfuncTest' AND accuracy >= 80 THEN 'passed' ELSE 'failed' END AS pass FROM om),
    ow AS (SELECT unique_id, experiment_no, age, gender, {_OVER_WIDE} FROM op
           WHERE phase <> 'Crel' AND unique_id IN (SELECT unique_id FROM us WHERE phase = 'CfuncTest') GROUP BY ALL),
    overview AS (SELECT * REPLACE ({FULL_LENGTH} AS trialCount_CfuncTest),
        1.6448536269514722 * STDDEV_SAMP(accuracy_CfuncTest) OVER (PARTITION BY experiment_no)
          / SQRT(COUNT(*) OVER (PARTITION BY experiment_no)) AS CI90,
        countPointGap_CfuncTest - countBubbleGap_CfuncTest AS bubbleReductionBias FROM ow)
"""

_GAPS = [f"{v}_{p}" for v in ("countPointGap", "countBubbleGap") for p in (TRAINING, TEST)]
_SIX = [*_GAPS, "CI90", "bubbleReductionBias"]


def overview(spark, d):
    return choice_task.overview(
        ordered_event_trials(spark, d), ["Crel", TRAINING, TEST], TRAINING, TEST, TEST, bad_id=97,
        experiment="experiment_no", test_trials=FULL_LENGTH, min_criterion=CRITERION,
    )


@query(
    "G8_bias_index",
    f"{OVERVIEW} SELECT unique_id, ROUND(bubbleReductionBias, 6) AS bubbleReductionBias FROM overview",
)
def g8(spark, d):
    return rounded(overview(spark, d).select("unique_id", "bubbleReductionBias"), "bubbleReductionBias")


@query(
    "G9_overview",
    f"{OVERVIEW} SELECT * REPLACE ({', '.join(f'ROUND({c}, 6) AS {c}' for c in _SIX)}) FROM overview",
)
def g9(spark, d):
    return rounded(overview(spark, d), *_SIX)
