"""Queries for sources, sinks, projections, filters and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rsem import ascending, descending
from ..operators import choices, cohort, metrics, reshape
from ..sources import logs
from ..sources.event_trials import event_trials, ordered_event_trials
from .registry import query

LOG_COLUMNS = {
    "exp1": {"user_id": "unique_id", "event_type": "phase", "value": "duration"},
    "exp2": {"l_partkey": "unique_id", "l_returnflag": "phase", "l_linenumber": "block", "l_quantity": "duration"},
}


@query(
    "A1_load_trials",
    """
    SELECT 'exp1' AS experiment, user_id AS unique_id, event_type AS phase, value AS duration,
           CAST(NULL AS INT) AS block FROM events
    UNION ALL
    SELECT 'exp2', l_partkey, l_returnflag, l_quantity, l_linenumber FROM lineitem
    """,
    trials=False,
)
def a1(spark, d):
    paths = {"exp1": f"{d}/events.parquet", "exp2": f"{d}/lineitem.parquet"}
    return logs.load_trials(spark, paths, rename=LOG_COLUMNS)


@query(
    "A2_coerce_int",
    """
    SELECT event_id, CAST(TRUNC(TRY_CAST(set_point AS DOUBLE)) AS INT) AS set_point FROM trials
    """,
)
def a2(spark, d):
    return logs.coerce_int(event_trials(spark, d), "set_point").select("event_id", "set_point")


_ACCURACY = """
    acc AS (SELECT unique_id, phase, round_even(AVG(correct) * 100, 0) AS accuracy
            FROM trials WHERE phase = 'CfuncTest' GROUP BY ALL)
"""


def _accuracy(spark, d):
    rows = event_trials(spark, d).where("phase = 'CfuncTest'").groupBy("unique_id", "phase")
    return metrics.to_percent(rows.agg(F.avg("correct").alias("accuracy")), "accuracy")


@query(
    "A3_write_report_indexed",
    f"""
    {_ACCURACY}
    SELECT ROW_NUMBER() OVER (ORDER BY accuracy DESC, unique_id) AS row_index, unique_id, phase, accuracy FROM acc
    """,
)
def a3(spark, d):
    path = logs.report_path(spark, "indexed")
    logs.write_report(_accuracy(spark, d), path, True, [*descending("accuracy"), *ascending("unique_id")])
    return logs.read_report(spark, path, "row_index bigint, unique_id bigint, phase string, accuracy double")


@query("A4_write_report_plain", f"{_ACCURACY} SELECT unique_id, phase, accuracy FROM acc")
def a4(spark, d):
    path = logs.report_path(spark, "plain")
    logs.write_report(_accuracy(spark, d), path, False, ascending("unique_id"))
    return logs.read_report(spark, path, "unique_id bigint, phase string, accuracy double")


@query(
    "B1_keep_phases",
    "SELECT event_id, unique_id, phase FROM trials WHERE phase IN ('Crel', 'CfuncMixed')",
)
def b1(spark, d):
    return cohort.keep_phases(event_trials(spark, d), ["Crel", "CfuncMixed"]).select("event_id", "unique_id", "phase")


@query(
    "B2_keep_and_drop_where",
    """
    SELECT event_id, unique_id, condition, remaining FROM trials
    WHERE exclude_data <> 'yes' AND condition <> '2a' AND remaining <> 2 AND is_test = 0
    """,
)
def b2(spark, d):
    df = cohort.drop_where(event_trials(spark, d), "exclude_data", "yes")
    df = cohort.drop_where(cohort.drop_where(df, "condition", "2a"), "remaining", 2)
    return cohort.keep_where(df, "is_test", 0).select("event_id", "unique_id", "condition", "remaining")


@query(
    "B3_project",
    "SELECT event_id, unique_id AS participant_code, phase AS stage, duration FROM trials",
)
def b3(spark, d):
    df = reshape.project(
        event_trials(spark, d), ["event_id", "unique_id", "phase", "gender", "duration"],
        rename={"unique_id": "participant_code", "phase": "stage"}, drop=["gender"],
    )
    return df


@query(
    "B4_cast_many",
    """
    SELECT event_id, CAST(remaining AS VARCHAR) AS remaining, CAST(correct AS VARCHAR) AS correct,
           CAST(age AS VARCHAR) AS age FROM trials
    """,
)
def b4(spark, d):
    df = choices.cast_many(event_trials(spark, d), ["remaining", "correct", "age"])
    return df.select("event_id", "remaining", "correct", "age")


@query(
    "B5_label_pass",
    """
    SELECT event_id, CASE WHEN remaining IS NULL THEN NULL WHEN remaining >= 1 THEN 'passed' ELSE 'failed' END AS pass
    FROM trials
    """,
)
def b5(spark, d):
    df = metrics.label_pass(event_trials(spark, d), F.col("remaining") >= 1)
    return df.select("event_id", "pass")


@query(
    "B6_label_pass_by_phase",
    """
    m AS (SELECT unique_id, phase, is_test, MAX(criterion) AS maxCriterion,
                 round_even(AVG(accurate) * 100, 0) AS accuracy FROM trials GROUP BY ALL)
    SELECT *, CASE WHEN phase = 'CfuncMixed' AND maxCriterion >= 12 THEN 'passed'
                   WHEN phase = 'CfuncTest' AND accuracy >= 80 THEN 'passed' ELSE 'failed' END AS pass FROM m
    """,
)
def b6(spark, d):
    rows = ordered_event_trials(spark, d).groupBy("unique_id", "phase", "is_test").agg(
        F.max("criterion").alias("maxCriterion"), F.bround(F.avg("accurate") * 100).alias("accuracy")
    )
    return metrics.label_pass_by_phase(rows, "CfuncMixed", "CfuncTest", 12, 80)


@query(
    "B7_flag_hit",
    f"{_ACCURACY} SELECT *, CASE WHEN accuracy >= 83 THEN 1 ELSE 0 END AS hit FROM acc",
)
def b7(spark, d):
    return metrics.flag_hit(_accuracy(spark, d), "accuracy", 83)


@query(
    "B8_drop_null",
    "SELECT event_id, x_2, remaining FROM trials WHERE x_2 IS NOT NULL AND remaining IS NOT NULL",
)
def b8(spark, d):
    df = cohort.drop_null(event_trials(spark, d), ["x_2", "remaining"])
    return df.select("event_id", "x_2", "remaining")


@query("B9_fill_null", "SELECT event_id, COALESCE(remaining, 0) AS remaining, x_2 FROM trials")
def b9(spark, d):
    return reshape.fill_null(event_trials(spark, d).select("event_id", "remaining", "x_2"), 0)


@query("B10_with_literal", "SELECT event_id, 60 AS trial_count FROM trials")
def b10(spark, d):
    return reshape.with_literal(event_trials(spark, d).select("event_id"), "trial_count", 60)


@query(
    "B11_to_percent",
    """
    SELECT unique_id, phase, round_even(AVG(correct) * 100, 0) AS accuracy,
           round_even(MAX(criterion) * 100 / 20, 0) AS criterion FROM trials GROUP BY unique_id, phase
    """,
)
def b11(spark, d):
    rows = ordered_event_trials(spark, d).groupBy("unique_id", "phase").agg(
        F.avg("correct").alias("accuracy"), F.max("criterion").alias("criterion")
    )
    return metrics.to_percent(metrics.to_percent(rows, "accuracy"), "criterion", out_of=20)


@query(
    "C1_completers",
    """
    SELECT event_id, unique_id, phase FROM trials
    WHERE unique_id IN (SELECT unique_id FROM trials WHERE phase = 'CfuncTest')
    """,
)
def c1(spark, d):
    return cohort.completers(event_trials(spark, d).select("event_id", "unique_id", "phase"), "CfuncTest")


_PASSED = "passed AS (SELECT unique_id FROM trials WHERE phase = 'CfuncTest' GROUP BY unique_id HAVING AVG(correct) >= 0.66)"


def _passed(trials):
    rows = trials.where("phase = 'CfuncTest'").groupBy("unique_id").agg(F.avg("correct").alias("a"))
    return rows.where("a >= 0.66").select("unique_id")


@query(
    "C2_in_cohort",
    f"{_PASSED} SELECT event_id, unique_id, phase FROM trials WHERE unique_id IN (SELECT unique_id FROM passed)",
)
def c2(spark, d):
    trials = event_trials(spark, d)
    return cohort.in_cohort(trials.select("event_id", "unique_id", "phase"), _passed(trials))


@query(
    "C3_not_in_cohort",
    f"{_PASSED} SELECT event_id, unique_id, phase FROM trials WHERE unique_id NOT IN (SELECT unique_id FROM passed)",
)
def c3(spark, d):
    trials = event_trials(spark, d)
    return cohort.not_in_cohort(trials.select("event_id", "unique_id", "phase"), _passed(trials))


@query(
    "C4_has_phase_then_keep",
    """
    SELECT event_id, unique_id, phase FROM trials WHERE phase IN ('Crel', 'Generalisation')
      AND unique_id IN (SELECT unique_id FROM trials WHERE phase = 'Generalisation')
    """,
)
def c4(spark, d):
    df = event_trials(spark, d).select("event_id", "unique_id", "phase")
    return cohort.has_phase_then_keep(df, "Generalisation", ["Crel", "Generalisation"])


@query(
    "C5_full_length",
    """
    SELECT unique_id, COUNT(*) AS trialCount FROM trials WHERE phase = 'CfuncTest'
    GROUP BY unique_id HAVING COUNT(*) = 15
    """,
)
def c5(spark, d):
    return cohort.full_length(event_trials(spark, d), "CfuncTest", 15)


@query(
    "C6_cohort_difference",
    """
    trained AS (SELECT unique_id FROM trials WHERE phase = 'CfuncMixed' GROUP BY 1 HAVING MAX(criterion) >= 12),
    success AS (SELECT unique_id FROM trials WHERE phase = 'CfuncTest' GROUP BY 1
                HAVING round_even(AVG(correct) * 100, 0) >= 74),
    slumped AS (SELECT unique_id FROM trained EXCEPT SELECT unique_id FROM success)
    SELECT event_id, unique_id, phase, correct FROM trials WHERE unique_id IN (SELECT unique_id FROM slumped)
    """,
)
def c6(spark, d):
    trials = event_trials(spark, d)
    best = ordered_event_trials(spark, d).where("phase = 'CfuncMixed'").groupBy("unique_id")
    trained = best.agg(F.max("criterion").alias("best")).where("best >= 12")
    success = _accuracy(spark, d).where("accuracy >= 74")
    slumped = cohort.cohort_difference(trained, success)
    return cohort.in_cohort(trials.select("event_id", "unique_id", "phase", "correct"), slumped)


@query(
    "C7_exclude_by_nth_value",
    """
    seen AS (SELECT x_2, MIN(event_id) AS f FROM trials GROUP BY x_2),
    nth AS (SELECT x_2 FROM (SELECT x_2, ROW_NUMBER() OVER (ORDER BY f) AS k FROM seen) WHERE k = 3),
    bad AS (SELECT DISTINCT unique_id FROM trials WHERE x_2 = (SELECT x_2 FROM nth))
    SELECT event_id, unique_id, x_2 FROM trials WHERE unique_id NOT IN (SELECT unique_id FROM bad)
    """,
)
def c7(spark, d):
    df = event_trials(spark, d).select("event_id", "unique_id", "x_2")
    return cohort.exclude_by_nth_value(df, "x_2", 3, "event_id")


@query("C8_distinct_values", "SELECT DISTINCT unique_id, x_2 FROM trials")
def c8(spark, d):
    return cohort.distinct_values(event_trials(spark, d), "unique_id", "x_2")


@query(
    "C9_label_membership",
    """
    SELECT unique_id, phase, COUNT(*) AS n,
      CASE WHEN unique_id IN (SELECT unique_id FROM trials WHERE phase = 'Generalisation') THEN 'Exp. 1'
           WHEN unique_id IN (SELECT unique_id FROM trials WHERE phase = 'CfuncTest' AND age >= 30) THEN 'Exp. 2 feedback'
           WHEN unique_id IN (SELECT unique_id FROM trials WHERE age >= 22) THEN 'Exp. 2 no feedback'
      END AS experiment
    FROM trials GROUP BY unique_id, phase
    """,
)
def c9(spark, d):
    trials = event_trials(spark, d)
    ids = [
        ("Exp. 1", trials.where("phase = 'Generalisation'")),
        ("Exp. 2 feedback", trials.where("phase = 'CfuncTest' AND age >= 30")),
        ("Exp. 2 no feedback", trials.where("age >= 22")),
    ]
    rows = trials.groupBy("unique_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    return cohort.label_membership(rows, ids)


