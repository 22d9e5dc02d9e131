"""Queries for reports, stacked studies, ordering, tables and figure frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rsem import percent
from ..operators import choices, cohort, metrics, report
from ..plans import training_and_test, choice_task
from ..sources.event_trials import (
    CRITERION,
    CUES,
    FULL_LENGTH,
    PHASES,
    TEST,
    TRAINING,
    event_trials,
    with_cues,
)
from .choice_queries import METRIC_SQL, OVERVIEW, SHARES_SQL, TEST_COUNTS, TRAINED, base_log, overview
from .registry import query, rounded

_ACC = """
    acc AS (SELECT experiment_no, condition, unique_id, phase, round_even(AVG(correct) * 100, 0) AS accuracy
            FROM trials GROUP BY ALL)
"""


def accuracies(spark, d):
    rows = event_trials(spark, d).groupBy("experiment_no", "condition", "unique_id", "phase")
    return rows.agg(percent(F.avg("correct")).alias("accuracy"))


@query(
    "H1_bind_participants",
    f"""{_ACC}
    SELECT a.unique_id, a.accuracy AS Crel, b.accuracy AS CfuncMixed, c.accuracy AS CfuncTest
    FROM acc a JOIN acc b ON a.unique_id = b.unique_id AND b.phase = 'CfuncMixed'
    JOIN acc c ON a.unique_id = c.unique_id AND c.phase = 'CfuncTest' WHERE a.phase = 'Crel'
    """,
)
def h1(spark, d):
    acc = accuracies(spark, d)
    frames = [
        acc.where(F.col("phase") == p).select("unique_id", F.col("accuracy").alias(p)) for p in ("Crel", TRAINING, TEST)
    ]
    return report.bind_participants(frames)


@query(
    "H2_lookup_or_null",
    f"""{_ACC}
    SELECT a.unique_id, a.accuracy, g.accuracy AS GenTestAcc FROM acc a
    LEFT JOIN acc g ON g.unique_id = a.unique_id AND g.phase = 'Generalisation' WHERE a.phase = 'Crel'
    """,
)
def h2(spark, d):
    acc = accuracies(spark, d)
    crel = acc.where("phase = 'Crel'").select("unique_id", "accuracy")
    return report.lookup_or_null(crel, acc.where("phase = 'Generalisation'"), "accuracy", "GenTestAcc")


@query(
    "H3_participant_summary",
    f"""{TRAINED},
    te AS (SELECT DISTINCT unique_id, round_even(accuracy * 100, 0) AS accuracy FROM base WHERE phase = 'CfuncTest'),
    cr AS (SELECT DISTINCT unique_id, blockAcc FROM base WHERE phase = 'Crel' AND block = 1),
    ge AS (SELECT unique_id, round_even(AVG(correct) * 100, 0) AS accuracy FROM trials WHERE phase = 'Generalisation' GROUP BY 1),
    vr AS (SELECT DISTINCT unique_id, x_2 FROM trials)
    SELECT tw.unique_id AS participantCode, round_even(cr.blockAcc * 100, 0) AS CrelTestAccuracy,
      round_even(tw.criterion_CfuncMixed * 100 / 20, 0) AS CfuncTrainAccuracy, te.accuracy AS CfuncTestAccuracy,
      vr.x_2, ge.accuracy AS GenTestAcc
    FROM tw JOIN te USING (unique_id) JOIN vr USING (unique_id)
    LEFT JOIN cr ON cr.unique_id = tw.unique_id LEFT JOIN ge ON ge.unique_id = tw.unique_id
    """,
)
def h3(spark, d):
    trials = event_trials(spark, d)
    base = base_log(spark, d)
    test = training_and_test.test_cohort(base, TEST)
    wide = training_and_test.training_wide(base, PHASES[1:], test, PHASES[1:4], CRITERION)
    training = wide.withColumnRenamed(f"criterion_{TRAINING}", "criterion")
    relational = training_and_test.relational_test(base.where("block = 1"), "Crel", is_test=0)
    generalisation = metrics.phase_accuracy(trials, "Generalisation", as_percent=True)
    reports = metrics.verbal_reports(trials, ["x_2"])
    return report.participant_summary(training, test, relational, generalisation, reports, ["x_2"])


@query(
    "Entry1_eligible_test_cohort",
    f"""{TRAINED},
    seen AS (SELECT x_2, MIN(event_id) AS f FROM trials GROUP BY x_2),
    nth AS (SELECT x_2 FROM (SELECT x_2, ROW_NUMBER() OVER (ORDER BY f) AS k FROM seen) WHERE k = 3),
    bad AS (SELECT DISTINCT unique_id FROM trials WHERE x_2 = (SELECT x_2 FROM nth)),
    ok AS (SELECT unique_id FROM base WHERE phase = 'Crel' AND is_test = 0 AND pass = 'passed'
           INTERSECT SELECT unique_id FROM base WHERE phase = 'CfuncTest' AND trialCount = 15
           EXCEPT SELECT unique_id FROM bad),
    tr AS (SELECT condition, unique_id, phase, round_even(accuracy * 100, 0) AS accuracy
           FROM base WHERE phase = 'CfuncTest' AND unique_id IN (SELECT unique_id FROM ok))
    SELECT DISTINCT *, ROUND(AVG(accuracy) OVER (), 6) AS mAcc, ROUND(STDDEV_SAMP(accuracy) OVER (), 6) AS sd_band FROM tr
    """,
)
def entry1(spark, d):
    base = base_log(spark, d)
    bad = cohort.ids_with_nth_value(event_trials(spark, d), "x_2", 3, "event_id")
    ids = training_and_test.eligible(base, "Crel", TEST, FULL_LENGTH, is_test=0, excluded=bad)
    return rounded(training_and_test.test_cohort(base, TEST, ids), "mAcc", "sd_band")


_STUDIES = f"""{_ACC},
    st AS (SELECT unique_id, accuracy, 'Exp 1' AS study FROM acc WHERE phase = 'CfuncTest'
           UNION ALL SELECT unique_id, accuracy, 'Exp 2' FROM acc WHERE phase = 'CfuncMixed'
           UNION ALL SELECT unique_id, accuracy, 'Exp 3' FROM acc WHERE phase = 'Generalisation')
"""


def studies(spark, d):
    acc = accuracies(spark, d)
    parts = {f"Exp {i}": acc.where(F.col("phase") == p) for i, p in enumerate((TEST, TRAINING, "Generalisation"), 1)}
    return report.stack_studies(parts, ["unique_id", "accuracy"])


@query("I1_stack_studies", f"{_STUDIES} SELECT * FROM st")
def i1(spark, d):
    return studies(spark, d)


@query(
    "I2_stack",
    f"""{_ACC}
    SELECT unique_id AS id, accuracy FROM acc WHERE phase = 'Crel'
    UNION ALL SELECT unique_id, accuracy FROM acc WHERE phase = 'CfuncSpeed'
    """,
)
def i2(spark, d):
    acc = accuracies(spark, d)
    frames = [acc.where("phase = 'Crel'"), acc.where("phase = 'CfuncSpeed'")]
    return report.stack(frames, ["unique_id", "accuracy"], {"unique_id": "id"})


@query(
    "I3_appendix",
    "SELECT DISTINCT unique_id, condition, x_2 FROM trials WHERE experiment_no IN (4, 5)",
)
def i3(spark, d):
    trials = event_trials(spark, d)
    frames = [trials.where("experiment_no = 4"), trials.where("experiment_no = 5")]
    return report.appendix(frames, ["condition", "x_2"], ["condition"])


@query(
    "I4_pooled_stats",
    """
    p AS (SELECT unique_id, age FROM trials WHERE experiment_no IN (4, 5) GROUP BY ALL)
    SELECT ROUND(AVG(age), 6) AS mean, ROUND(STDDEV_SAMP(age), 6) AS sd FROM p
    """,
)
def i4(spark, d):
    people = event_trials(spark, d).select("experiment_no", "unique_id", "age").distinct()
    frames = [people.where("experiment_no = 4"), people.where("experiment_no = 5")]
    return rounded(report.pooled_stats(frames, "age"), "mean", "sd")


@query("J1_order_desc", f"{_ACC} SELECT * FROM acc ORDER BY accuracy DESC NULLS LAST, unique_id DESC NULLS LAST")
def j1(spark, d):
    return report.order_desc(accuracies(spark, d), ["accuracy", "unique_id"])


@query(
    "J2_order_asc",
    "SELECT event_id, x_2, remaining FROM trials ORDER BY x_2 ASC NULLS LAST, remaining ASC NULLS LAST, event_id",
)
def j2(spark, d):
    return report.order_asc(event_trials(spark, d).select("event_id", "x_2", "remaining"), ["x_2", "remaining", "event_id"])


_TRAIN_SQL = f"ec AS (SELECT experiment_no, unique_id, {METRIC_SQL} FROM decoded WHERE phase = 'CfuncMixed' GROUP BY ALL)"


@query(
    "K6_experiment_table",
    f"""{OVERVIEW}, {TEST_COUNTS}, {_TRAIN_SQL},
    sh AS (SELECT experiment_no, unique_id, {SHARES_SQL} FROM tc),
    k1 AS (SELECT experiment_no, ROUND(AVG(accuracy_CfuncMixed), 6) AS trainAccuracy,
             ROUND(AVG(trialCount_CfuncMixed), 6) AS trainTrials,
             COUNT(*) FILTER (pass_CfuncMixed = 'passed') AS nPassed,
             ROUND(AVG(accuracy_CfuncTest), 6) AS testAccuracy,
             COUNT(*) FILTER (accuracy_CfuncTest >= 83) AS nTestCriterion FROM overview GROUP BY 1),
    k2 AS (SELECT experiment_no, ROUND(AVG(clickSuccess), 6) AS trainClickSuccess FROM ec GROUP BY 1),
    k3 AS (SELECT experiment_no, ROUND(AVG(clickSuccess), 6) AS testClickSuccess, ROUND(AVG(entDevOptimal), 6) AS optimalPath,
             COUNT(*) FILTER (entDevOptimal >= 83) AS nOptimalPathCriterion FROM sh GROUP BY 1)
    SELECT * FROM k1 JOIN k2 USING (experiment_no) JOIN k3 USING (experiment_no)
    """,
)
def k6(spark, d):
    decoded = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    people = decoded.select("unique_id", "experiment_no").distinct()
    training = choices.choice_matrix_training(decoded, TRAINING).join(people, "unique_id")
    test = choices.derived_shares(choices.choice_matrix_test(decoded, TEST), FULL_LENGTH).join(people, "unique_id")
    out = report.experiment_table(overview(spark, d), training, test, TRAINING, TEST, by="experiment_no")
    return rounded(
        out, "trainAccuracy", "trainTrials", "testAccuracy", "trainClickSuccess", "testClickSuccess", "optimalPath"
    )


@query(
    "M1_band_frame",
    f"""{_ACC}
    SELECT phase, ROUND(AVG(accuracy), 6) AS mean, ROUND(STDDEV_SAMP(accuracy), 6) AS sd,
      ROUND(AVG(accuracy) - STDDEV_SAMP(accuracy), 6) AS ymin, ROUND(AVG(accuracy) + STDDEV_SAMP(accuracy), 6) AS ymax
    FROM acc GROUP BY phase
    """,
)
def m1(spark, d):
    return rounded(report.band_frame(accuracies(spark, d), "accuracy", ["phase"]), "mean", "sd", "ymin", "ymax")


_SHARES_CTE = f"sh AS (SELECT experiment_no, unique_id, {SHARES_SQL} FROM tc)"


@query(
    "M2_study_frame",
    f"""{OVERVIEW}, {TEST_COUNTS}, {_SHARES_CTE},
    bo AS (SELECT s.*, o.accuracy_CfuncMixed AS trainingAccuracy, o.pass_CfuncMixed AS trainingPassed
           FROM sh s JOIN overview o USING (unique_id))
    SELECT unique_id, experiment_no, accuracy, entDevOptimal, trainingAccuracy, trainingPassed,
      ROUND(STDDEV_SAMP(accuracy) OVER w / SQRT(COUNT(*) OVER w) * 1.64, 6) AS CI90, ROUND(AVG(accuracy) OVER w, 6) AS mAcc,
      ROUND(STDDEV_SAMP(entDevOptimal) OVER w / SQRT(COUNT(*) OVER w) * 1.64, 6) AS altCI90,
      ROUND(AVG(entDevOptimal) OVER w, 6) AS altmAcc
    FROM bo WINDOW w AS (PARTITION BY experiment_no)
    """,
)
def m2(spark, d):
    decoded = choices.decode_choices(with_cues(event_trials(spark, d)), cues=CUES)
    over = overview(spark, d)
    rows = choice_task.test_choices(decoded, over, TRAINING, TEST, FULL_LENGTH)
    rows = rows.join(over.select("unique_id", "experiment_no"), "unique_id")
    out = choice_task.figure_rows(rows, "experiment_no").select(
        "unique_id", "experiment_no", "accuracy", "entDevOptimal", "trainingAccuracy", "trainingPassed",
        "CI90", "mAcc", "altCI90", "altmAcc",
    )
    return rounded(out, "CI90", "mAcc", "altCI90", "altmAcc")


@query(
    "M3_dot_bins",
    f"""{_STUDIES},
    vals AS (SELECT study, accuracy, COUNT(*) AS n FROM st GROUP BY ALL),
    walk AS (SELECT study, MIN(accuracy) AS start FROM vals GROUP BY study
             UNION ALL
             SELECT w.study, (SELECT MIN(v.accuracy) FROM vals v WHERE v.study = w.study AND v.accuracy > w.start + 1)
             FROM walk w WHERE w.start IS NOT NULL)
    SELECT w.study, (MIN(v.accuracy) + MAX(v.accuracy)) / 2 AS bin_centre, CAST(SUM(v.n) AS BIGINT) AS dots
    FROM walk w JOIN vals v ON v.study = w.study AND v.accuracy BETWEEN w.start AND w.start + 1
    GROUP BY w.study, w.start
    """,
)
def m3(spark, d):
    return report.dot_bins(studies(spark, d), "accuracy", ["study"])


@query(
    "M3_dot_bins_continuous",
    """
    vals AS (SELECT phase, duration AS x, COUNT(*) AS n FROM trials GROUP BY ALL),
    walk AS (SELECT phase, MIN(x) AS start FROM vals GROUP BY phase
             UNION ALL
             SELECT w.phase, (SELECT MIN(v.x) FROM vals v WHERE v.phase = w.phase AND v.x >= w.start + 12.5 + 1e-8)
             FROM walk w WHERE w.start IS NOT NULL)
    SELECT w.phase, ROUND((MIN(v.x) + MAX(v.x)) / 2, 6) AS bin_centre, CAST(SUM(v.n) AS BIGINT) AS dots
    FROM walk w JOIN vals v ON v.phase = w.phase AND v.x >= w.start AND v.x < w.start + 12.5 + 1e-8
    GROUP BY w.phase, w.start
    """,
)
def m3_continuous(spark, d):
    return rounded(report.dot_bins(event_trials(spark, d), "duration", ["phase"], 12.5), "bin_centre")


@query(
    "M4_trajectories",
    f"""{_STUDIES}
    SELECT unique_id, STRING_AGG(study || ':' || CAST(CAST(accuracy AS INT) AS VARCHAR), ', ' ORDER BY study) AS points
    FROM (SELECT DISTINCT * FROM st) GROUP BY unique_id HAVING COUNT(*) >= 2
    """,
)
def m4(spark, d):
    lines = report.trajectories(studies(spark, d), "accuracy")
    text = F.transform("points", lambda p: F.concat(p["study"], F.lit(":"), p["accuracy"].cast("int").cast("string")))
    return lines.select("unique_id", F.array_join(text, ", ").alias("points"))
