"""Properties that hold on the given tables."""

import pytest
from pyspark.sql import functions as F

from trialforge.functions import codes
from trialforge.operators import choices, cohort, metrics, report
from trialforge.plans import training_and_test
from trialforge.sources.event_trials import CUES, TRAINING, event_trials, ordered_event_trials, with_cues

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trials(spark):
    return event_trials(spark, FOLDER)


def test_row_metrics_keep_the_row_count(spark, trials):
    n = trials.count()
    assert metrics.block_metrics(ordered_event_trials(spark, FOLDER)).count() == n
    for step in (metrics.suboptimal_rate, metrics.mean_losses, metrics.phase_trial_count, metrics.participant_choice_metrics):
        assert step(trials).count() == n


def test_training_shares_add_up(trials):
    decoded = choices.decode_choices(with_cues(trials), cues=CUES)
    matrix = choices.choice_matrix_training(decoded, TRAINING, codes.TASK_LEVELS)
    unknown = decoded.where(F.col("chosenTask").isNull()).count()
    assert unknown == 0
    total = sum(F.col(t) for t in codes.TASK_LEVELS)
    for r in matrix.select(total.alias("s")).collect():
        assert abs(r.s - 100) <= len(codes.TASK_LEVELS) / 2


def test_shares_match_the_row_preserving_metric(trials):
    rows = choices.decode_choices(with_cues(trials), cues=CUES).where(F.col("phase") == TRAINING)
    long = metrics.choice_share(metrics.phase_trial_count(rows)).select("unique_id", "chosenTask", "proportionChoice")
    wide = choices.choice_matrix_training(rows, TRAINING, codes.TASK_LEVELS)
    for r in long.distinct().join(wide, "unique_id").collect():
        assert r[r.chosenTask] == r.proportionChoice


def test_bound_frames_have_the_smaller_row_count(trials):
    a = trials.select("unique_id").distinct()
    b = trials.where("phase = 'CfuncTest'").select("unique_id").distinct().withColumn("y", F.lit(1))
    assert report.bind_participants([a, b]).count() == min(a.count(), b.count())


def test_lookup_goes_by_key(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "unique_id int")
    right = spark.createDataFrame([(3, 30), (1, 10)], "unique_id int, v int")
    out = report.lookup_or_null(left, right, "v", "w")
    assert {r.unique_id: r.w for r in out.collect()} == {1: 10, 2: None, 3: 30}


def test_lines_need_one_value_per_study(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "unique_id int, study string, v double")
    (line,) = report.trajectories(df, "v").collect()
    assert line.unique_id == 1 and [tuple(p) for p in line.points] == [("a", 1.0), ("b", 2.0)]
    twice = df.unionByName(df.withColumn("v", F.col("v") + 1))
    with pytest.raises(Exception, match="several values"):
        report.trajectories(twice, "v").collect()


def test_eligible_needs_every_criterion(spark):
    rows = [
        (1, "Crel", 1, "passed", 30), (1, "Test", 1, "failed", 60),
        (2, "Crel", 1, "failed", 30), (2, "Test", 1, "passed", 60),
        (3, "Crel", 1, "passed", 30), (3, "Test", 1, "passed", 59),
        (4, "Crel", 0, "passed", 30), (4, "Test", 1, "passed", 60),
        (5, "Crel", 1, "passed", 30), (5, "Test", 1, "passed", 60),
    ]
    base = spark.createDataFrame(rows, "unique_id int, phase string, is_test int, `pass` string, trialCount int")
    ids = training_and_test.eligible(base, "Crel", "Test", 60)
    assert sorted(r.unique_id for r in ids.collect()) == [1, 5]
    excluded = spark.createDataFrame([(5,)], "unique_id int")
    assert [r.unique_id for r in training_and_test.eligible(base, "Crel", "Test", 60, excluded=excluded).collect()] == [1]


def test_nth_text_counts_a_missing_text(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "b", 3), (4, "a", 4)], "unique_id int, t string, o int")
    assert [r.unique_id for r in cohort.ids_with_nth_value(df, "t", 3, "o").collect()] == [3]
    assert cohort.ids_with_nth_value(df, "t", 2, "o").count() == 0
    assert cohort.ids_with_nth_value(df, "t", 4, "o").count() == 0
    assert sorted(r.unique_id for r in cohort.exclude_by_nth_value(df, "t", 1, "o").collect()) == [2, 3]


def test_first_matching_cohort_gives_the_label(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "unique_id int")
    one = spark.createDataFrame([(1,)], "unique_id int")
    both = spark.createDataFrame([(1,), (2,), (2,)], "unique_id int")
    out = cohort.label_membership(df, [("A", one), ("B", both)])
    assert {r.unique_id: r.experiment for r in out.collect()} == {1: "A", 2: "B", 3: None}
