"""Ids that occur in two experiments: one stacked log gives what each experiment gives alone."""

import random

import pytest
from pyspark.sql import functions as F

from trialforge.functions import codes
from trialforge.operators import choices, cohort, metrics, report
from trialforge.plans import choice_task, training_and_test

from .conftest import values

KEY = ["experiment", "unique_id"]
PHASES = ["Crel", "CfuncTest"]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = []
    for e in ("one", "two"):
        for p in range(6):
            for phase in PHASES:
                if phase == "CfuncTest" and (p + (e == "two")) % 4 == 0:
                    continue
                for t in range(12):
                    hit = rng.randrange(2) if p else int(e == "one")
                    correct = None if (p, t, e) == (3, 4, "one") else hit
                    rows.append((e, f"c{p % 2}", p, 20 + p, "f", "no", phase, int(phase == "CfuncTest"), t // 6, correct, hit, rng.randrange(21),
                                 rng.random(), rng.choice(codes.TASK_LEVELS), rng.choice([0, None, 1]), rng.randrange(9), rng.choice([0, 5]), 0, str(hit)))
    return spark.createDataFrame(
        rows, "experiment string, condition string, unique_id long, age int, gender string, exclude_data string, phase string, is_test int, block int, correct int, "
        "accurate int, criterion int, duration double, chosenTask string, remaining int, pointLoss int, pointGap int, bubbleGap int, optimal_choice string",
    ).cache()


def base(df, key):
    return training_and_test.base_log(df, PHASES, "CfuncTest", key=key)


MAKERS = {
    "base_log": lambda df, key, by: base(df, key),
    "test_cohort": lambda df, key, by: training_and_test.test_cohort(base(df, key), "CfuncTest", key=key, by=by),
    "relational_test": lambda df, key, by: training_and_test.relational_test(base(df, key), "CfuncTest", key=key, by=by),
    "training_wide": lambda df, key, by: training_and_test.training_wide(base(df, key), ["Crel"], base(df, key), ["Crel"], 15, key, by),
    "phase_accuracy": lambda df, key, by: metrics.phase_accuracy(df, "Crel", True, key, by),
    "composite_accuracy": lambda df, key, by: metrics.composite_accuracy(df, "CfuncTest", PHASES, key, by),
    "proportion_passing": lambda df, key, by: metrics.proportion_passing(metrics.label_pass(df, F.col("accurate") == 1), by).select(*key_columns(key), "phase", "block", "proportionPassing"),
    "choice_matrix_training": lambda df, key, by: choices.choice_matrix_training(df, "Crel", key=key),
    "derived_shares": lambda df, key, by: choices.derived_shares(choices.choice_matrix_test(df, "CfuncTest", key=key), 12, key),
    "overview": lambda df, key, by: choice_task.overview(df, PHASES, "Crel", "CfuncTest", "CfuncTest", test_trials=12, key=key),
}


def key_columns(key):
    return cohort.key_list(key)


def rounded(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(MAKERS))
def test_stacked_equals_each_alone(log, name):
    make = MAKERS[name]
    stacked = make(log, KEY, ["experiment"])
    columns = [c for c in stacked.columns if c != "experiment"]
    alone = []
    for e in ("one", "two"):
        got = make(log.where(F.col("experiment") == e), "unique_id", [])
        alone += [[e, *r] for r in values(got, *columns)]
    assert rounded(values(stacked, "experiment", *columns)) == rounded(alone)
    assert len(alone) > 4


def test_an_id_is_not_pooled(log):
    over = choice_task.overview(log, PHASES, "Crel", "CfuncTest", "CfuncTest", test_trials=12, key=KEY)
    found = {r["experiment"]: r["accuracy_CfuncTest"] for r in over.where("unique_id = 0").collect()}
    assert found.get("two") in (None, 0.0) and found.get("one") in (None, 100.0)


def test_an_id_twice_is_an_error(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "unique_id long, a string")
    twice = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "unique_id long, b string")
    for make in (lambda: report.bind_participants([a, twice]), lambda: report.lookup_or_null(a, twice, "b")):
        with pytest.raises(Exception, match="several rows for 1"):
            make().collect()


def test_nth_value_with_missing_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", None), (4, "d", 6)], "unique_id long, text string, o int")
    assert values(cohort.ids_with_nth_value(df, "text", 2, "o"), "unique_id") == [(4,)]
    assert cohort.ids_with_nth_value(df, "text", 3, "o").count() == 0


@pytest.mark.parametrize("as_percent", [False, True])
def test_fused_metrics_equal_the_steps(log, as_percent):
    keys = [*KEY, "phase", "is_test"]
    steps = metrics.phase_metrics(metrics.block_metrics(log, [*keys, "block"], as_percent=as_percent), keys, as_percent=as_percent)
    fused = metrics.block_and_phase_metrics(log, [*keys, "block"], keys, as_percent=as_percent)
    columns = [*keys, "block", "criterion", "duration", "blockAcc", "accuracy", "pass", "trialCount", "maxCriterion"]
    assert rounded(values(fused, *columns)) == rounded(values(steps, *columns))
    assert None in {r["accuracy"] for r in fused.collect()}
    columns = [*KEY, "phase", "chosenTask", "trialCount", "proportionChoice"]
    steps = metrics.choice_share(metrics.phase_trial_count(log, KEY), KEY)
    assert values(metrics.choice_share_by_phase(log, KEY), *columns) == values(steps, *columns)


def test_fused_metrics_read_the_log_twice(spark, plan):
    from trialforge.catalog import QUERIES

    for name, windows in (("D2_phase_metrics", 4), ("D12_choice_share", 2)):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")
        text = plan(made, "simple")
        assert text.count("FileScan") <= 2 and text.count("Window ") <= windows


def test_no_job_runs_while_plans_are_built(spark, log):
    context = spark.sparkContext
    context.setJobGroup("building", "plans only")
    try:
        cohort.completers(log, "CfuncTest", KEY)
        cohort.has_phase_then_keep(log, "CfuncTest", PHASES, KEY)
        metrics.block_and_phase_metrics(log)
        metrics.choice_share_by_phase(log)
        metrics.participant_choice_metrics(log)
        metrics.phase_accuracy(log, "Crel")
        assert list(context.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_response_times_of_the_relational_test(log):
    rows = base(log, KEY).where("phase = 'CfuncTest' AND is_test = 1")
    want = {r["experiment"]: (r["m"], r["s"]) for r in rows.groupBy("experiment").agg(F.avg("duration").alias("m"), F.stddev_samp("duration").alias("s")).collect()}
    found = training_and_test.relational_test(base(log, KEY), "CfuncTest", key=KEY, by=["experiment"]).collect()
    assert len(found) > 8
    for r in found:
        assert (r["meanRT"], r["sdRT"]) == pytest.approx(want[r["experiment"]])
