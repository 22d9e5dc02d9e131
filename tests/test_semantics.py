"""Rounding and missing-value rules, each on a literal table."""

import pytest
from pyspark.sql import functions as F

from trialforge.functions import rsem
from trialforge.operators import choices, metrics, report, reshape, stats
from trialforge.plans import training_and_test
from trialforge.sources import logs

from .conftest import values


def column(spark, data, kind="double"):
    return spark.createDataFrame([(v,) for v in data], f"x {kind}")


def one(df):
    return df.first()[0]


def test_half_even(spark):
    df = column(spark, [0.5, 1.5, 2.5, 82.5]).select(rsem.half_even("x"))
    assert [r[0] for r in df.collect()] == [0, 2, 2, 82]


def test_strict_aggregates(spark):
    df = column(spark, [1.0, None, 3.0])
    for agg in (rsem.strict_mean, rsem.strict_sum, rsem.strict_max, rsem.strict_sd):
        assert one(df.agg(agg("x"))) is None
    assert one(df.agg(rsem.strict_mean("x", na_rm=True))) == 2
    assert one(df.agg(rsem.strict_max("x", na_rm=True))) == 3


def test_filters_drop_missing_predicates(spark):
    from trialforge.operators import cohort

    df = column(spark, ["yes", "no", None], "string")
    assert values(cohort.drop_where(df, "x", "yes"), "x") == [("no",)]
    assert values(cohort.keep_where(df, "x", "yes"), "x") == [("yes",)]


def test_membership_is_never_missing(spark):
    df = column(spark, [None, "a", "b"], "string").select(rsem.is_in("x", ["a"]).alias("m"))
    assert [r.m for r in df.collect()] == [False, True, False]


def test_missing_condition_stays_missing(spark):
    df = column(spark, [1.0, None, 0.0])
    labels = metrics.label_pass(df, F.col("x") >= 1)
    assert [r["pass"] for r in labels.collect()] == ["passed", None, "failed"]


def test_later_expressions_see_overwritten_columns(spark):
    df = spark.createDataFrame(
        [("1", i, "T", 1, 1, None, None, acc, "passed", 10) for i, acc in enumerate([0.331, 0.344])],
        "condition string, unique_id long, phase string, is_test int, block int, criterion int, duration double, "
        "accuracy double, pass string, trialCount int",
    )
    out = training_and_test.test_cohort(df, "T")
    assert {round(r.sd_band, 7) for r in out.collect()} == {0.7071068}


def test_missing_remaining_counts_as_success(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, r) for r in (0, None, 2, 0)], "unique_id int, correct int, accurate int, remaining int"
    )
    out = metrics.participant_choice_metrics(df)
    assert {r.clickSuccess for r in out.collect()} == {75.0}
    assert one(stats.count_where(df, F.col("remaining") == 0)) == 2


def test_sd_of_one_value_is_missing(spark):
    assert stats.mean_sd(column(spark, [5.0]), "x").first().sd is None


def test_missing_is_a_distinct_value(spark):
    df = column(spark, ["a", "a", None], "string")
    assert one(df.agg(rsem.count_distinct("x", count_null=True))) == 2
    assert one(df.agg(rsem.count_distinct("x"))) == 1


def test_missing_sorts_last(spark):
    df = column(spark, [2, None, 1], "int")
    assert [r.x for r in report.order_asc(df, ["x"]).collect()] == [1, 2, None]
    assert [r.x for r in report.order_desc(df, ["x"]).collect()] == [2, 1, None]


def test_levels_sort_by_position(spark):
    df = choices.ordinal(column(spark, ["b", "a", "z"], "string"), "x", ["b", "a"], "level")
    assert [r.level for r in df.collect()] == [1, 2, None]


def test_lenient_integers(spark):
    df = logs.coerce_int(column(spark, ["7.9", "n/a", None, "1e30", "-2.5"], "string"), "x")
    assert [r.x for r in df.collect()] == [7, None, None, None, -2]


def test_division_by_zero_is_missing(spark):
    assert one(column(spark, [0.0]).select(rsem.share(F.lit(1), "x"))) is None


def test_fill_covers_nan(spark):
    df = reshape.fill_null(column(spark, [float("nan"), None, 2.0]), 0)
    assert [r.x for r in df.collect()] == [0, 0, 2]


def test_grand_sd_counts_rows(spark):
    rows = spark.createDataFrame([(40.0, 2), (70.0, 1)], "x double, n int")
    weighted = metrics.grand_stats(rows, "x", weight="n").first()
    assert round(weighted.sd_band, 2) == 17.32 and weighted.mAcc == 50
    assert round(metrics.grand_stats(rows, "x").first().sd_band, 2) == 21.21


def test_row_sum_is_missing_if_a_part_is(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r.totalTrials for r in reshape.total_trials(df, ["a", "b"]).collect()] == [3, None]


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "id int, k string, v int")
    with pytest.raises(Exception, match="several rows"):
        reshape.pivot_single(df, ["id"], "k", "v", ["a", "b"]).collect()


def test_pivot_keeps_absent_levels(spark):
    df = spark.createDataFrame([(1, "a", 1, "x")], "id int, k string, v int, w string")
    out = reshape.pivot_metrics(df, ["id"], "k", ["v", "w"], ["a", "b"])
    assert out.columns == ["id", "v_a", "v_b", "w_a", "w_b"]
    assert out.first().asDict() == {"id": 1, "v_a": 1, "v_b": None, "w_a": "x", "w_b": None}


def test_pass_rule_ignores_what_it_does_not_need(spark):
    df = spark.createDataFrame(
        [("train", 17, None), ("test", None, 80.0), ("test", 20, None), ("other", None, None), ("train", 3, 99.0)],
        "phase string, maxCriterion int, accuracy double",
    )
    out = metrics.label_pass_by_phase(df, "train", "test")
    assert [r["pass"] for r in out.collect()] == ["passed", "passed", None, "failed", "failed"]
