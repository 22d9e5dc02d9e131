"""Means rounded half to even don't depend on the order or the cut of the rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trialforge.functions.rsem import half_even_mean
from trialforge.operators import metrics
from trialforge.plans import training_and_test
from trialforge.sources.event_trials import ordered_event_trials

MEDIUM = "/root/testdata/sf0.01"


def exact(values):
    mean = sum((Fraction(repr(v)) for v in values), Fraction(0)) / len(values)
    whole, rest = divmod(mean, 1)
    return float(whole + (rest > Fraction(1, 2) or (rest == Fraction(1, 2) and whole % 2 == 1)))


def test_halves_are_halves(spark):
    draw = random.Random(1)
    groups = {}
    for g in range(200):
        n = draw.randint(1, 40)
        values = [round(draw.uniform(-50, 50), draw.choice([1, 2])) for _ in range(n - 1)]
        target = Fraction(draw.randint(-30, 30) * 2 + 1, 2) * n  # the last value makes the mean a half
        groups[g] = [*values, float(target - sum(map(Fraction, map(repr, values))))] if draw.random() < 0.8 else [*values, 0.3]
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    want = {g: exact([round(v, 9) for v in vs]) for g, vs in groups.items()}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(5 + seed)
        assert {r.g: r.m for r in df.groupBy("g").agg(half_even_mean("x").alias("m")).collect()} == want


def test_missing_huge_and_infinite(spark):
    df = spark.createDataFrame(
        [("null", 1.0), ("null", None), ("huge", 3e18), ("huge", 1e18), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("half", 2.5), ("minus", -2.5), ("minus", -0.5)],
        "g string, x double",
    )
    got = {r.g: r.m for r in df.groupBy("g").agg(half_even_mean("x").alias("m")).collect()}
    assert got["null"] is None and got["huge"] == 2e18 and got["nan"] != got["nan"] and got["inf"] == float("inf")
    assert (got["half"], got["minus"]) == (2.0, -2.0)


@pytest.mark.parametrize("build", [
    lambda t: metrics.block_metrics(t, as_percent=True, round_duration=True).select("event_id", "duration"),
    lambda t: metrics.block_and_phase_metrics(t, round_duration=True).select("event_id", "duration"),
    lambda t: metrics.mean_losses(t.withColumn("pointLoss", F.col("duration"))).select("event_id", "meanLosses"),
    lambda t: training_and_test.base_metrics(t, round_duration=True).select("unique_id", "phase", "block", "condition", "duration"),
], ids=["block_metrics", "block_and_phase_metrics", "mean_losses", "base_metrics"])
def test_the_same_over_other_partitions(spark, build):
    trials = ordered_event_trials(spark, MEDIUM)
    found = [sorted(map(tuple, build(t).collect())) for t in (trials, trials.repartition(7, "event_id"), trials.orderBy(F.xxhash64("event_id")).coalesce(2))]
    assert found[0] == found[1] == found[2]
