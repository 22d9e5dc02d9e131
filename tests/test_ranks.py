"""Rank tests and bins of continuous values, in one run and in many."""

import bisect
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import ranks, report, skew, stats

KINDS = {
    "plain": lambda draw: draw.gauss(0.3, 1),
    "tied": lambda draw: draw.choice([0.1 * i for i in range(-20, 60)]),
    "steep": lambda draw: math.exp(draw.gauss(0, 4)) - 1,
    "far": lambda draw: 1e9 + draw.gauss(0.2, 1),
}


def signed_rank(x, mu, alternative, conf=0.95):
    """The normal test value by value; estimate and bound by bisection on the statistic itself."""
    x = np.array(x, float)
    correction = 0.5 if alternative == "greater" else -0.5

    def statistic(at, shift):
        d = x - at
        d = d[d != 0]
        size = np.abs(d)
        order = np.sort(size)
        rank = (np.searchsorted(order, size, "left") + np.searchsorted(order, size, "right") + 1) / 2
        _, ties = np.unique(size, return_counts=True)
        n = len(d)
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties.astype(float) ** 3 - ties).sum() / 48)
        return n, rank[d > 0].sum(), (rank[d > 0].sum() - n * (n + 1) / 4 - shift) / sd

    def crossing(level, shift):
        """Where the statistic, which falls in steps, comes down to the level: between two doubles, or the middle of a flat stretch."""
        if statistic(x.min(), shift)[2] <= level:
            return x.min()
        if statistic(x.max(), shift)[2] >= level:
            return x.max()

        def last(holds):
            low, high = x.min(), x.max()
            while high - low > 1e-12 * max(1, abs(high)):
                middle = (low + high) / 2
                low, high = (middle, high) if holds(statistic(middle, shift)[2]) else (low, middle)
            return (low + high) / 2

        return (last(lambda w: w > level + 1e-12) + last(lambda w: w >= level - 1e-12)) / 2

    n, v, z = statistic(mu, correction)
    level = NormalDist().inv_cdf(conf) * (1 if alternative == "greater" else -1)
    tail = NormalDist().cdf(-z if alternative == "greater" else z)
    return n, v, z, tail, crossing(0, 0), crossing(level, correction)


def check(r, x, mu, alternative):
    n, v, z, p, estimate, bound = signed_rank(x, mu, alternative)
    assert (r.n, r.v) == (n, v)
    assert r.z == pytest.approx(z, rel=1e-9) and r.p_value == pytest.approx(p, abs=1e-9)
    scale = max(1.0, max(map(abs, x)))
    assert r.estimate == pytest.approx(estimate, abs=1e-9 * scale)
    got, other = (r.ci_low, r.ci_high) if alternative == "greater" else (r.ci_high, r.ci_low)
    assert got == pytest.approx(bound, abs=1e-9 * scale) and math.isinf(other)


@pytest.mark.parametrize("alternative", ["greater", "less"])
def test_signed_rank_of_continuous_values(spark, alternative):
    draw = random.Random(1)
    data = {k: [f(draw) for _ in range(301)] for k, f in KINDS.items()} | {"even": [draw.random() for _ in range(60)], "few": [1.0, 1.0, 2.5, 120.0, 0.55]}
    mus = {"far": 1e9 + 0.1}
    for name, xs in data.items():
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),), (float("inf"),)], "x double")
        mu = mus.get(name, 0.4)
        check(stats.signed_rank(df, "x", mu, alternative, exact=False).first(), xs, mu, alternative)


def test_groups_over_many_runs(spark, small_limits):
    draw = random.Random(2)
    data = {"a": [KINDS["plain"](draw) for _ in range(60)], "b": [KINDS["tied"](draw) for _ in range(90)], None: [KINDS["steep"](draw) for _ in range(40)], "small": [0.5, 0.7, -0.2]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, x double")
    found = {r.g: r for r in stats.signed_rank(df, "x", 0.4, by=["g"], exact=False).collect()}
    assert set(found) == set(data)
    for g, xs in data.items():
        check(found[g], xs, 0.4, "greater")
    rows = report.dot_bins(df, "x", ["g"], 0.25).collect()
    for g, xs in data.items():
        assert sorted((r.bin_centre, r.dots) for r in rows if r.g == g) == walk(xs, 0.25)


def walk(xs, width):
    bins = []
    for x in sorted(xs):
        if bins and x < bins[-1][0] + width + 1e-8:
            bins[-1].append(x)
        else:
            bins.append([x])
    return [((b[0] + b[-1]) / 2, len(b)) for b in bins]


@pytest.mark.parametrize("width", [0.001, 1.0, 1e6])
def test_dot_bins_of_continuous_values(spark, width):
    draw = random.Random(3)
    data = {k: [f(draw) for _ in range(200)] for k, f in KINDS.items()} | {"edge": [0.0, width, width + 5e-9, 2 * width + 1e-3]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("edge", None), ("edge", float("nan"))], "g string, x double")
    rows = report.dot_bins(df, "x", ["g"], width).collect()
    for g, xs in data.items():
        assert sorted((r.bin_centre, r.dots) for r in rows if r.g == g) == walk(xs, width)


def test_wide_bins_over_many_runs(spark, small_limits):
    """A bin that spans several runs, and a walk without gaps."""
    xs = [i * 0.5 for i in range(40)] + [100.0 + i * 0.001 for i in range(20)]
    df = spark.createDataFrame([("a", x) for x in xs], "g string, x double").repartition(3)
    for width in (7.25, 1000.0):
        rows = report.dot_bins(df, "x", ["g"], width).collect()
        assert sorted((r.bin_centre, r.dots) for r in rows) == walk(xs, width)


def test_selection_equals_brute_force():
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal(2000), np.round(rng.standard_normal(2000), 1), rng.standard_normal(2000) ** 9, np.full(7, 3.5), np.array([0.0]), np.array([-0.3, 0.0, 0.1, 0.2])):
        values, counts = np.unique(x, return_counts=True)
        i, j = np.triu_indices(len(x))
        means = np.sort((x[i] + x[j]) / 2)
        ks = [1, 2, len(means) // 3 + 1, (len(means) + 1) // 2, len(means)]
        ks = [k for k in ks if k <= len(means)]
        got = ranks.select_means(values, counts.astype(float), ks)
        assert got == pytest.approx([means[k - 1] for k in ks], rel=1e-12, abs=1e-14)


def test_ends_of_runs_bracket_every_position():
    draw = random.Random(5)
    x = sorted(draw.gauss(0, 1) for _ in range(300))
    cuts = [0, 40, 41, 170, 300]
    import pandas as pd

    ends = ranks.RunEnds(pd.DataFrame([(i, x[a], x[b - 1], float(b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], columns=["_run", "first", "last", "weight"]))
    means = sorted((a + b) / 2 for i, a in enumerate(x) for b in x[i:])
    for k in range(1, len(means), 997):
        low, high = ends.bracket(k)
        assert bisect.bisect_right(means, low) < k <= bisect.bisect_right(means, high)


def test_running_sum_over_many_runs(spark, small_limits):
    draw = random.Random(6)
    rows = [(g, draw.random(), float(draw.randint(0, 3))) for g in ("a", None, "b") for _ in range(90 if g != "b" else 5)]
    found = ranks.running_sum(spark.createDataFrame(rows, "g string, x double, n double"), ["g"], "x", "n", "s").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.s == sum(n for g, x, n in rows if g == r.g and x <= r.x)


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert stats.signed_rank(empty, "x", 1, by=["g"]).count() == 0
    assert report.dot_bins(empty, "x", ["g"]).count() == 0
    same = spark.createDataFrame([("a", 5.0)] * 4 + [("b", None)], "g string, x double")
    r = stats.signed_rank(same, "x", 5, by=["g"]).collect()
    assert [(q.g, q.n, q.zeros, q.estimate, q.ci_low, q.z) for q in r] == [("a", 0, 4, 5.0, None, None)]


def test_a_group_beyond_one_task(spark):
    """Selection in a group beyond one task reads runs, never the group."""
    spark.conf.set(skew.HOT_ROWS_CONF, "4000")
    try:
        df = spark.range(20_000).select(F.lit("a").alias("g"), (F.xxhash64("id") / F.lit(2.0**63)).alias("x"))
        r = stats.signed_rank(df, "x", 0.01, by=["g"]).first()
        x = np.array([q.x for q in df.collect()])
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)
    values, counts = np.unique(x, return_counts=True)
    m = len(x) * (len(x) + 1) // 2
    low, high = ranks.select_means(values, counts.astype(float), [(m + 1) // 2, m // 2 + 1])
    assert r.estimate == pytest.approx((low + high) / 2, rel=1e-12)
