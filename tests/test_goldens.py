"""Grouped statistics against published textbook data and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.functions.distributions import normal_upper_tail, t_quantile, t_upper_tail
from trialforge.operators import report, stats

SLEEP_1 = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
SLEEP_2 = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
DEPRESSION_X = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
DEPRESSION_Y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
TIES = [40, 45, 50, 55, 55, 60, 60, 60, 65, 70, 80, 90]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(list(zip(SLEEP_1, SLEEP_2)), "a double, b double")


@pytest.fixture(scope="module")
def long(spark):
    rows = [(x, "1") for x in SLEEP_1] + [(x, "2") for x in SLEEP_2]
    return spark.createDataFrame(rows, "x double, g string")


def test_paired_t(wide):
    r = stats.t_test_one(wide.withColumn("d", F.col("a") - F.col("b")), "d", 0, "two.sided", 0.95).first()
    assert (round(r.t, 6), r.df, round(r.p_value, 8)) == (-4.062128, 9, 0.00283289)
    assert (round(r.ci_low, 5), round(r.ci_high, 5)) == (-2.45989, -0.70011)


def test_one_sample_t(wide):
    r = stats.t_test_one(wide, ["a", "b"], 0, "greater").where("variable = 'b'").first()
    assert (round(r.t, 6), round(r.p_value, 9)) == (3.679916, 0.002538066)
    assert r.ci_high == math.inf
    less = stats.t_test_one(wide, "b", 0, "less").first()
    assert round(less.p_value + r.p_value, 12) == 1 and less.ci_low == -math.inf


def test_welch(wide, long):
    r = stats.t_test_welch(long, "x", "g", ("1", "2")).first()
    assert (round(r.t, 6), round(r.df, 5), round(r.p_value, 8)) == (-1.860813, 17.77647, 0.07939414)
    c = stats.t_test_welch_columns(wide, "a", "b").first()
    assert (c.t, c.df, c.p_value) == pytest.approx((r.t, r.df, r.p_value), rel=1e-12)


def test_bayes_factors(wide, long):
    assert round(stats.bf_paired(wide, "a", "b").first().bf10, 5) == 17.25888
    assert round(stats.bf_two_sample(long, "x", "g", ("1", "2")).first().bf10, 6) == 1.265925
    assert round(stats.bf_one_sample(wide, "b").first().bf10, 5) == 10.71554


def test_bayes_factor_ignores_the_sign(wide):
    a = stats.bf_paired(wide, "a", "b").first()
    b = stats.bf_paired(wide, "b", "a").first()
    assert a.t == pytest.approx(-b.t) and a.bf10 == pytest.approx(b.bf10)


def test_bayes_factor_of_huge_groups_does_not_overflow(spark):
    df = spark.range(200_000).select((F.col("id") % 3 + 50.0).alias("x"))
    r = stats.bf_one_sample(df, "x", 0).first()
    assert r.bf10 == math.inf and 1e5 < r.log_bf10 < 1e7


def test_signed_rank_exact(spark):
    d = [(round(x - y, 6),) for x, y in zip(DEPRESSION_X, DEPRESSION_Y)]
    r = stats.signed_rank(spark.createDataFrame(d, "d double"), "d").first()
    assert (r.v, r.p_value, round(r.estimate, 6)) == (40, 0.01953125, 0.46)


def test_signed_rank_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in TIES], "x double")
    r = stats.signed_rank(df, "x", 50).first()
    assert (r.n, r.zeros, r.v, r.tie_sum) == (11, 1, 58.5, 84)
    assert (round(r.z, 6), round(r.p_value, 8)) == (2.238307, 0.01260051)


@pytest.mark.parametrize("alternative", ["greater", "less"])
def test_signed_rank_against_all_sign_patterns(spark, alternative):
    x = [43, 48, 51, 58, 60, 64, 71, 39]
    d = np.array(x) - 50
    ranks = np.abs(d).argsort().argsort() + 1
    v = ranks[d > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(x))]
    share = np.mean([s >= v if alternative == "greater" else s <= v for s in sums])
    df = spark.createDataFrame([(float(i),) for i in x], "x double")
    r = stats.signed_rank(df, "x", 50, alternative).first()
    assert r.v == v and r.p_value == pytest.approx(share)
    means = sorted((a + b) / 2 for i, a in enumerate(x) for b in x[i:])
    assert r.estimate == np.median(means)


def test_signed_rank_takes_any_value(spark):
    df = spark.createDataFrame([(0.55,), (50.5,), (120.0,)], "x double")
    r = stats.signed_rank(df, "x", 50).first()
    assert (r.n, r.v, r.estimate) == (3, 4.0, 55.3875)


def test_signed_rank_keeps_groups_without_differences(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 60.0), ("b", 55.0)], "g string, x double")
    rows = {r.g: r for r in stats.signed_rank(df, "x", 50, by=["g"]).collect()}
    assert rows["a"].n == 0 and rows["a"].zeros == 1 and rows["b"].v == 3


def test_tails_over_many_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (30.0,), (1e4,), (1e9,)], "nu double")
    out = {r.nu: r for r in df.select("nu", t_upper_tail(F.lit(1.5), F.col("nu")).alias("p"),
                                      t_quantile(0.1, F.col("nu")).alias("q"),
                                      normal_upper_tail(F.lit(1.5)).alias("z")).collect()}
    assert out[1.0].p == pytest.approx(0.5 - math.atan(1.5) / math.pi, abs=1e-9)
    assert out[2.0].p == pytest.approx(0.5 - 1.5 / (2 * math.sqrt(2 + 1.5**2)), abs=1e-9)
    assert out[1.0].q == pytest.approx(math.tan(0.4 * math.pi), abs=1e-8)
    normal = 0.5 * math.erfc(1.5 / math.sqrt(2))
    assert out[1.0].z == pytest.approx(normal, abs=1e-10)
    assert out[1e9].p == pytest.approx(normal, abs=1e-8)
    assert out[1e9].q == pytest.approx(1.2815515655446004, abs=1e-7)


def test_tests_on_a_single_value_are_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    for r in stats.t_test_one(df, "x", 0, by=["g"]).collect():
        assert r.t is None and r.p_value is None


def test_dot_bins_against_a_plain_walk(spark):
    rng = np.random.default_rng(7)
    data = {g: rng.integers(0, 101, 60).tolist() for g in "ab"}
    expected = []
    for g, xs in data.items():
        bins = []
        for x in sorted(xs):
            if bins and x <= bins[-1][0] + 1:
                bins[-1].append(x)
            else:
                bins.append([x])
        expected += [(g, (b[0] + b[-1]) / 2, len(b)) for b in bins]
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double")
    got = [(r.g, r.bin_centre, r.dots) for r in report.dot_bins(df, "x", ["g"]).collect()]
    assert sorted(got) == sorted(expected)


# Upper quantiles of Student's t by degrees of freedom and tail.  df 1 is cot(pi * tail); the others
# were made by bisection on a tail integrated with 60 digits, df 1e6 by the normal series in 1 / df.
@pytest.mark.parametrize("tail", [1e-2, 1e-4, 1e-6, 1e-8, 1e-10])
def test_quantile_converges(spark, tail):
    from statistics import NormalDist

    z = -NormalDist().inv_cdf(tail)

    def series(df):
        return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)

    row = spark.range(1).select(*[t_quantile(tail, F.lit(float(df))).alias(f"q{df}") for df in (1, 2, 30, 1_000_000)]).first()
    assert row["q1"] == pytest.approx(1 / math.tan(math.pi * tail), rel=1e-6)
    a = 4 * tail * (1 - tail)
    assert row["q2"] == pytest.approx(2 * (0.5 - tail) * math.sqrt(2 / a), rel=1e-6)
    assert row["q1000000"] == pytest.approx(series(1e6), rel=1e-6)
    back = spark.range(1).select(t_upper_tail(F.lit(row["q30"]), F.lit(30.0)).alias("p")).first()
    assert back["p"] == pytest.approx(tail, rel=1e-6)


def test_small_tails_of_less_mirror_greater(spark):
    df = spark.range(400).select((F.col("id") % 2 - 3.0).alias("x"))
    less, greater = stats.t_test_one(df, "x", 0, "less").first(), stats.t_test_one(df.select((-F.col("x")).alias("x")), "x", 0, "greater").first()
    assert 0 < less.p_value == pytest.approx(greater.p_value, rel=1e-9)
    scores = spark.createDataFrame([(float(x % 40),) for x in range(400)], "x double")
    low = stats.signed_rank(scores, "x", 60, "less").first()
    high = stats.signed_rank(scores.select((100 - F.col("x")).alias("x")), "x", 40, "greater").first()
    assert 0 < low.p_value == pytest.approx(high.p_value, rel=1e-6)


def test_signed_rank_of_billions(spark):
    n = 5_000_000_000
    counts = spark.createDataFrame([(1, float(x), float(n)) for x in (40, 55, 70)], "g int, x double, n double")
    r = stats.signed_rank_of_values(counts, 50, "greater", 0.95, ["g"]).first()
    # Sizes 5, 10 and 20: mid-ranks n / 2, 3n / 2 and 5n / 2 (and a half each).
    assert r.n == 3 * n and r.v == pytest.approx(n * (n / 2 + 5 * n / 2 + 1), rel=1e-9) and r.p_value < 1e-300
    two = spark.range(1).select(F.lit(4_000_000_000).alias("n1"), F.lit(4_000_000_000).alias("n2"))
    assert (two.first().n1 * two.first().n2) > 2**63


def test_exact_is_a_choice(spark):
    df = spark.createDataFrame([(float(x),) for x in range(51, 63)], "x double")
    default, normal = stats.signed_rank(df, "x", 50).first(), stats.signed_rank(df, "x", 50, exact=False).first()
    assert default.p_value == 2.0**-12 and normal.p_value != default.p_value
    assert stats.signed_rank(df, "x", 50, exact_below=12).first().p_value == pytest.approx(normal.p_value)
