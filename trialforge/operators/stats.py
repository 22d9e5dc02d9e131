"""Aggregates and grouped tests: one distributed aggregate, then one row per group."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import (
    log_bayes_factor,
    normal_upper_tail,
    signed_rank_counts,
    t_quantile,
    t_upper_tail,
)
from ..functions.rsem import count_distinct, strict_max, strict_mean, strict_sd
from .ranks import pairwise_means_at, running_sum, value_counts
from .skew import join_per_key, materialize

Z_ONE_SIDED_95 = 1.6448536269514722
Z_FIGURE = 1.64
MEDIUM_PRIOR = math.sqrt(2) / 2


# --- counts and moments -----------------------------------------------------


def count_where(df: DataFrame, cond: Column, by: list[str] = [], out: str = "n") -> DataFrame:
    """Number of rows for which the condition holds; missing does not count."""
    return df.groupBy(*by).agg(F.count_if(cond).alias(out))


def count_distinct_where(
    df: DataFrame, column: str, cond: Column, by: list[str] = [], count_null: bool = False, out: str = "n"
) -> DataFrame:
    return df.groupBy(*by).agg(count_distinct(column, cond, count_null).alias(out))


def distinct_value_stats(
    df: DataFrame, column: str, cond: Column | None = None, by: list[str] = []
) -> DataFrame:
    """Mean and sd over the distinct values, not over rows."""
    rows = df if cond is None else df.where(cond)
    return mean_sd(rows.select(*by, column).distinct(), column, by)


def mean_sd(df: DataFrame, column: str, by: list[str] = [], na_rm: bool = False) -> DataFrame:
    return df.groupBy(*by).agg(
        strict_mean(column, na_rm).alias("mean"), strict_sd(column, na_rm).alias("sd")
    )


def max_value(df: DataFrame, column: str, by: list[str] = [], na_rm: bool = False) -> DataFrame:
    return df.groupBy(*by).agg(strict_max(column, na_rm).alias("max"))


def reaching(column: str, num: int, den: int) -> Column:
    """Count of values at or above the whole percentage ``num / den``."""
    return F.count_if(F.col(column) >= float(round(num / den * 100)))


def n_reaching(df: DataFrame, column: str, num: int, den: int, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(reaching(column, num, den).alias("n"))


def ci_half_width(df: DataFrame, column: str, z: float = Z_ONE_SIDED_95, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(half_width(column, z).alias("CI90"))


def half_width(column: str, z: float = Z_ONE_SIDED_95) -> Column:
    return F.lit(z) * strict_sd(column) / F.sqrt(F.count(F.lit(1)))


# --- t tests and Bayes factors ----------------------------------------------


@dataclass(frozen=True)
class Test:
    """One test of a plan; its t test and its Bayes factor come from the same moments.

    * ``column`` alone, or less ``minus`` row by row: one sample against ``mu``.
    * ``column`` against the column ``other``, or with ``group`` the rows labelled ``labels[0]``
      against those labelled ``labels[1]``: two samples, whose difference is tested against ``mu``.

    ``where`` restricts the rows.  Missing values are left out.
    """

    name: str
    column: str
    minus: str | None = None
    other: str | None = None
    group: str | None = None
    labels: tuple = ()
    where: Column | None = None
    mu: float = 0.0
    alternative: str = "greater"
    conf: float = 0.9
    r: float = MEDIUM_PRIOR

    def samples(self) -> list[Column]:
        if self.alternative not in ("greater", "less", "two.sided"):
            raise ValueError(f"unknown alternative: {self.alternative}")
        x = F.col(self.column)
        if self.minus:
            pair = [x - F.col(self.minus)]
        elif self.group:
            pair = [F.when(F.col(self.group) == F.lit(label), x) for label in self.labels]
        else:
            pair = [x] if self.other is None else [x, F.col(self.other)]
        return pair if self.where is None else [F.when(self.where, c) for c in pair]


def run_tests(df: DataFrame, tests: list[Test], by: list[str] = [], only: str | None = None) -> DataFrame:
    """All ``tests`` in every group from one aggregate over one scan; a row for each test and group.

    Each distinct sample (column, pair or label under a condition) is aggregated once, combined
    on the map side; tails, quantiles and integrals are computed on one row for each test.
    Returns ``test``, ``n``, ``mean`` and ``sd`` of the first sample (``n2``, ``mean2``, ``sd2`` of the second, else
    null), ``t``, ``df`` (Welch's for two samples), ``p_value``, ``ci_low``, ``ci_high`` of the tested mean or
    difference, and ``bf_t``, ``log_bf10``, ``bf10`` (pooled variance for two samples).  ``only``
    leaves out the columns of the other kind: "t" or "bf".
    """
    aggregates: dict[str, Column] = {}

    def moments(x: Column) -> str:
        key = str(x)
        if key not in aggregates:
            aggregates[key] = F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias(f"_m{len(aggregates)}")
        return f"_m{list(aggregates).index(key)}"

    none = F.lit(None).cast("struct<n:bigint,mean:double,sd:double>")
    rows = []
    for test in tests:
        first, *second = [F.col(moments(x)) for x in test.samples()]
        rows.append(F.struct(
            F.lit(test.name).alias("test"), first.alias("_a"), (second[0] if second else none).alias("_b"), F.lit(float(test.mu)).alias("_mu"),
            F.lit(test.alternative).alias("_alternative"), F.lit(float(test.conf)).alias("_conf"), F.lit(float(test.r)).alias("_r"),
        ))
    wide = df.groupBy(*by).agg(*aggregates.values())
    return _tested(wide.select(*by, F.inline(F.array(*rows))), by, only)


def _tested(m: DataFrame, by: list[str], only: str | None) -> DataFrame:
    """The columns of :func:`run_tests` from one row of moments and parameters for each test."""
    m = m.select("*", *[F.col(f"_a.{c}").alias(c) for c in ("n", "mean", "sd")], *[F.col(f"_b.{c}").alias(f"{c}2") for c in ("n", "mean", "sd")])
    single = F.col("_b").isNull()
    n1, n2 = F.col("n").cast("double"), F.col("n2").cast("double")  # their product outgrows a bigint
    v1, v2 = F.col("sd") ** 2 / n1, F.col("sd2") ** 2 / n2
    both = (n1 > 1) & (n2 > 1)
    se = F.when(single, F.col("sd") / F.sqrt(n1)).when(both, F.sqrt(v1 + v2))
    dof = F.when(single, n1 - 1).when(both, F.try_divide((v1 + v2) ** 2, v1**2 / (n1 - 1) + v2**2 / (n2 - 1)))
    centre = F.when(single, F.col("mean")).otherwise(F.col("mean") - F.col("mean2"))
    pooled_dof = n1 + n2 - 2
    n_eff = F.when(single, n1).otherwise(F.try_divide(n1 * n2, n1 + n2))
    pooled = F.try_divide((n1 - 1) * F.col("sd") ** 2 + (n2 - 1) * F.col("sd2") ** 2, pooled_dof)
    bayes_se = F.when(single, F.col("sd") / F.sqrt(n1)).when(both, F.sqrt(pooled / n_eff))
    m = m.withColumns({"df": dof, "_centre": centre, "_se": se, "_n_eff": n_eff, "_bayes_df": F.when(single, n1 - 1).otherwise(pooled_dof), "_bayes_se": bayes_se})
    m = m.withColumns({"t": F.try_divide(F.col("_centre") - F.col("_mu"), F.col("_se")), "bf_t": F.try_divide(F.col("_centre") - F.col("_mu"), F.col("_bayes_se"))})

    out = [*by, "test", "n", "mean", "sd", "n2", "mean2", "sd2"]
    if only != "bf":
        m = _with_t_columns(m)
        out += ["t", "df", "p_value", "ci_low", "ci_high"]
    if only != "t":
        bayes = F.col("bf_t").isNotNull() & ~F.isnan("bf_t") & (F.col("_bayes_df") > 0)
        log_bf = log_bayes_factor(F.col("bf_t"), F.col("_n_eff"), F.col("_bayes_df"), F.col("_r"))
        m = m.withColumn("log_bf10", F.when(bayes, log_bf)).withColumn("bf10", F.exp("log_bf10"))
        out += ["bf_t", "log_bf10", "bf10"]
    return m.select(*out)


def _with_t_columns(m: DataFrame) -> DataFrame:
    t, two, less = F.col("t"), F.col("_alternative") == "two.sided", F.col("_alternative") == "less"
    testable = t.isNotNull() & ~F.isnan(t) & (F.col("df") > 0)
    # "less" takes the tail of -t: 1 - tail loses small tails.
    tail = t_upper_tail(F.when(less, -t).when(two, F.abs(t)).otherwise(t), F.col("df"))
    q = t_quantile((1 - F.col("_conf")) / F.when(two, 2.0).otherwise(1.0), F.col("df"))
    m = m.withColumns({"_tail": F.when(testable, tail), "_reach": F.when(testable, q) * F.col("_se")})
    infinity = F.lit(float("inf"))
    return m.withColumns({
        "p_value": F.col("_tail") * F.when(two, 2.0).otherwise(1.0),
        "ci_low": F.when(testable & less, -infinity).otherwise(F.col("_centre") - F.col("_reach")),
        "ci_high": F.when(testable & ~less & ~two, infinity).otherwise(F.col("_centre") + F.col("_reach")),
    })


def _as_list(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def t_test_one(
    df: DataFrame, columns: str | list[str], mu: float = 0.0, alternative: str = "greater",
    conf: float = 0.9, by: list[str] = [],
) -> DataFrame:
    """One-sample t test of every listed column in every group; missing values are left out."""
    tests = [Test(c, c, mu=mu, alternative=alternative, conf=conf) for c in _as_list(columns)]
    out = run_tests(df, tests, by, "t").withColumnRenamed("test", "variable")
    return out.select(*by, "variable", "n", "mean", "sd", "t", "df", "p_value", "ci_low", "ci_high")


def _welch(df: DataFrame, test: Test, by: list[str]) -> DataFrame:
    names = {"n": "n1", "mean": "mean1"}
    out = run_tests(df, [test], by, "t").withColumnsRenamed(names)
    return out.select(*by, "n1", "n2", "mean1", "mean2", "t", "df", "p_value", "ci_low", "ci_high")


def t_test_welch(
    df: DataFrame, column: str, group: str, labels: tuple, alternative: str = "two.sided",
    conf: float = 0.95, by: list[str] = [],
) -> DataFrame:
    """Two-sample t test with unequal variances of the first label against the second."""
    return _welch(df, Test("", column, group=group, labels=labels, alternative=alternative, conf=conf), by)


def t_test_welch_columns(
    df: DataFrame, a: str, b: str, alternative: str = "two.sided", conf: float = 0.95, by: list[str] = []
) -> DataFrame:
    """The same test with the two samples in two columns, taken as unpaired."""
    return _welch(df, Test("", a, other=b, alternative=alternative, conf=conf), by)


def bf_one_sample(
    df: DataFrame, columns: str | list[str], mu: float = 0.0, r: float = MEDIUM_PRIOR, by: list[str] = []
) -> DataFrame:
    """JZS Bayes factor of every listed column against ``mu`` in every group."""
    out = run_tests(df, [Test(c, c, mu=mu, r=r) for c in _as_list(columns)], by, "bf")
    return out.select(*by, F.col("test").alias("variable"), "n", F.col("bf_t").alias("t"), "bf10", "log_bf10")


def bf_paired(
    df: DataFrame, a: str, b: str, mu: float = 0.0, r: float = MEDIUM_PRIOR, by: list[str] = []
) -> DataFrame:
    """JZS Bayes factor of the row-wise difference of two columns."""
    out = run_tests(df, [Test("", a, minus=b, mu=mu, r=r)], by, "bf")
    return out.select(*by, "n", F.col("bf_t").alias("t"), "bf10", "log_bf10")


def bf_two_sample(
    df: DataFrame, column: str, group: str, labels: tuple, r: float = MEDIUM_PRIOR, by: list[str] = []
) -> DataFrame:
    """JZS Bayes factor of two independent samples with pooled variance."""
    out = run_tests(df, [Test("", column, group=group, labels=labels, r=r)], by, "bf")
    return out.select(*by, F.col("n").alias("n1"), "n2", F.col("bf_t").alias("t"), "bf10", "log_bf10")


# --- rank test --------------------------------------------------------------


def signed_rank(
    df: DataFrame, column: str, mu: float = 0.0, alternative: str = "greater", conf: float = 0.95,
    by: list[str] = [], exact: bool | None = None, exact_below: int = 50,
) -> DataFrame:
    """Wilcoxon signed-rank test against ``mu``; missing and infinite values are left out.

    Zero differences are dropped for the test.  With ``exact`` None, the null distribution is
    exact for fewer than ``exact_below`` observations without ties or zeros, else normal with
    continuity and tie correction; True asks for the exact one wherever there are no ties
    or zeros, False for the normal one.

    ``estimate`` and the bound are where the statistic of the values less ``estimate`` (or the bound)
    crosses its centre (or its critical value).  Between two pairwise means, the statistic of the
    normal test depends on the number of pairwise means above alone, so the crossings are pairwise
    means of all values, zeros included, at known positions; the estimate is their median
    (Hodges-Lehmann).  Without variation there is no bound.
    """
    if alternative not in ("greater", "less"):
        raise ValueError(f"unknown alternative: {alternative}")
    if not by:
        whole = df.withColumn("_all", F.lit(1))
        return signed_rank(whole, column, mu, alternative, conf, ["_all"], exact, exact_below).drop("_all")
    return signed_rank_of_values(materialize(value_counts(df, column, by)), mu, alternative, conf, by, exact, exact_below)


def signed_rank_of_values(
    counts: DataFrame, mu: float, alternative: str, conf: float, by: list[str], exact: bool | None = None, exact_below: int = 50
) -> DataFrame:
    """The test from distinct values ``x`` and counts ``n``, as of :func:`~.ranks.value_counts`, in groups of any size.

    Mid-ranks are running sums over the sizes of the differences; pairwise means are selected by
    counting, see :func:`~.ranks.pairwise_means_at`.
    """
    d = F.col("x") - F.lit(float(mu))
    sizes = counts.where(d != 0).groupBy(*by, F.abs(d).alias("_size")).agg(
        F.sum("n").alias("_ties"), F.sum(F.when(d > 0, F.col("n")).otherwise(0.0)).alias("_positive")
    )
    rank = F.col("_cum") - F.col("_ties") + (F.col("_ties") + 1) / 2.0
    ranked = running_sum(sizes, by, "_size", "_ties", "_cum").groupBy(*by).agg(
        F.sum("_ties").alias("n"), F.sum(F.col("_positive") * rank).alias("v"), F.sum(F.pow(F.col("_ties"), 3) - F.col("_ties")).alias("tie_sum")
    )
    whole = counts.groupBy(*by).agg(
        F.sum("n").alias("_weight"), F.sum(F.when(d == 0, F.col("n")).otherwise(0.0)).alias("zeros"),
        F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("_same"),
        F.min(F.struct("x", "n")).alias("_first"), F.max(F.struct("x", "n")).alias("_last"),
    )
    joined = join_per_key(whole, ranked, by, "left").fillna(0.0, subset=["n", "v", "tie_sum"])
    n, greater = F.col("n"), alternative == "greater"
    shift = 0.5 if greater else -0.5

    def spread(count: Column, ties: Column) -> Column:
        return F.sqrt(count * (count + 1) * (2 * count + 1) / 24.0 - ties / 48.0)

    joined = joined.withColumns({
        "exact": (F.col("tie_sum") == 0) & (F.col("zeros") == 0) & _exact_size(n, exact, exact_below),
        "z": F.try_divide(F.col("v") - n * (n + 1) / 4.0 - shift, spread(n, F.col("tie_sum"))),
    })
    joined = joined.withColumn("_null", F.when(F.col("exact"), signed_rank_counts(n)))
    joined = joined.withColumn("p_value", F.when(F.col("exact"), _exact_tail(n, F.col("v"), greater)).otherwise(normal_upper_tail(F.col("z") if greater else -F.col("z"))))

    pairs = F.col("_weight") * (F.col("_weight") + 1) / 2
    critical = _normal_quantile(1 - conf) * (1 if greater else -1)
    # Pairwise means that must lie above the bound, so that the statistic there reaches its critical value.
    above = F.ceil(pairs / 2 + shift + critical * spread(F.col("_weight"), F.col("_same"))).cast("double")
    reach = _exact_reach(n, 1 - conf)
    exact_k = reach if greater else pairs + 1 - reach
    k = F.greatest(F.lit(1.0), F.least(pairs, F.when(F.col("exact"), exact_k).otherwise(pairs + 1 - above)))
    joined = joined.withColumn("ks", F.array(F.floor((pairs + 1) / 2).cast("double"), F.ceil((pairs + 1) / 2).cast("double"), k.cast("double")))
    joined = pairwise_means_at(counts, joined, by)

    # At the smallest value (or the largest) the statistic may still be short of its critical value.
    def at_end(end: str) -> Column:
        rest = F.col("_weight") - F.col(f"{end}.n")
        ties = F.col("_same") - (F.pow(F.col(f"{end}.n"), 3) - F.col(f"{end}.n"))
        sign = 1 if end == "_first" else -1
        return F.try_divide(sign * rest * (rest + 1) / 4 - shift, spread(rest, ties))

    lowest, highest = at_end("_first"), at_end("_last")
    bound = (
        F.when(F.col("exact"), F.col("means")[2])
        .when(F.col("_first.x") == F.col("_last.x"), F.lit(None))
        .when(lowest <= critical, F.col("_first.x")).when(highest >= critical, F.col("_last.x"))
        .otherwise(F.col("means")[2])
    )
    infinity = F.lit(float("inf"))
    joined = joined.withColumns({
        "estimate": (F.col("means")[0] + F.col("means")[1]) / 2,
        "ci_low": bound if greater else -infinity,
        "ci_high": infinity if greater else bound,
    })
    counted = [F.col(c).cast("long").alias(c) for c in ("n", "zeros")]
    return joined.select(*by, *counted, "v", "tie_sum", "z", "p_value", "estimate", "ci_low", "ci_high")


def _exact_tail(n: Column, v: Column, upper: bool) -> Column:
    """Share of the exact null distribution, counted in ``_null``, at or beyond ``v``."""
    beyond = lambda c, s: F.when(s >= v if upper else s <= v, c).otherwise(0.0)
    return F.aggregate(F.transform(F.col("_null"), beyond), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)


def _exact_reach(n: Column, tail: float) -> Column:
    """Smallest sum whose lower tail in ``_null`` reaches the level."""
    return F.aggregate(
        F.col("_null"),
        F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("below")),
        lambda s, c: F.struct(
            (s["cum"] + c).alias("cum"),
            (s["below"] + F.when(s["cum"] + c < tail * F.pow(F.lit(2.0), n), 1).otherwise(0)).alias("below"),
        ),
        lambda s: s["below"],
    )


def _exact_size(n: Column, exact: bool | None, below: int) -> Column:
    return F.lit(exact) if exact is not None else n < below


def _normal_quantile(upper: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - upper)
