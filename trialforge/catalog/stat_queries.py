"""Queries for aggregates and grouped tests.

The SQL computes tails and quantiles by other routes than the library (other
grids, bisection, all pairwise means), so agreement is not built in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.event_trials import TEST, event_trials
from .choice_queries import OVERVIEW, overview
from .registry import query, rounded
from .report_queries import accuracies

_BY = ["experiment_no"]

_ACC = """
    acc AS (SELECT experiment_no, condition, unique_id, phase, round_even(AVG(correct) * 100, 0) AS accuracy
            FROM trials GROUP BY ALL),
    ta AS (SELECT * FROM acc WHERE phase = 'CfuncTest')
"""


def tests(spark, d):
    return accuracies(spark, d).where(F.col("phase") == TEST)


# --- SQL for distribution functions -----------------------------------------


def t_tail_sql(t: str, df: str) -> str:
    """Upper tail by Simpson's rule over 3,000 intervals of the angle up to pi / 2."""
    steps = 3000

    def area(start: str) -> str:
        x = f"({start} + i * (PI() / 2 - {start}) / {steps})"
        weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        terms = f"LAMBDA i: {weight} * POW(GREATEST(COS({x}), 0), {df} - 1)"
        return f"LIST_SUM(LIST_TRANSFORM(RANGE(0, {steps + 1}), {terms})) * (PI() / 2 - {start})"

    half = f"({area(f'ATAN(ABS({t}) / SQRT({df}))')}) / (2 * ({area('0')}))"
    return f"CASE WHEN {t} >= 0 THEN {half} ELSE 1 - {half} END"


def normal_tail_sql(z: str) -> str:
    cells = 20000
    area = (
        f"LIST_SUM(LIST_TRANSFORM(RANGE(0, {cells}), LAMBDA i: EXP(-POW((i + 0.5) * ABS({z}) / {cells}, 2) / 2)))"
        f" * ABS({z}) / {cells} / SQRT(2 * PI())"
    )
    return f"CASE WHEN {z} >= 0 THEN 0.5 - {area} ELSE 0.5 + {area} END"


def bayes_sql(t: str, n: str, df: str) -> str:
    """Natural log of the Bayes factor, integrated over the prior variance itself on 2,000 log cells."""
    h = 37.0 / 2000
    g = f"EXP(-12 + {h} * i)"
    term = (
        f"POW(1 + {n} * {g} * 0.5, -0.5) * POW(1 + {t} * {t} / ((1 + {n} * {g} * 0.5) * {df}), -({df} + 1) / 2.0)"
        f" * POW(2 * PI(), -0.5) * POW({g}, -1.5) * EXP(-1 / (2 * {g})) * {g} * {h}"
    )
    marginal = f"LIST_SUM(LIST_TRANSFORM(RANGE(0, 2001), LAMBDA i: {term}))"
    return f"LN({marginal} / POW(1 + {t} * {t} / {df}, -({df} + 1) / 2.0))"


def quantile_cte(source: str, key: str, upper: float) -> str:
    """CTEs bi and qu(key, q): t value with the given upper tail, by bisection."""
    return f"""
    bi AS (SELECT {key} AS k, df, 0::DOUBLE AS lo, 60::DOUBLE AS hi, 0 AS step FROM {source}
           UNION ALL
           SELECT k, df, CASE WHEN p > {upper} THEN mid ELSE lo END, CASE WHEN p > {upper} THEN hi ELSE mid END, step + 1
           FROM (SELECT k, df, lo, hi, step, (lo + hi) / 2 AS mid, {t_tail_sql("((lo + hi) / 2)", "df")} AS p FROM bi WHERE step < 50)),
    qu AS (SELECT k, (lo + hi) / 2 AS q FROM bi WHERE step = 50)"""


# --- counts and moments -----------------------------------------------------


@query("K1_count_where", "SELECT condition, COUNT(*) FILTER (remaining = 0) AS n FROM trials GROUP BY condition")
def k1(spark, d):
    return stats.count_where(event_trials(spark, d), F.col("remaining") == 0, ["condition"])


@query(
    "K2_count_distinct_where",
    """
    SELECT condition, COUNT(DISTINCT CASE WHEN gender = 'female' THEN x_2 END)
      + MAX(CASE WHEN gender = 'female' AND x_2 IS NULL THEN 1 ELSE 0 END) AS n FROM trials GROUP BY condition
    """,
)
def k2(spark, d):
    return stats.count_distinct_where(
        event_trials(spark, d), "x_2", F.col("gender") == "female", ["condition"], count_null=True
    )


@query(
    "K3_distinct_value_stats",
    """
    SELECT ROUND(AVG(DISTINCT age), 6) AS mean,
           ROUND((SELECT STDDEV_SAMP(age) FROM (SELECT DISTINCT age FROM trials WHERE phase = 'CfuncTest')), 6) AS sd
    FROM trials WHERE phase = 'CfuncTest'
    """,
)
def k3(spark, d):
    out = stats.distinct_value_stats(event_trials(spark, d), "age", F.col("phase") == TEST)
    return rounded(out, "mean", "sd")


@query(
    "K4_mean_sd",
    """
    SELECT phase, ROUND(AVG(duration), 6) AS mean, ROUND(STDDEV_SAMP(duration), 6) AS sd FROM trials GROUP BY phase
    """,
)
def k4(spark, d):
    return rounded(stats.mean_sd(event_trials(spark, d), "duration", ["phase"]), "mean", "sd")


@query(
    "K5_max_value",
    "SELECT phase, MAX(duration) AS max FROM trials GROUP BY phase",
)
def k5(spark, d):
    return stats.max_value(event_trials(spark, d), "duration", ["phase"])


@query(
    "K7_n_reaching",
    f"{_ACC} SELECT experiment_no, phase, COUNT(*) FILTER (accuracy >= 83) AS n FROM acc GROUP BY ALL",
)
def k7(spark, d):
    return stats.n_reaching(accuracies(spark, d), "accuracy", 50, 60, ["experiment_no", "phase"])


# --- tests ------------------------------------------------------------------

_L1 = ["mean", "sd", "t", "df", "p_value", "ci_low", "ci_high"]


def _one_sample_sql(source: str, mu: float, upper: float = 0.1) -> str:
    return f"""{_ACC},
    mo AS (SELECT experiment_no, COUNT(accuracy) AS n, AVG(accuracy) AS mean, STDDEV_SAMP(accuracy) AS sd,
                  (AVG(accuracy) - {mu}) / (STDDEV_SAMP(accuracy) / SQRT(COUNT(accuracy))) AS t,
                  COUNT(accuracy) - 1.0::DOUBLE AS df FROM {source} GROUP BY experiment_no),
    {quantile_cte("mo", "experiment_no", upper)}
    SELECT experiment_no, 'accuracy' AS variable, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, ROUND(t, 6) AS t, df,
      ROUND({t_tail_sql("t", "df")}, 6) AS p_value, ROUND(mean - q * sd / SQRT(n), 6) AS ci_low,
      'Infinity'::DOUBLE AS ci_high
    FROM mo JOIN qu ON k = experiment_no
    """


@query("L1_t_test_one", _one_sample_sql("ta", 68))
def l1(spark, d):
    return rounded(stats.t_test_one(tests(spark, d), "accuracy", 68, by=_BY), *_L1)


_WELCH_SQL = """
    we AS (SELECT *, (mean1 - mean2) / SQRT(v1 + v2) AS t,
                  POW(v1 + v2, 2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) AS df FROM two)
"""
_WELCH_COLUMNS = "n1, n2, ROUND(mean1, 6) AS mean1, ROUND(mean2, 6) AS mean2, ROUND(t, 6) AS t, ROUND(df, 6) AS df"
_L2 = ["mean1", "mean2", "t", "df", "p_value", "ci_low", "ci_high"]


@query(
    "L2_t_test_welch",
    f"""{_ACC},
    two AS (SELECT experiment_no, COUNT(*) FILTER (condition = '1') AS n1, COUNT(*) FILTER (condition = '2') AS n2,
              AVG(accuracy) FILTER (condition = '1') AS mean1, AVG(accuracy) FILTER (condition = '2') AS mean2,
              VAR_SAMP(accuracy) FILTER (condition = '1') / COUNT(*) FILTER (condition = '1') AS v1,
              VAR_SAMP(accuracy) FILTER (condition = '2') / COUNT(*) FILTER (condition = '2') AS v2
            FROM ta GROUP BY experiment_no),
    {_WELCH_SQL}, {quantile_cte("we", "experiment_no", 0.025)}
    SELECT experiment_no, {_WELCH_COLUMNS}, ROUND(2 * ({t_tail_sql("ABS(t)", "df")}), 6) AS p_value,
      ROUND(mean1 - mean2 - q * SQRT(v1 + v2), 6) AS ci_low, ROUND(mean1 - mean2 + q * SQRT(v1 + v2), 6) AS ci_high
    FROM we JOIN qu ON k = experiment_no
    """,
)
def l2(spark, d):
    return rounded(stats.t_test_welch(tests(spark, d), "accuracy", "condition", ("1", "2"), by=_BY), *_L2)


@query(
    "L2_t_test_welch_columns",
    f"""{OVERVIEW},
    two AS (SELECT experiment_no, COUNT(*) AS n1, COUNT(*) AS n2, AVG(countPointGap_CfuncTest) AS mean1,
              AVG(countBubbleGap_CfuncTest) AS mean2, VAR_SAMP(countPointGap_CfuncTest) / COUNT(*) AS v1,
              VAR_SAMP(countBubbleGap_CfuncTest) / COUNT(*) AS v2 FROM overview GROUP BY experiment_no),
    {_WELCH_SQL}, {quantile_cte("we", "experiment_no", 0.05)}
    SELECT experiment_no, {_WELCH_COLUMNS}, ROUND(1 - ({t_tail_sql("t", "df")}), 6) AS p_value,
      '-Infinity'::DOUBLE AS ci_low, ROUND(mean1 - mean2 + q * SQRT(v1 + v2), 6) AS ci_high
    FROM we JOIN qu ON k = experiment_no
    """,
)
def l2_columns(spark, d):
    out = stats.t_test_welch_columns(
        overview(spark, d), "countPointGap_CfuncTest", "countBubbleGap_CfuncTest", "less", by=_BY
    )
    return rounded(out, *_L2)


_BF = ["t", "log_bf10"]


@query(
    "L3_bf_one_sample",
    f"""{_ACC},
    mo AS (SELECT experiment_no, COUNT(*) AS n, COUNT(*) - 1 AS df,
             (AVG(accuracy) - 68) / (STDDEV_SAMP(accuracy) / SQRT(COUNT(*))) AS t FROM ta GROUP BY 1)
    SELECT experiment_no, 'accuracy' AS variable, n, ROUND(t, 6) AS t, ROUND({bayes_sql("t", "n", "df")}, 6) AS log_bf10 FROM mo
    """,
)
def l3(spark, d):
    return rounded(stats.bf_one_sample(tests(spark, d), "accuracy", 68, by=_BY), *_BF).drop("bf10")


@query(
    "L4_bf_paired",
    f"""{OVERVIEW},
    mo AS (SELECT experiment_no, COUNT(*) AS n, COUNT(*) - 1 AS df,
             AVG(bubbleReductionBias) / (STDDEV_SAMP(bubbleReductionBias) / SQRT(COUNT(*))) AS t FROM overview GROUP BY 1)
    SELECT experiment_no, n, ROUND(t, 6) AS t, ROUND({bayes_sql("t", "n", "df")}, 6) AS log_bf10 FROM mo
    """,
)
def l4(spark, d):
    out = stats.bf_paired(overview(spark, d), "countPointGap_CfuncTest", "countBubbleGap_CfuncTest", by=_BY)
    return rounded(out, *_BF).drop("bf10")


@query(
    "L5_bf_two_sample",
    f"""{_ACC},
    s AS (SELECT experiment_no, COUNT(*) FILTER (condition = '1') AS n1, COUNT(*) FILTER (condition = '2') AS n2,
              AVG(accuracy) FILTER (condition = '1') - AVG(accuracy) FILTER (condition = '2') AS diff,
              VAR_SAMP(accuracy) FILTER (condition = '1') AS v1, VAR_SAMP(accuracy) FILTER (condition = '2') AS v2
            FROM ta GROUP BY experiment_no),
    mo AS (SELECT *, n1 * n2 / (n1 + n2) AS n, n1 + n2 - 2 AS df,
             diff / SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM s)
    SELECT experiment_no, n1, n2, ROUND(t, 6) AS t, ROUND({bayes_sql("t", "n", "df")}, 6) AS log_bf10 FROM mo
    """,
)
def l5(spark, d):
    out = stats.bf_two_sample(tests(spark, d), "accuracy", "condition", ("1", "2"), by=_BY)
    return rounded(out, *_BF).drop("bf10")


def _ranks_sql(source: str, column: str, mu: float, shift: float, critical: float) -> str:
    """CTEs st (statistics), es (median of the pairwise means), wo (pairwise means, numbered) and ks (place of the bound)."""
    return f"""
    dd AS (SELECT experiment_no, {column} AS x, {column} - {mu} AS d FROM {source}),
    nz AS (SELECT * FROM dd WHERE d <> 0),
    rk AS (SELECT *, RANK() OVER (PARTITION BY experiment_no ORDER BY ABS(d))
                + (COUNT(*) OVER (PARTITION BY experiment_no, ABS(d)) - 1) / 2 AS r FROM nz),
    ti AS (SELECT experiment_no, SUM(c * c * c - c)::DOUBLE AS tie_sum
           FROM (SELECT experiment_no, ABS(d), COUNT(*) AS c FROM nz GROUP BY ALL) GROUP BY 1),
    sa AS (SELECT experiment_no, SUM(c)::DOUBLE AS m, SUM(c * c * c - c)::DOUBLE AS same
           FROM (SELECT experiment_no, x, COUNT(*) AS c FROM dd GROUP BY ALL) GROUP BY 1),
    ze AS (SELECT experiment_no, COUNT(*) FILTER (d = 0) AS zeros FROM dd GROUP BY 1),
    sr AS (SELECT experiment_no, COUNT(*) AS n, SUM(CASE WHEN d > 0 THEN r ELSE 0 END) AS v FROM rk GROUP BY 1),
    st AS (SELECT *, (v - n * (n + 1) / 4 - {shift}) / SQRT(n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48) AS z
           FROM sr JOIN ti USING (experiment_no) JOIN ze USING (experiment_no)),
    nu AS (SELECT experiment_no, x, ROW_NUMBER() OVER (PARTITION BY experiment_no ORDER BY x) AS i FROM dd),
    wa AS (SELECT a.experiment_no, (a.x + b.x) / 2 AS w FROM nu a JOIN nu b ON a.experiment_no = b.experiment_no AND a.i <= b.i),
    wo AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_no ORDER BY w) AS k FROM wa),
    es AS (SELECT experiment_no, MEDIAN(w) AS estimate FROM wa GROUP BY 1),
    ks AS (SELECT experiment_no, m * (m + 1) / 2 + 1
             - CEIL(m * (m + 1) / 4 + {shift} + {critical} * SQRT(m * (m + 1) * (2 * m + 1) / 24 - same / 48)) AS place FROM sa)"""


@query(
    "L6_signed_rank",
    f"""{_ACC}, {_ranks_sql("ta", "accuracy", 70, 0.5, 1.6448536269514722)}
    SELECT experiment_no, st.n, zeros, v, tie_sum, ROUND(z, 6) AS z, ROUND({normal_tail_sql("z")}, 6) AS p_value,
      estimate, w AS ci_low, 'Infinity'::DOUBLE AS ci_high
    FROM st JOIN es USING (experiment_no) JOIN wo USING (experiment_no) JOIN ks USING (experiment_no) WHERE k = place
    """,
)
def l6(spark, d):
    return rounded(stats.signed_rank(tests(spark, d), "accuracy", 70, by=_BY), "z", "p_value")


@query(
    "L6_signed_rank_continuous",
    f"""s AS (SELECT experiment_no, duration FROM trials WHERE phase = 'CfuncTest'),
    {_ranks_sql("s", "duration", 512.5, -0.5, -1.6448536269514722)}
    SELECT experiment_no, st.n, zeros, v, tie_sum, ROUND(z, 6) AS z, ROUND({normal_tail_sql("(-z)")}, 6) AS p_value,
      ROUND(estimate, 6) AS estimate, '-Infinity'::DOUBLE AS ci_low, ROUND(w, 6) AS ci_high
    FROM st JOIN es USING (experiment_no) JOIN wo USING (experiment_no) JOIN ks USING (experiment_no) WHERE k = place
    """,
)
def l6_continuous(spark, d):
    trials = event_trials(spark, d).where(F.col("phase") == TEST)
    out = stats.signed_rank(trials, "duration", 512.5, "less", by=_BY)
    return rounded(out, "z", "p_value", "estimate", "ci_high")


@query(
    "L7_ci_half_width",
    f"""{_ACC}
    SELECT experiment_no, phase, ROUND(1.6448536269514722 * STDDEV_SAMP(accuracy) / SQRT(COUNT(*)), 6) AS CI90
    FROM acc GROUP BY ALL
    """,
)
def l7(spark, d):
    return rounded(stats.ci_half_width(accuracies(spark, d), "accuracy", by=["experiment_no", "phase"]), "CI90")


@query("L8_subset_test", _one_sample_sql("(SELECT * FROM ta WHERE accuracy >= 66)", 68))
def l8(spark, d):
    passed = tests(spark, d).where("accuracy >= 66")
    return rounded(stats.t_test_one(passed, "accuracy", 68, by=_BY), *_L1)


# --- a block of tests -------------------------------------------------------

_TRAIN_ACC, _TEST_ACC = "accuracy_CfuncMixed", "accuracy_CfuncTest"
_POINTS, _BUBBLES = "countPointGap_CfuncTest", "countBubbleGap_CfuncTest"
# name, column, subtracted column, condition, mu, alternative
_ONE_SAMPLE = [
    row
    for k in range(1, 6)
    for row in (
        (f"training {k}", _TRAIN_ACC, None, f"experiment_no = {k}", 40.0, "greater"),
        (f"test {k}", _TEST_ACC, None, f"experiment_no = {k}", 50.0, "greater"),
        (f"test below {k}", _TEST_ACC, None, f"experiment_no = {k}", 70.0, "less"),
        (f"test of better half {k}", _TEST_ACC, None, f"experiment_no = {k} AND {_TEST_ACC} >= 55", 58.0, "greater"),
        (f"gaps {k}", _POINTS, _BUBBLES, f"experiment_no = {k}", 0.0, "two.sided"),
    )
]
# name, samples as SQL, test
_TWO_SAMPLE = [
    ("gender", (f"CASE WHEN gender = 'female' THEN {_TEST_ACC} END", f"CASE WHEN gender = 'male' THEN {_TEST_ACC} END"),
     {"column": _TEST_ACC, "group": "gender", "labels": ("female", "male")}),
    ("gaps unpaired", (_POINTS, _BUBBLES), {"column": _POINTS, "other": _BUBBLES}),
    ("experiments", (f"CASE WHEN experiment_no = 1 THEN {_TRAIN_ACC} END", f"CASE WHEN experiment_no = 2 THEN {_TRAIN_ACC} END"),
     {"column": _TRAIN_ACC, "group": "experiment_no", "labels": (1, 2)}),
]


def _plan_sql() -> str:
    one = [
        f"""SELECT '{name}' AS test, '{alternative}' AS alternative, 0.9 AS conf, {mu} AS mu, COUNT(x) AS n, AVG(x) AS mean, STDDEV_SAMP(x) AS sd,
              NULL::BIGINT AS n2, NULL::DOUBLE AS mean2, NULL::DOUBLE AS sd2
            FROM (SELECT {column}{" - " + minus if minus else ""} AS x FROM overview WHERE {condition})"""
        for name, column, minus, condition, mu, alternative in _ONE_SAMPLE
    ]
    two = [
        f"""SELECT '{name}', 'two.sided', 0.95, 0, COUNT(a), AVG(a), STDDEV_SAMP(a), COUNT(b), AVG(b), STDDEV_SAMP(b)
            FROM (SELECT {a} AS a, {b} AS b FROM overview)"""
        for name, (a, b), _ in _TWO_SAMPLE
    ]
    return f"""{OVERVIEW},
    mo AS ({" UNION ALL ".join([*one, *two])}),
    ve AS (SELECT *, sd * sd / n AS v1, sd2 * sd2 / n2 AS v2, mean - coalesce(mean2, 0) AS centre, coalesce(n * n2 / (n + n2), n) AS neff,
             coalesce(n + n2 - 2, n - 1) AS bdf, sqrt(((n - 1) * sd * sd + coalesce((n2 - 1) * sd2 * sd2, 0)) / coalesce(n + n2 - 2, n - 1)) AS pooled FROM mo),
    te AS (SELECT *, (centre - mu) / SQRT(v1 + coalesce(v2, 0)) AS t, (centre - mu) / (pooled / SQRT(neff)) AS bt,
             coalesce(POW(v1 + v2, 2) / (v1 * v1 / (n - 1) + v2 * v2 / (n2 - 1)), n - 1)::DOUBLE AS df FROM ve),
    {quantile_cte("te", "test || '/' || alternative", "(CASE WHEN k LIKE '%/two.sided' THEN CASE WHEN k LIKE 'gaps _/%' THEN 0.05 ELSE 0.025 END ELSE 0.1 END)")}
    SELECT test, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, n2, ROUND(mean2, 6) AS mean2, ROUND(sd2, 6) AS sd2, ROUND(t, 6) AS t, ROUND(df, 6) AS df,
      ROUND(CASE alternative WHEN 'greater' THEN {t_tail_sql("t", "df")} WHEN 'less' THEN {t_tail_sql("(-t)", "df")}
                 ELSE 2 * ({t_tail_sql("ABS(t)", "df")}) END, 6) AS p_value,
      CASE WHEN alternative = 'less' THEN '-Infinity'::DOUBLE ELSE ROUND(centre - q * SQRT(v1 + coalesce(v2, 0)), 6) END AS ci_low,
      CASE WHEN alternative = 'greater' THEN 'Infinity'::DOUBLE ELSE ROUND(centre + q * SQRT(v1 + coalesce(v2, 0)), 6) END AS ci_high,
      ROUND(bt, 6) AS bf_t, ROUND({bayes_sql("bt", "neff", "bdf")}, 6) AS log_bf10
    FROM te JOIN qu ON k = test || '/' || alternative
    """


@query("L8_test_plan", _plan_sql())
def l8_plan(spark, d):
    """28 t tests with their Bayes factors from one aggregate over one scan of the participants."""
    tests_ = [
        stats.Test(name, column, minus=minus, where=F.expr(condition), mu=mu, alternative=alternative)
        for name, column, minus, condition, mu, alternative in _ONE_SAMPLE
    ]
    tests_ += [stats.Test(name, alternative="two.sided", conf=0.95, **test) for name, _, test in _TWO_SAMPLE]
    out = stats.run_tests(overview(spark, d), tests_).drop("bf10")
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])
