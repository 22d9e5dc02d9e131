"""Distribution functions as column expressions, for one row per tested group.

Integrals use fixed grids inside ``aggregate(sequence(...))``; they cost the same
for a group of ten and of ten billion observations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = 1000  # Simpson, even
SPAN = 16.0  # standard deviations beyond which a density is taken as zero
MOST_STEPS = 200  # a search ends when it has converged; halving an interval alone takes 60 steps
BAYES_GRID = (-12.0, 25.0, 401)  # log g from, to, points


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _simpson(density: Callable[[Column], Column], lower: Column, upper: Column) -> Column:
    def area(grid: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * density(grid["lower"] + i * grid["h"])

        return F.aggregate(F.sequence(F.lit(0), F.lit(INTERVALS)), F.lit(0.0), step) * grid["h"] / 3

    return once(F.struct(lower.alias("lower"), ((upper - lower) / INTERVALS).alias("h")), area)


def _t_kernel(df: Column) -> Callable[[Column], Column]:
    """Density of atan(t / sqrt(df)) up to a constant: cos(theta) ** (df - 1)."""
    return lambda theta: F.exp(-(df - 1) / 2 * F.log1p(F.pow(F.tan(theta), 2)))


def _t_span(df: Column) -> Column:
    return F.least(F.lit(math.pi / 2), SPAN / F.sqrt(df))


def _t_angle_tail(theta: Column, df: Column) -> Column:
    return _simpson(_t_kernel(df), theta, F.least(F.lit(math.pi / 2), theta + _t_span(df)))


def t_upper_tail(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t with (possibly fractional) degrees of freedom."""
    df = df.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(df))
    tail = _t_angle_tail(theta, df) / (2 * _t_angle_tail(F.lit(0.0), df))
    return F.when(t >= 0, tail).otherwise(1 - tail)


def t_quantile(upper: float | Column, df: Column) -> Column:
    """The t value with the given upper tail, which must be below one half.

    Newton steps on the logarithm of the tail, kept inside an interval that holds the root; a
    step that would leave it halves the interval instead.  The search stops when a step moves
    the angle by less than its precision, so its length follows the distance to the root.
    """
    df = df.cast("double")
    upper = F.lit(upper) if isinstance(upper, float) else upper
    kernel = _t_kernel(df)

    def named(**values: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def compared(s: Column, tail: Column) -> Column:
        """Excess of the tail at the current angle, and the angle that a Newton step leads to."""
        excess = F.log(tail) - s["target"]
        return once(excess, lambda e: named(s=s, excess=e, newton=s["at"] + tail / kernel(s["at"]) * e))

    def bounded(e: Column) -> Column:
        s, over = e["s"], e["excess"] > 0
        return named(s=s, excess=e["excess"], newton=e["newton"], low=F.when(over, s["at"]).otherwise(s["low"]), high=F.when(over, s["high"]).otherwise(s["at"]))

    def moved(e: Column) -> Column:
        new = F.when((e["newton"] > e["low"]) & (e["newton"] < e["high"]), e["newton"]).otherwise((e["low"] + e["high"]) / 2)
        new = F.when(e["excess"] == 0, e["s"]["at"]).otherwise(new)
        return once(new, lambda at: named(target=e["s"]["target"], low=e["low"], high=e["high"], at=at, done=(F.abs(at - e["s"]["at"]) <= 1e-15 * at)))

    def step(s: Column, _: Column) -> Column:
        here = once(_t_angle_tail(s["at"], df), lambda tail: compared(s, tail))
        return F.when(s["done"], s).otherwise(once(once(here, bounded), moved))

    target = F.log(2.0 * upper) + F.log(_t_angle_tail(F.lit(0.0), df))
    start = named(target=target, low=F.lit(0.0), high=F.lit(math.pi / 2), at=F.lit(0.0), done=F.lit(False))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step, lambda s: s["at"])
    return F.sqrt(df) * F.tan(angle)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal."""
    a = F.abs(z)
    tail = _simpson(lambda x: F.exp(-x * x / 2), a, a + SPAN) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def log_bayes_factor(t: Column, n: Column, df: Column, r: float | Column) -> Column:
    """Natural log of the JZS Bayes factor (alternative over null) of a t statistic.

    ``n`` is the effective sample size and ``r`` the scale of the Cauchy prior on the
    effect size.  The prior variance is integrated out on a grid of its logarithm,
    with the largest term taken out so that no group size overflows.
    """
    start, stop, points = BAYES_GRID
    h = (stop - start) / (points - 1)
    n, df, t2 = n.cast("double"), df.cast("double"), t * t

    def log_term(i: Column) -> Column:
        u = start + i * h
        g = F.exp(u)
        scale = 1 + n * g * (r * r)
        return (
            -F.log(scale) / 2
            - (df + 1) / 2 * F.log1p(t2 / (scale * df))
            - u / 2
            - 1 / (2 * g)
            - math.log(2 * math.pi) / 2
        )

    def add(state: Column, x: Column) -> Column:
        """Running log-sum-exp: the largest term so far and the sum relative to it."""
        top = F.greatest(state["top"], x)
        return F.struct(
            top.alias("top"), (state["sum"] * F.exp(state["top"] - top) + F.exp(x - top)).alias("sum")
        )

    terms = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), log_term)
    start_state = F.struct(F.lit(-1e308).alias("top"), F.lit(0.0).alias("sum"))
    log_sum = F.aggregate(terms, start_state, add, lambda s: s["top"] + F.log(s["sum"]))
    return log_sum + math.log(h) + (df + 1) / 2 * F.log1p(t2 / df)


def signed_rank_counts(n: Column) -> Column:
    """Number of subsets of ranks 1..n with each sum 0..n(n+1)/2, as an array of doubles."""
    n = n.cast("double")
    size = (n * (n + 1) / 2 + 1).cast("int")
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def add_rank(counts: Column, rank: Column) -> Column:
        return F.transform(
            counts, lambda c, s: c + F.when(s >= rank, F.element_at(counts, F.greatest(s - rank, F.lit(0)) + 1)).otherwise(0.0)
        )

    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add_rank)
