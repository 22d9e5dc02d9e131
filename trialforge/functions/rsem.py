"""Missing-value and rounding rules shared by every operator.

Statistical scripts treat a missing value as contagious, round halves to even
and sort missing values last.  Spark does none of these by default, so each
rule has one small helper here and operators never spell it out themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED = "passed"
FAILED = "failed"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x: str | Column, scale: int = 0) -> Column:
    """Round half to even: 0.5 -> 0, 1.5 -> 2, 2.5 -> 2."""
    return F.bround(col(x), scale)


def percent(x: str | Column) -> Column:
    """A proportion as a whole percentage."""
    return half_even(col(x) * 100)


def _strict(agg: Column, x: Column, na_rm: bool) -> Column:
    if na_rm:
        return agg
    return F.when(F.count(F.lit(1)) == F.count(x), agg)


def strict_mean(x: str | Column, na_rm: bool = False) -> Column:
    """Mean that is null as soon as one input is null."""
    return _strict(F.avg(col(x)), col(x), na_rm)


#: Doubles are summed exactly at this scale, as decimals, up to MOST_EXACT in size.
EXACT_SCALE = 9
MOST_EXACT = 1e18


def exact_parts(x: str | Column, name: str) -> dict[str, Column]:
    """Aggregates for :func:`half_even_ratio`: the exact sum of a column and what can't be summed exactly.

    A sum of doubles depends on the order of its rows, so a mean that is a half in one run may miss it in
    another.  Sums of decimals don't.  Values beyond 1e18, infinite and NaN go to a plain sum.
    """
    x = col(x).cast("double")
    fits = F.coalesce(F.abs(x) < MOST_EXACT, F.lit(True))  # NaN sorts above all numbers
    decimal = F.when(fits, x).cast(f"decimal(28,{EXACT_SCALE})")
    return {name: F.sum(decimal), f"{name}_rest": F.sum(F.when(~fits, x))}


def half_even_ratio(total: Column, rest: Column, n: Column) -> Column:
    """``total / n`` rounded half to even, by whole division and its remainder; ``rest`` as of :func:`exact_parts`."""
    n = n.cast("decimal(20,0)")
    whole = F.call_function("div", total, n)
    twice = F.abs(total % n) * 2
    up = (twice > n) | ((twice == n) & (whole % 2 != 0))
    exact = (whole + F.when(up, F.signum(total).cast("long")).otherwise(F.lit(0).cast("long"))).cast("double")
    plain = half_even((F.coalesce(total.cast("double"), F.lit(0.0)) + rest) / n.cast("double"))
    return F.when(rest.isNull(), exact).otherwise(plain)


def half_even_mean(x: str | Column) -> Column:
    """Mean rounded half to even, the same for every order of the rows; null as soon as one input is null."""
    total, rest = exact_parts(x, "s").values()
    return F.when(F.count(F.lit(1)) == F.count(col(x)), half_even_ratio(total, rest, F.count(F.lit(1))))


def strict_sum(x: str | Column, na_rm: bool = False) -> Column:
    return _strict(F.sum(col(x)), col(x), na_rm)


def strict_max(x: str | Column, na_rm: bool = False) -> Column:
    return _strict(F.max(col(x)), col(x), na_rm)


def strict_sd(x: str | Column, na_rm: bool = False) -> Column:
    """Sample standard deviation; null for a single value."""
    return _strict(F.stddev_samp(col(x)), col(x), na_rm)


def is_in(x: str | Column, values) -> Column:
    """Membership that is never null."""
    values = list(values)
    if not values:
        return F.lit(False)
    return F.coalesce(col(x).isin(*values), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that keeps a missing condition missing."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def pass_label(cond: Column) -> Column:
    return if_else(cond, F.lit(PASSED), F.lit(FAILED))


def succeeded(remaining: str | Column) -> Column:
    """Indexing by a missing comparison keeps the row, so missing counts as success."""
    r = col(remaining)
    return r.isNull() | (r == 0)


def count_distinct(x: str | Column, where: Column | None = None, count_null: bool = False) -> Column:
    """Distinct count under an optional condition, optionally with null as one more value."""
    x = col(x)
    kept = x if where is None else F.when(where, x)
    n = F.count_distinct(kept)
    if not count_null:
        return n
    missing = x.isNull() if where is None else (x.isNull() & where)
    return n + F.coalesce(F.max(F.when(missing, 1).otherwise(0)), F.lit(0))


def to_int(x: str | Column) -> Column:
    """Truncating lenient cast: '7.9' -> 7, 'n/a' -> null."""
    return col(x).cast("string").try_cast("double").try_cast("int")


def share(part: str | Column, whole: str | Column) -> Column:
    """Division that gives null instead of failing on a zero divisor."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def row_sum(cols) -> Column:
    """Row-wise sum; null if any addend is null."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def ascending(*cols: str | Column) -> list[Column]:
    return [col(c).asc_nulls_last() for c in cols]


def descending(*cols: str | Column) -> list[Column]:
    return [col(c).desc_nulls_last() for c in cols]


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
