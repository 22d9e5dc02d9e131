"""Ranks, pairwise means and walks over sorted values of any kind, in groups of any size.

Equal values are counted first.  A group's sorted values are then one run, or, in a group too
large for one task, several runs: the values are sorted over all tasks by group and value, and
each task's part of a group is a run.  What crosses runs is small: sums, ends, thresholds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import hot_group_rows, hot_groups, join_per_key, materialize, null_safe_on, prefixed

RUN_VALUES = 1 << 16  # values that a run of a large group should hold
SECTIONS = 16  # parts that a pass of a selection cuts an interval into


def value_counts(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct finite values ``x`` of each group with their counts ``n``; others are left out."""
    x = F.col(column).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(finite).groupBy(*by, x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    hot = hot_groups(df, keys)
    if hot is None:
        return df, None
    hot = F.broadcast(prefixed(hot, keys, "_g_"))
    is_hot = null_safe_on(keys, "_g_")
    return df.join(hot, is_hot, "left_anti"), df.join(hot, is_hot, "left_semi")


def _in_runs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` sorted over all tasks by key and order, with the number ``_run`` of each row's task."""
    rows = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / min(RUN_VALUES, hot_group_rows(df))))
    return materialize(df.repartitionByRange(parts, *keys, order).withColumn("_run", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to each row; ``order`` must be unique in a group.

    A large group is summed run by run, and each run is raised by the sums of the runs before it.
    """
    cold, hot = _split_hot(df, keys)
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = cold.withColumn(out, F.sum(value).over(upto))
    if hot is None:
        return summed
    runs = _in_runs(hot, keys, order)
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    sizes = runs.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    sizes = sizes.select(*keys, "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = W.partitionBy(*keys, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    raised = join_per_key(runs.withColumn(out, F.sum(value).over(inside)), sizes, [*keys, "_run"], "inner")
    return summed.unionByName(raised.withColumn(out, F.col(out) + F.col("_before")).select(*summed.columns))


def sorted_runs(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each key as sorted arrays ``x`` and ``n``; keys must be of a size that one task can hold."""
    pairs = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("_p"))
    return pairs.select(*keys, F.col("_p.x").alias("x"), F.col("_p.n").alias("n"))


# --- order statistics of pairwise means -------------------------------------


def cumulated(weights: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(weights)])


def first_above(a: np.ndarray, b: np.ndarray, mean: float) -> np.ndarray:
    """For each of ``a``, the place of the first of sorted ``b`` with which its mean is above ``mean``.

    Means are compared as they are rounded, so that a mean found is counted; where 2 * mean - a
    is rounded across a value, the place is searched with the means themselves.
    """
    at, n = np.searchsorted(b, 2 * mean - a, "right"), len(b)
    low = (at < n) & ((a + b[np.minimum(at, n - 1)]) / 2 <= mean)
    high = (at > 0) & ((a + b[np.maximum(at - 1, 0)]) / 2 > mean)
    wrong = np.flatnonzero(low | high)
    if len(wrong):
        first, last = np.zeros(len(wrong), int), np.full(len(wrong), n)
        for _ in range(n.bit_length()):
            middle = (first + last) // 2
            below = (a[wrong] + b[np.minimum(middle, n - 1)]) / 2 <= mean
            first, last = np.where((first < last) & below, middle + 1, first), np.where((first < last) & ~below, middle, last)
        at[wrong] = first
    return at


def pairs_upto(a: np.ndarray, wa: np.ndarray, b: np.ndarray, upto_b: np.ndarray, means: np.ndarray) -> np.ndarray:
    """For each of ``means``, the weight of pairs (one of ``a``, one of sorted ``b``) with a mean up to it."""
    return np.array([(wa * upto_b[first_above(a, b, t)]).sum() for t in means])


def values_upto(x: np.ndarray, upto: np.ndarray, means: np.ndarray) -> np.ndarray:
    return upto[np.searchsorted(x, means, "right")]


def next_mean(a: np.ndarray, b: np.ndarray, low: float) -> float:
    """The smallest mean of a pair that is above ``low``; infinite if there is none."""
    at = first_above(a, b, low)
    there = at < len(b)
    return float(((a[there] + b[at[there]]) / 2).min(initial=np.inf))


def sections(low: float, high: float, candidate: float = math.inf) -> np.ndarray:
    """Points inside the interval, its upper end, and the candidate if it is inside."""
    points = low + (high - low) * (np.arange(1, SECTIONS) / SECTIONS)
    return np.array(sorted({*(p for p in points.tolist() if low < p < high), high, *([candidate] if low < candidate < high else [])}))


def narrowed(low: float, points: np.ndarray, counts: np.ndarray, k: float) -> tuple[float, float]:
    """The section in which the count reaches ``k``; counts rise with the points."""
    at = min(int(np.searchsorted(counts, k, "left")), len(points) - 1)
    return (float(points[at - 1]) if at else low), float(points[at])


def select_means(x: np.ndarray, n: np.ndarray, ks: list[float]) -> list[float]:
    """The means of pairs i <= j of the values (``x`` sorted, each ``n`` times) at the 1-based positions ``ks``.

    Counts of pairs up to a value narrow an interval (low, high] down; pairs are never listed.
    The smallest mean above ``low`` is the answer once enough pairs are up to it.
    """
    upto, out = cumulated(n), []
    for k in ks:
        low, high = math.nextafter(float(x[0]), -math.inf), float(x[-1])
        while (mean := next_mean(x, x, low)) < high:
            points = sections(low, high, mean)
            low, high = narrowed(low, points, (pairs_upto(x, n, x, upto, points) + values_upto(x, upto, points)) / 2, k)
        out.append(high)
    return out


class RunEnds:
    """First and last value, and weight, of the runs of one large group, in order."""

    def __init__(self, frame: pd.DataFrame):
        self.run, self.first, self.last = (frame[c].to_numpy() for c in ("_run", "first", "last"))
        self.weight = frame["weight"].to_numpy()
        self.upto = cumulated(self.weight)

    def bounds(self, mean: float) -> tuple[float, float]:
        """Pairs i <= j with a mean up to ``mean``: those that must be, and those that may be."""
        sure, possible = (
            ((self.weight * self.upto[first_above(ends, ends, mean)]).sum() + values_upto(ends, self.upto, mean)) / 2 for ends in (self.last, self.first)
        )
        return sure, possible

    def bracket(self, k: float) -> tuple[float, float]:
        """(low, high] with the mean at position ``k``, from the ends alone."""

        def halved(low: float, high: float, falls_short) -> tuple[float, float]:
            while low < (middle := low + (high - low) / 2) < high:
                low, high = (middle, high) if falls_short(middle) else (low, middle)
            return low, high

        low, _ = halved(math.nextafter(float(self.first[0]), -math.inf), float(self.last[-1]), lambda m: self.bounds(m)[1] < k)
        _, high = halved(low, float(self.last[-1]), lambda m: self.bounds(m)[0] < k)
        return low, high

    def open_pairs(self, low: float, high: float) -> tuple[float, list[tuple[int, int]]]:
        """Weight of pairs surely up to ``low``, and the pairs of runs that may have a mean in the interval."""
        sure, possible = first_above(self.last, self.last, low), first_above(self.first, self.first, high)
        pairs = [(int(self.run[i]), int(self.run[j])) for i in range(len(self.run)) for j in range(sure[i], possible[i])]
        return float((self.weight * self.upto[sure]).sum()), pairs

    def values(self, points: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Weight of the runs wholly up to each point, and the runs that a point cuts."""
        whole = np.searchsorted(self.last, points, "right")
        cut = {int(self.run[i]) for i in whole if i < len(self.run)}
        return self.upto[whole], sorted(cut)


def _count_open(runs: DataFrame, work: dict[int, tuple]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One pass for targets (group, low, points, pairs of runs, cut runs).

    Gives for each target the weights of the open pairs and of the cut runs' values up to its
    points, and the next mean above ``low``.
    """
    listed = [(g, a, b, t) for t, (g, _, _, pairs, _) in work.items() for a, b in pairs]
    listed += [(g, a, None, t) for t, (g, *_, cut) in work.items() for a in cut]
    asked = {t: w[1:3] for t, w in work.items()}

    def count(table: pa.Table) -> pa.Table:
        out = {"t": [], "i": [], "pairs": [], "single": [], "next": []}
        for row in table.to_pylist():
            low, points = asked[row["t"]]
            a, na = np.array(row["xa"]), np.array(row["na"])
            pairs, single, following = np.zeros(len(points)), np.zeros(len(points)), math.inf
            if row["xb"] is None:
                # Wholly counted where the point is beyond the run.
                single = np.where(points < a[-1], values_upto(a, cumulated(na), points), 0.0)
            else:
                b = np.array(row["xb"])
                pairs, following = pairs_upto(a, na, b, cumulated(np.array(row["nb"])), points), next_mean(a, b, low)
            out["t"] += [row["t"]] * len(points)
            out["i"] += range(len(points))
            out["pairs"] += pairs.tolist()
            out["single"] += single.tolist()
            out["next"] += [following] * len(points)
        return pa.table(out, pa.schema([("t", pa.int32()), ("i", pa.int32()), ("pairs", pa.float64()), ("single", pa.float64()), ("next", pa.float64())]))

    wanted = runs.sparkSession.createDataFrame(listed, "g int, a int, b int, t int")
    left = runs.select(F.col("_group").alias("g"), F.col("_run").alias("a"), F.col("x").alias("xa"), F.col("n").alias("na"))
    right = runs.select(F.col("_group").alias("g"), F.col("_run").alias("b"), F.col("x").alias("xb"), F.col("n").alias("nb"))
    joined = wanted.join(left, ["g", "a"]).join(right, ["g", "b"], "left")
    # One pair of runs at a time, so that a batch is never more than two runs.
    counted = joined.groupBy("g", "a", "b", "t").applyInArrow(count, "t int, i int, pairs double, single double, next double")
    found = counted.groupBy("t", "i").agg(F.sum("pairs").alias("pairs"), F.sum("single").alias("single"), F.min("next").alias("next")).collect()
    sums = {t: (np.zeros(len(points)), np.zeros(len(points))) for t, (_, points) in asked.items()}
    following = dict.fromkeys(asked, math.inf)
    for r in found:
        sums[r["t"]][0][r["i"]], sums[r["t"]][1][r["i"]] = r["pairs"], r["single"]
        following[r["t"]] = min(following[r["t"]], r["next"])
    return {t: (*sums[t], following[t]) for t in asked}


def _select_in_runs(runs: DataFrame, wanted: dict[int, list[float]]) -> dict[int, list[float]]:
    """:func:`select_means` for large groups, numbered ``_group``; a pass of one job serves all groups and positions.

    The ends of the runs, one row for each 2^16 values, are enough to find an interval that few
    pairs of runs reach into; only those are read, a few for each run.
    """
    ends = runs.select("_group", "_run", F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"),
                       F.aggregate("n", F.lit(0.0), lambda s, n: s + n).alias("weight")).orderBy("_group", "_run").toPandas()
    groups = {int(g): RunEnds(f) for g, f in ends.groupby("_group")}
    targets = [(g, k) for g, ks in wanted.items() for k in ks]
    state = {t: groups[g].bracket(k) for t, (g, k) in enumerate(targets)}
    candidate, answer = dict.fromkeys(state, math.inf), {}
    while len(answer) < len(targets):
        work, base = {}, {}
        for t in state.keys() - answer.keys():
            ends_of = groups[targets[t][0]]
            points = sections(*state[t], candidate[t])
            surely, pairs = ends_of.open_pairs(*state[t])
            whole, cut = ends_of.values(points)
            base[t] = surely + whole
            work[t] = (targets[t][0], state[t][0], points, pairs, cut)
        for t, (pairs, single, mean) in _count_open(runs, work).items():
            state[t] = low, high = narrowed(state[t][0], work[t][2], (base[t] + pairs + single) / 2, targets[t][1])
            candidate[t] = mean if mean > low else math.inf
            # No mean lies between the old lower end and ``mean``, and the count at ``high`` reaches k.
            if mean == high:
                answer[t] = high
    out: dict[int, list[float]] = {g: [] for g in wanted}
    for t, (g, _) in enumerate(targets):
        out[g].append(answer[t])
    return out


def pairwise_means_at(counts: DataFrame, positions: DataFrame, by: list[str]) -> DataFrame:
    """``positions`` (one row for each group, with an array ``ks``) with ``means``: the pairwise means at those positions.

    The means are those of the group's values in ``counts``, each with itself and with every other
    one, in rising order; positions are 1-based.
    """
    cold, large = _split_hot(counts, by)
    kind = "array<double>"

    def select(x: pd.Series, n: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([select_means(np.asarray(a), np.asarray(w), list(k)) for a, w, k in zip(x, n, ks)], dtype=object)

    found = join_per_key(sorted_runs(cold, by), positions.select(*by, "ks"), by, "inner")
    found = found.select(*by, F.pandas_udf(select, kind)("x", "n", "ks").alias("means"))
    if large is not None:
        runs = _in_runs(large, by, "x")
        # Few groups are large, see hot_groups; each has one row here.
        some = join_per_key(runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_values")), positions.select(*by, "ks"), by, "inner").collect()
        keys = [tuple(r[c] for c in by) for r in some]
        schema, spark = T.StructType(runs.select(*by).schema.fields), runs.sparkSession
        numbers = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], T.StructType([*schema.fields, T.StructField("_group", T.IntegerType())]))
        numbered = materialize(join_per_key(sorted_runs(runs, [*by, "_run"]), numbers, by, "inner").select("_group", "_run", "x", "n"))
        picked = _select_in_runs(numbered, {i: list(r["ks"]) for i, r in enumerate(some)})
        means = [(*k, picked[i]) for i, k in enumerate(keys)]
        found = found.unionByName(spark.createDataFrame(means, T.StructType([*schema.fields, T.StructField("means", T.ArrayType(T.DoubleType()))])))
    return join_per_key(positions, found, by, "left")


# --- walks ------------------------------------------------------------------


def bins_of_run(x: np.ndarray, n: np.ndarray, reach: float) -> list[dict]:
    """The bins of a walk up sorted values."""
    out, at = [], 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(x, x[at] + reach, "left")))
        out.append({"first": float(x[at]), "last": float(x[end - 1]), "dots": float(n[at:end].sum())})
        at = end
    return out


def _next_places(values: DataFrame, by: list[str], reach: float) -> DataFrame:
    """For the place ``i`` of each value (numbered in ``_i``) the place ``j`` of the first value at ``reach`` or more above it.

    Values and the ends of their reach are sorted together; the number of values below an end is
    a running sum over both.
    """
    rows = values.select(*by, F.explode(F.array(
        F.struct(F.struct(F.col("x").alias("at"), F.lit(1).alias("kind")).alias("key"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("i")),
        F.struct(F.struct((F.col("x") + reach).alias("at"), F.lit(0).alias("kind")).alias("key"), F.lit(0.0).alias("one"), F.col("_i").alias("i")),
    )).alias("r")).select(*by, "r.key", "r.one", "r.i")
    summed = running_sum(rows, by, "key", "one", "_below")
    return summed.where(F.col("i").isNotNull()).select(*by, F.col("i").alias("_i"), F.greatest(F.col("_below"), F.col("i")).alias("_j")).withColumn("_j", F.col("_j") + 1)


def _large_bins(counts: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Bins of large groups, by pointer doubling.

    Each value points to the value that would open the next bin.  A round adds the targets of
    all known starts to them and replaces the pointers by those of their targets, so the starts
    double; no value waits for the walk below it.
    """
    values = materialize(running_sum(counts.withColumn("_one", F.lit(1.0)), by, "x", "_one", "_i").drop("_one"))
    pointer = materialize(_next_places(values, by, reach))
    starts = materialize(values.where("_i = 1").select(*by, "_i"))
    while True:
        reached = join_per_key(starts, pointer, [*by, "_i"], "inner").select(*by, F.col("_j").alias("_i"))
        reached = materialize(join_per_key(reached, values.select(*by, "_i"), [*by, "_i"], "left_semi"))
        if reached.isEmpty():
            break
        starts = materialize(starts.unionByName(reached))
        ahead = pointer.select(*by, F.col("_i").alias("_j"), F.col("_j").alias("_k"))
        pointer = materialize(join_per_key(pointer, ahead, [*by, "_j"], "inner").select(*by, "_i", F.col("_k").alias("_j")))
    opens = join_per_key(values, starts.withColumn("_opens", F.lit(1.0)), [*by, "_i"], "left").fillna(0.0, subset=["_opens"])
    binned = running_sum(opens, by, "x", "_opens", "_bin")
    return binned.groupBy(*by, "_bin").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.sum("n").alias("dots")).drop("_bin")


def walked_bins(counts: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Bins of a walk up each group's values: one at ``reach`` or more above the bin's first opens a bin.

    Returns ``first``, ``last`` and ``dots`` of each bin.  A group that one task can hold is walked
    there, others see :func:`_large_bins`.
    """
    cold, large = _split_hot(counts, by)

    def walk(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([bins_of_run(np.asarray(a), np.asarray(w), reach) for a, w in zip(x, n)], dtype=object)

    udf = F.pandas_udf(walk, "array<struct<first:double,last:double,dots:double>>")
    bins = sorted_runs(cold, by).select(*by, F.inline(udf("x", "n")))
    return bins if large is None else bins.unionByName(_large_bins(large, by, reach))
