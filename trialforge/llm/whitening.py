"""Whitening of embeddings: components of the covariance by contour integration, projections on them.

Spark drops unusable vectors, finds the distinct ones and sums them; tasks add up the products
of the centred entries as integers, so that the covariance is exact whatever the order of
tasks.  What leaves the tasks is one sum for each pair of dimensions, bounded by the square of the dimension.
The intervals of the spectrum are dealt to tasks, see :mod:`feast`, and every row is projected in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feast
from .common import checkpointed, packed, unpacked, written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
MOST_DIMENSIONS = 4096  # the covariance is held by each task that solves: 128 MB
EXACT_FLOAT = 1 << 53
LIMB = 40  # sums travel as two longs: multiples of 2**LIMB, and the rest
RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def usable(frame: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    vector = F.col(f"`{vector_col}`")
    return frame.where(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(entry(c.cast("double")), F.lit(False))))


def to_grid(vector_col: str):
    """Entries as longs; one beyond 2**62 stays at 2**62."""
    most = float(1 << 62)
    inside = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(most)), F.lit(-most))
    return F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(inside(c)).cast("long") + SHIFT)


def rows_of(column: pa.ListArray, d: int) -> np.ndarray:
    """The lists of a column without nulls as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers, exact; only a batch with huge entries leaves the floating-point unit."""
    if not len(y):
        return np.zeros((y.shape[1], y.shape[1]), object)
    largest = max(abs(int(y.min())), abs(int(y.max())))
    if largest**2 * len(y) < EXACT_FLOAT:
        return (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object)
    exact = y.astype(object)
    return exact.T @ exact


def product_sums(fit: DataFrame, centre: list[int]) -> DataFrame:
    """(i, j, high, low) for i <= j: the sum over ``fit`` of the products of entries i and j less ``centre``."""
    d = len(centre)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total += products(rows_of(batch.column("x"), d) - np.array(centre, np.int64))
        i, j = np.triu_indices(d)
        sums = total[i, j]
        high = [int(s) >> LIMB for s in sums]
        low = [int(s) & ((1 << LIMB) - 1) for s in sums]
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "high": pa.array(high, pa.decimal128(38, 0)), "low": pa.array(low, pa.int64())})

    sums = fit.mapInArrow(task, "i int, j int, high decimal(38,0), low bigint")
    return sums.groupBy("i", "j").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").alias("low"))


def entry_sums(fit: DataFrame, d: int) -> DataFrame:
    """(i, s, n): the sum of entry i over ``fit``, and the number of vectors; d rows from each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for batch in batches:
            x = rows_of(batch.column("x"), d)
            if len(x):
                fits = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 1 << 63
                total, n = total + (x if fits else x.astype(object)).sum(axis=0).astype(object), n + len(x)
        if n:
            yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "s": pa.array([int(v) for v in total], pa.decimal128(38, 0)), "n": pa.array([n] * d, pa.int64())})

    return fit.mapInArrow(task, "i int, s decimal(38,0), n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray, float]:
    """Number of vectors, sums of their entries, covariance and its trace; exact until they are rounded to doubles."""
    one = entry_sums(fit, d).orderBy("i").collect()  # d rows
    if not one:
        return 0, [], np.zeros((0, 0)), 0.0
    n, sums = one[0]["n"], [int(r["s"]) for r in one]
    centre = [s // n for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]  # of the mean, over n
    covariance, trace = np.zeros((d, d)), 0
    for batch in product_sums(fit, centre).toArrow().to_batches():
        for i, j, high, low in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "high", "low"))):
            squared = ((int(high) << LIMB) + low) * n - left[i] * left[j]
            covariance[i, j] = covariance[j, i] = float(Fraction(squared, n * n))
            trace += squared if i == j else 0
    return n, sums, covariance, float(Fraction(trace, n * n))


def components_of(spark: SparkSession, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows; those that are 0 to rounding are left out.

    Each interval of the spectrum is a row that a task solves.  The counts of the intervals, by inertia, are
    compared with what the tasks return.
    """
    d, trace = len(covariance), float(np.trace(covariance))
    if trace <= 0:
        return np.zeros(0), np.zeros((0, d))
    scaled = covariance / trace
    cut = feast.intervals(scaled, min(most, d), d * np.finfo(float).eps)
    shared = spark.sparkContext.broadcast(scaled)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = feast.eigenpairs(shared.value, r["low"], r["high"], r["n"])
                yield pa.record_batch({"value": pa.array(values, pa.float64()), "vector": pa.array(list(vectors.T), pa.list_(pa.float64()))})

    work = spark.createDataFrame(cut, "low double, high double, n int").repartition(max(1, len(cut)))
    found = sorted(work.mapInArrow(task, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    if len(found) != sum(n for *_, n in cut):
        raise ArithmeticError("components are missing: inertia counts and eigenpairs differ")
    if not found:
        return np.zeros(0), np.zeros((0, d))
    # One more Rayleigh-Ritz step makes vectors of different intervals orthogonal to rounding.
    basis = np.linalg.qr(np.array([r["vector"] for r in found]).T)[0]
    values, mix = np.linalg.eigh(basis.T @ scaled @ basis)
    falling = np.argsort(-values, kind="stable")[:most]
    vectors = (basis @ mix[:, falling]).T
    return values[falling] * trace, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def projected(y: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows on the components; ``y`` is less the whole part of the mean, ``rest`` is the remainder."""
    return (y.astype(float) - rest) @ weights


def deviations(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """For each row the sum of (n * y - rest)^2, exact; null beyond 38 digits."""
    largest = max(abs(int(y.min())), abs(int(y.max()))) * n + max(map(abs, rest)) if len(y) else 0
    if largest**2 * y.shape[1] < 1 << 63:
        moved = y * n - np.array(rest, np.int64)
        return pa.array((moved * moved).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    moved = y.astype(object) * n - np.array(rest, object)
    return pa.array([v if v < 10**38 else None for v in (moved * moved).sum(axis=1)], pa.decimal128(38, 0))


def whitened(frame: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row with a usable vector and each component, with the columns of ``frame`` and the results.

    Entries become x = floor(64 * c) + 1000000.  The fit list is each distinct x once; its n
    vectors have per-dimension sums S and covariance V.  Adds ``component`` (1 has the largest
    eigenvalue e), ``n``, ``deviation`` (sum of (n * x - S)^2, exact to 38 digits, null beyond), ``whitened`` (x - S / n
    on the component over sqrt(e)), ``explained`` (e / trace(V)) and ``identity_error`` (largest entry
    of the covariance of ``whitened`` over the fit list less the identity); they take the place of columns so named.

    Rows without a vector, with an empty one, or with an entry that is null, NaN or infinite are left
    out.  Vectors must have one length, of up to 4096; others are an error.  Components whose eigenvalue
    is 0 to rounding can't be whitened and aren't returned, so equal vectors, one vector and empty tables give
    no rows.  Repeated rows are kept and projected alike; a repeated vector counts once in the fit.
    """
    spark = frame.sparkSession
    rows = usable(frame, vector_col).select(packed(frame, RESULTS).alias("row"), to_grid(vector_col).alias("x"))
    fit = written(rows.groupBy("x").agg(F.count("*").alias("times")).select("x"))
    lengths = [r[0] for r in fit.select(F.size("x").alias("d")).distinct().limit(2).collect()]
    if len(lengths) > 1 or lengths and lengths[0] > MOST_DIMENSIONS:
        raise ValueError(f"vectors must have one length of {MOST_DIMENSIONS} at most, found {sorted(lengths)}")
    n, sums, covariance, trace = moments(fit, lengths[0] if lengths else 0)
    d = len(sums)
    values, vectors = components_of(spark, covariance, components) if d else (np.zeros(0), np.zeros((0, 0)))
    k = len(values)
    centre = [s // n for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]  # S - n * centre
    model = spark.sparkContext.broadcast((np.array(centre, np.int64), left, np.array([float(Fraction(v, n)) for v in left]), vectors.T / np.sqrt(values) if k else np.zeros((d, 0))))

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, _, rest, weights = model.value
        total = np.zeros((k, k))
        for batch in batches:
            w = projected(rows_of(batch.column("x"), d) - middle, rest, weights)
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(total[i, j], pa.float64())})

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, whole, rest, weights = model.value
        for batch in batches:
            y = rows_of(batch.column("x"), d) - middle
            flat = pa.array(projected(y, rest, weights).ravel(), pa.float64())
            offsets = pa.array(np.arange(0, len(y) * k + 1, k), pa.int32()) if k else pa.array(np.zeros(len(y) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), deviations(y, n, whole), pa.ListArray.from_arrays(offsets, flat)], ["row", "deviation", "whitened"])

    error = None
    if k:
        squares = fit.mapInArrow(second_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
        error = squares.agg(F.max(F.abs(F.col("s") / n - (F.col("i") == F.col("j")).cast("double")))).first()[0]
    kind = rows.schema["row"].dataType.simpleString()
    if k:
        out = rows.mapInArrow(project, f"row {kind}, deviation decimal(38,0), whitened array<double>")
    else:
        out = rows.where(F.lit(False)).select("row", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    explained = F.array(*[F.lit(float(v) / trace) for v in values]).cast("array<double>")
    out = out.select("row", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        *unpacked(rows, "row"), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained") if k else F.lit(None).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
