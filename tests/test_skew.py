"""Hot groups: the split paths give what plain joins and windows give."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialforge.operators import cohort, metrics, skew
from trialforge.operators.ordered import number_and_roll
from trialforge.plans import training_and_test
from trialforge.sources.logs import with_row_index

from .conftest import values

SCHEMA = "id long, k string, ts timestamp, x int"


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, with a burst and ties in time; one key is missing."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else (None if i % 41 == 0 else f"k{rng.randrange(60)}")
        second = 100 if i % 2 else (100 + i % 5 if i % 4 else rng.randrange(100_000))
        rows.append((i, key, second, rng.randrange(2)))
    df = spark.createDataFrame(rows, "id long, k string, s long, x int")
    return df.select("id", "k", F.timestamp_seconds("s").alias("ts"), "x").repartition(5)


def windowed(df, n):
    w = W.partitionBy("k").orderBy("ts", "id")
    return df.withColumn("n", F.row_number().over(w)).withColumn("roll", F.sum("x").over(w.rowsBetween(-(n - 1), 0)))


@pytest.mark.parametrize("length", [1, 3, 20])
def test_numbering_and_trailing_sum(skewed, small_limits, length):
    got = number_and_roll(skewed, ["k"], ["ts", "id"], "n", ("x", length, "roll"))
    assert values(got, "id", "n", "roll") == values(windowed(skewed, length), "id", "n", "roll")


def test_numbering_without_hot_groups(skewed):
    got = number_and_roll(skewed, ["k"], ["ts", "id"], "n", ("x", 4, "roll"))
    assert values(got, "id", "n", "roll") == values(windowed(skewed, 4), "id", "n", "roll")


@pytest.mark.parametrize("kind", ["date", "string", "timestamp", "decimal(9,2)", "boolean"])
def test_numbering_takes_any_order_above_the_limit(spark, kind, request):
    """Dates, text and nulls order a hot group as they order an ordinary one."""
    as_kind = {"date": F.date_add(F.lit("2020-01-01"), F.col("s").cast("int")), "boolean": F.col("s") % 2 == 0}.get(kind, F.col("s").cast(kind))
    df = spark.range(300).withColumn("s", F.col("id") % 17).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 11 > 0, as_kind).alias("o"), F.lit(1).alias("x"))
    ordinary = values(number_and_roll(df, ["k"], ["o", "id"], "n", ("x", 5, "roll")), "id", "n", "roll")
    request.getfixturevalue("small_limits")
    assert values(number_and_roll(df, ["k"], ["o", "id"], "n", ("x", 5, "roll")), "id", "n", "roll") == ordinary


def test_a_tied_hot_group_is_dealt_over_all_tasks(spark, small_limits, request):
    """Nine in ten rows share one time; no partition of the sorted rows holds most of them."""
    spark.conf.set(skew.HOT_ROWS_CONF, "500")
    request.getfixturevalue("splitting")  # else the small tasks of this test are joined again
    df = spark.range(0, 10_000, numPartitions=8).select("id", F.lit("a").alias("k"), F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("o"))
    got = number_and_roll(df, ["k"], ["o", "id"], "n").withColumn("task", F.spark_partition_id())
    assert got.count() == 10_000 and got.agg(F.max("n"), F.count_distinct("n")).first()[:] == (10_000, 10_000)
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 4_000


def test_numbering_where_all_times_tie(spark, small_limits):
    df = spark.range(100).select("id", F.lit("a").alias("k"), F.lit(0).cast("timestamp").alias("ts"), F.lit(1).alias("x"))
    got = number_and_roll(df, ["k"], ["ts", "id"], "n", ("x", 20, "roll"))
    assert values(got, "id", "n") == sorted([(i, i + 1) for i in range(100)], key=repr)
    assert {r.roll for r in got.where("n >= 20").collect()} == {20}


@pytest.fixture
def splitting(spark):
    """Adaptive execution splits partitions of a few kilobytes."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("make", [
    lambda df: skew.with_group_stats(df, ["k"], n=F.count(F.lit(1))),
    lambda df: cohort.in_cohort(df, df.where("k = 'hot'"), "k"),
    lambda df: cohort.not_in_cohort(df, df.where("k LIKE 'k1%'"), "k"),
])
def test_spark_splits_a_hot_key(spark, splitting, make):
    rows = spark.range(0, 60_000, numPartitions=8).select(
        "id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 997)).otherwise("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")
    )
    made = make(rows)
    assert made.collect()
    assert "skew=true" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_per_key(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3), ("k7", 4), ("zz", 5)], "k string, v int")
    got = skew.join_per_key(skewed, right, ["k"], how)
    plain = skewed.join(right.withColumnRenamed("k", "rk"), F.col("k").eqNullSafe(F.col("rk")), how).drop("rk")
    assert got.columns == plain.columns
    assert values(got, *plain.columns) == values(plain, *plain.columns)


def test_group_stats_keep_every_row(skewed, small_limits):
    got = skew.with_group_stats(skewed, ["k"], x=F.max("id"), n=F.count(F.lit(1)))
    w = W.partitionBy("k")
    plain = skewed.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("x", F.max("id").over(w))
    assert values(got, "id", "k", "x", "n") == values(plain, "id", "k", "x", "n")


def test_cohort_and_complement_are_the_input(spark, skewed, small_limits):
    ids = spark.createDataFrame([("hot",), ("k3",), ("k3",)], "k string")
    inside, outside = cohort.in_cohort(skewed, ids, "k"), cohort.not_in_cohort(skewed, ids, "k")
    assert inside.count() + outside.count() == skewed.count()
    assert {r.k for r in inside.select("k").distinct().collect()} == {"hot", "k3"}


def test_row_index_with_ties_is_complete(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), "id").repartition(7)
    got = [(r.row_index, r.a) for r in with_row_index(df, [F.col("a").desc_nulls_last()]).collect()]
    got.sort()
    assert [i for i, _ in got] == list(range(1, 1001))
    assert [a for _, a in got] == sorted((i % 3 for i in range(1000)), reverse=True)


def trial_log(spark):
    rng = random.Random(5)
    rows = []
    for p in range(12):
        for phase, test in (("Crel", 0), ("CfuncTest", 1)):
            if phase == "CfuncTest" and p % 4 == 0:
                continue
            for t in range(60 if p == 1 else 20):
                condition = "a" if p != 2 or t % 2 else "b"
                correct = None if (p, phase, t) == (3, "Crel", 4) else rng.randrange(2)
                rows.append((condition, p, phase, test, t // 10, t, correct, rng.randrange(21), rng.random()))
    return spark.createDataFrame(
        rows,
        "condition string, unique_id long, phase string, is_test int, block int, trial_n int, correct int, "
        "criterion int, duration double",
    )


def check_base(spark):
    """Fused block metrics against the row-preserving steps: window, window, distinct, filter."""
    log = trial_log(spark)
    got = training_and_test.base_log(log, ["Crel", "CfuncTest"], "CfuncTest")
    steps = metrics.phase_metrics(metrics.block_metrics(log))
    columns = ["condition", "unique_id", "phase", "is_test", "block", "criterion", "blockAcc", "trialCount", "accuracy", "pass"]
    steps = metrics.collapse(cohort.completers(steps, "CfuncTest"), columns)
    assert values(got, *columns) == values(steps, *columns)
    fan_out = got.where("unique_id = 2 AND phase = 'Crel'")
    assert {r.condition for r in fan_out.collect()} == {"a", "b"}
    missing = got.where("unique_id = 3 AND phase = 'Crel'").collect()
    assert {r.accuracy for r in missing} == {None} and {r["pass"] for r in missing} == {None}


def test_base_metrics_equal_the_separate_steps(spark):
    check_base(spark)


def test_base_metrics_with_hot_participants(spark, small_limits):
    check_base(spark)
