"""Sessions followed by their rules, against a plain loop; moments in one aggregate."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialforge.operators import metrics, protocol

LOG = "p string, n int, level int, ok boolean, block int, correct int"


def calibrate(attempts, tries_allowed=10):
    at = tries = done = 0
    best, ended = None, False
    for place, (level, ok) in enumerate(attempts, 1):
        rule = None
        if ended:
            rule = "attempt after the end"
        elif at >= 7 or level != protocol.LEVELS[at]:
            rule = "wrong level"
        elif ok is None:
            rule = "outcome missing"
        if rule:
            return best, done, False, rule, place
        done += 1
        if ok:
            best, at = level, at + 1
            ended = at == 7
        else:
            tries += 1
            ended = at > 0 or tries >= tries_allowed
    return best, done, ended, None, None


def train(trials, size=30, most=5, window=20, needed=17):
    block = trial = done = 0
    recent, reached, ended = [], None, False
    for place, (b, correct) in enumerate(trials, 1):
        opens = trial == size or block == 0
        rule = None
        if ended:
            rule = "attempt after the end"
        elif b != block + opens:
            rule = "wrong block"
        elif correct is None:
            rule = "outcome missing"
        if rule:
            return reached, block, done, False, rule, place
        if opens:
            block, trial, recent = block + 1, 0, []
        trial, done = trial + 1, done + 1
        recent = [*recent, correct][-window:]
        if sum(recent) >= needed:
            reached, ended = done, True
        ended = ended or (block == most and trial == size)
    return reached, block, done, ended, None, None


def rows(sessions):
    return [(p, i, *a) for p, attempts in sessions.items() for i, a in enumerate(attempts)]


def test_calibration(spark):
    draw, sessions = random.Random(1), {}
    for k in range(120):
        level, attempts = 0, []
        for _ in range(draw.choice([0, 1, 5, 12, 17, 40])):
            ok = draw.random() < draw.choice([0.3, 0.9])
            shown = protocol.LEVELS[min(level, 6)] if draw.random() < 0.98 else draw.choice([7, 8, 19, None])
            attempts.append((shown, None if draw.random() < 0.01 else ok))
            level += ok
        sessions[f"p{k}"] = attempts
    sessions["all"] = [(v, True) for v in protocol.LEVELS]
    sessions["tries"] = [(7, False)] * 10
    sessions["eleven"] = [(7, False)] * 11
    sessions["last try"] = [(7, False)] * 9 + [(7, True), (9, False)]
    df = spark.createDataFrame([(p, i, level, ok, None, None) for p, i, level, ok in rows(sessions)], LOG).repartition(5)
    found = protocol.follow_calibration(df, ["p"], ["n"], "level", F.col("ok"))
    assert found.columns == ["p", "set_point", "attempts", "finished", "broken_rule", "broken_at"]
    assert {r.p: tuple(r)[1:] for r in found.collect()} == {p: calibrate(a) for p, a in sessions.items() if a}


def test_training(spark):
    draw, sessions = random.Random(2), {}
    for k in range(60):
        skill, length = draw.choice([0.5, 0.8, 0.9]), draw.choice([3, 40, 149, 150, 151, 400])
        sessions[f"p{k}"] = [
            (i // 30 + 1 if draw.random() < 0.999 else draw.choice([0, None, 9]), None if draw.random() < 0.001 else int(draw.random() < skill)) for i in range(length)
        ]
    sessions["cap"] = [(i // 30 + 1, 0) for i in range(150)]
    sessions["too long"] = [(i // 30 + 1, 0) for i in range(151)]
    sessions["early"] = [(1, 1)] * 17
    sessions["on"] = [(1, 1)] * 18
    # The window starts anew with each block.
    sessions["across"] = [(1, 0)] * 20 + [(1, 1)] * 10 + [(2, 1)] * 16
    df = spark.createDataFrame([(p, i, None, None, b, c) for p, i, b, c in rows(sessions)], LOG).repartition(5)
    found = protocol.follow_training(df, ["p"], ["n"], "block", "correct")
    assert {r.p: tuple(r)[1:] for r in found.collect()} == {p: train(a) for p, a in sessions.items()}


def test_attempts_that_cannot_count_are_dropped_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("a", 1, 7, True, 1, 1)], LOG)
    for folded in (protocol.follow_calibration(df, ["p"], ["n"], "level", F.col("ok")), protocol.follow_training(df, ["p"], ["n"], "block", "correct")):
        text = plan(folded, "simple")
        assert "Partial" in text[text.index("WindowGroupLimit"):] and text.rindex("Partial") > text.rindex("Exchange hashpartitioning")
    assert protocol.follow_calibration(df.limit(0), ["p"], ["n"], "level", F.col("ok")).count() == 0


@pytest.mark.parametrize("by", [(), ("g",)])
def test_moments_of_large_values_keep_their_digits(spark, by):
    draw = random.Random(3)
    data = [(g, 1e9 + draw.gauss(0, 1), draw.randint(1, 5)) for g in "ab" for _ in range(400)]
    df = spark.createDataFrame(data, "g string, x double, n int")
    for cut in (df, df.repartition(7)):
        out = {r.g: r for r in metrics.grand_stats(cut, "x", "m", "s", weight="n", by=by).collect()}
        for g in "ab":
            xs = [x for h, x, n in data for _ in range(n) if not by or h == g]
            assert out[g].m == pytest.approx(statistics.fmean(xs), abs=1e-6)
            assert out[g].s == pytest.approx(statistics.stdev(x - 1e9 for x in xs), rel=1e-7)  # the values themselves have 1e-7 to spare


def test_moments_with_missing_values_and_single_rows(spark):
    df = spark.createDataFrame([("one", 4.0, 1), ("many", 4.0, 3), ("null", None, 1), ("null", 1.0, 1), ("zero", 2.0, 0)], "g string, x double, n int")
    got = {r.g: (r.m, r.s) for r in metrics.grand_stats(df, "x", "m", "s", weight="n", by=["g"]).collect()}
    assert got == {"one": (4.0, None), "many": (4.0, 0.0), "null": (None, None), "zero": (None, None)}
    assert metrics.grand_stats(df.limit(0), "x").count() == 0


def test_moments_take_one_aggregate(spark, plan, tmp_path):
    spark.range(50).select(F.col("id").cast("double").alias("x")).write.parquet(f"{tmp_path}/x")
    text = plan(metrics.grand_stats(spark.read.parquet(f"{tmp_path}/x"), "x"), "simple")
    assert text.count("FileScan") <= 3 and "Subquery" in text  # the rows, and the aggregate once or reused
