import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialforge.llm import feast, filter_audit, sharding, whitening

from .helpers import EDGES, frame, random_text, words

# --- sharding ---------------------------------------------------------------


def jumped(key, shards):
    """The published algorithm."""
    key %= 1 << 64
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash(spark):
    draw = random.Random(4)
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63)] + [draw.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    sizes = [1, 2, 8, 9, 48, 49, 1000, 100_000]
    for r in df.select("key", *[sharding.jump_hash(F.col("key"), n).alias(str(n)) for n in sizes]).collect():
        assert [r[str(n)] for n in sizes] == [jumped(r["key"], n) for n in sizes]


def test_keys_that_jump_often_go_on(spark, monkeypatch):
    monkeypatch.setattr(sharding, "USUAL_JUMPS", 2)
    df = spark.range(200)
    for r in df.select("id", sharding.jump_hash(F.col("id"), 300).alias("s")).collect():
        assert r["s"] == jumped(r["id"], 300)


def test_sharded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS_AT_ONCE", 7)
    long_text = "lóng " * 50_000
    rows = EDGES + [(100 + i, f"text {i}", "s", "x") for i in range(400)] + [(7777, "same", "s", "x")] * 50 + [(9, long_text, None, None)]
    docs = frame(spark, rows)
    out = sharding.sharded(sharding.measured(docs).withColumn("slot", F.lit("clash")))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = out.collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    slots, shard_of = defaultdict(list), {}
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["grown_shard"] == 8 for r in found if r["doc_id"] and r["doc_id"] < 7000) / 400
    assert 0.05 < moved < 0.18
    again = sharding.sharded(sharding.measured(docs.repartition(3))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_shards_of_nothing_and_of_other_keys(spark, tmp_path):
    assert sharding.sharded(sharding.measured(frame(spark, []))).count() == 0
    docs = frame(spark, EDGES)
    by_name = sharding.sharded(docs, "source", 3).collect()
    assert len(by_name) == len(EDGES) and len({r["shard"] for r in by_name if r["source"] == "b"}) == 1
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(EDGES)
    for r in back.select("shard", sharding.jump_hash(sharding.key_number(F.col("doc_id")), 4).alias("want")).collect():
        assert r["shard"] == r["want"]


# --- filter audit -----------------------------------------------------------


def audited(rows, labels):
    """Every document through every order, one at a time."""
    good = {i for i, q, _ in labels if q == 1} - {None}  # a null id is no label of a document
    toxic = {i for i, _, t in labels if t == 1} - {None}
    last = float("inf")
    first = {}
    for i, text, *_ in rows:
        first[text or ""] = min(first.get(text or "", last), last if i is None else i)
    out = defaultdict(lambda: dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], 0))
    shapley = Counter()
    for part in {r[2] or "" for r in rows}:
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                out[part, "".join(order), step]
    for i, text, part, *_ in rows:
        text, part, w = text or "", part or "", words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": first[text] < (last if i is None else i),
        }
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                o = out[part, "".join(order), step]
                here = fails[f] and not gone
                o["redundant"] += fails[f] and gone
                o["removed"] += here
                o["unique_fails"] += fails[f] and sum(fails.values()) == 1
                o["good_lost"] += here and i in good
                o["toxic_lost"] += here and i in toxic
                shapley[part, f] += here
                gone = gone or fails[f]
                o["kept"] += not gone
    for (part, order, step), o in out.items():
        o["shapley"] = shapley[part, order[step - 1]]
    return {k: tuple(map(int, v.values())) for k, v in out.items()}


def test_audit(spark):
    draw = random.Random(6)
    rows = list(EDGES)
    for i in range(60):
        n = draw.choice([3, 150, 199, 200, 260])
        text = " ".join(random_text(draw, n, draw.choice([20, 4000])))
        text = text.replace("w1", "W1") if draw.random() < 0.3 else text
        rows.append((100 + i, text + draw.choice(["", "", " #", "|"]), draw.choice(["a", "b", None]), "x"))
    rows += [(300 + i, rows[20 + i % 5][1], "b", "x") for i in range(20)] + [(9, "Ab é " * 40_000, "b", "x"), (-3, "", "a", "x")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(350)] + [(101, 1, 1), (101, 0, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(frame(spark, rows).withColumnRenamed("kept", "mask"), marks, part_col="source")
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in out.collect()}
    assert found == audited(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels, part_col="source").count() == 0
    assert filter_audit.audit(frame(spark, EDGES), labels, part_col="source").count() == 600 * len({r[2] or "" for r in EDGES})


# --- whitening --------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(2, 200), st.integers(0, 10**6), st.sampled_from(["plain", "low rank", "multiple", "steep"]))
def test_eigenpairs_by_contours(d, n, seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "multiple":
        basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = basis @ np.diag(rng.integers(1, 4, d).astype(float)) @ basis.T
    else:
        x = rng.standard_normal((n, d))
        if kind == "steep":
            x = x * np.logspace(0, -5, d)
        if kind == "low rank":
            x[:, d // 2 :] = 0
        a = x.T @ x / n
    a = (a + a.T) / 2
    want = np.linalg.eigvalsh(a)[::-1]
    scale = max(want[0], 1e-300)
    found = []
    for low, high, count in feast.intervals(a / scale, min(16, d), 1e-9):
        values, vectors = feast.eigenpairs(a / scale, low, high, count)
        assert len(values) == count
        assert np.abs(a / scale @ vectors - vectors * values).max() < 1e-12
        assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-9
        found += list(values)
    found = np.sort(found)[::-1][:16]
    known = want[: len(found)] / scale
    assert np.abs(found - known).max(initial=0) < 1e-12
    assert len(found) == min(16, int((want / scale > 1e-9).sum()))


def test_a_wrong_count_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.eigenpairs(np.diag([1.0, 2.0, 3.0]), 2.5, 3.5, 2)


VECTORS = "vec_id long, embedding array<float>, n string, label int"


def check_whitening(rows, found, most=16):
    ok = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in ok]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[float(Fraction(v[j] * n - sums[j], n)) for j in range(d)] for v in fit])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(most, int((values > values[0] * 1e-9).sum()))
    assert len(found) == k * len(ok)
    got = defaultdict(dict)
    for r in found:
        got[r["vec_id"]][r["component"]] = r
    for (i, _), v in zip(ok, x):
        assert sorted(got[i]) == list(range(1, k + 1))
        exact = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        assert all(int(r["deviation"]) == exact and r["n"] == n for r in got[i].values())
        assert all(r["explained"] == pytest.approx(values[c - 1] / np.trace(covariance), rel=1e-9) for c, r in got[i].items())
    # Whitened values have unit covariance over the fit list, and the components rebuild the covariance.
    one = {tuple(v): i for (i, _), v in zip(ok, x)}
    w = np.array([[got[one[v]][c]["whitened"] for c in range(1, k + 1)] for v in fit])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    vectors = centred.T @ w / n / np.sqrt(values[:k])
    assert np.abs(covariance @ vectors - vectors * values[:k]).max() < 1e-9 * values[0]
    assert found[0]["identity_error"] < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(5)
    mean = rng.standard_normal(20)
    rows = [(i, [float(c) for c in mean + rng.standard_normal(20) * np.linspace(1, 3, 20)], "x", i) for i in range(120)]
    rows += [(500 + i, rows[0][1], "x", 1) for i in range(60)] + [(900, rows[1][1], None, None)]
    bad = [(700, None, "x", 1), (701, [], "x", 1), (702, [None] + [0.0] * 19, "x", 1), (703, [float("nan")] * 20, "x", 1), (704, [float("inf")] + [0.0] * 19, "x", 1)]
    out = whitening.whitened(spark.createDataFrame(rows + bad, VECTORS).repartition(7))
    assert out.columns == ["vec_id", "embedding", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(rows + bad, out.collect())


def test_whitening_of_huge_entries_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(3) * 1e9], "x", i) for i in range(30)]
    check_whitening(rows, whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect())


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_whitening_without_variance(spark, vectors):
    out = whitening.whitened(spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], VECTORS))
    assert out.collect() == [] and "whitened" in out.columns


def test_vectors_of_several_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="one length"):
        whitening.whitened(spark.createDataFrame([(1, [1.0], "x", 1), (2, [1.0, 2.0], "x", 1)], VECTORS))


def test_few_components(spark):
    rows = [(1, [0.0, 1.0], "x", 1), (2, [1.0, 0.0], "x", 1), (3, [3.0, 0.5], "x", 1)]
    check_whitening(rows, whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect())
    one = whitening.whitened(spark.createDataFrame(rows, VECTORS), components=1).collect()
    assert len(one) == 3 and {r["component"] for r in one} == {1}
