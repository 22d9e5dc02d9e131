import collections
import hashlib
import random

import pytest

from trialforge.llm import exact_dedup, mixing

from .helpers import DOCS, EDGES, frame, words


def squeezed(text):
    return "".join(words(text))


def check_groups(rows, found):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[squeezed(text)].append((-len(text or ""), doc_id is None, doc_id))
    assert len(found) == len(rows)
    kept = collections.Counter()
    for r in found:
        key = squeezed(r["text"])
        best = min(groups[key])
        assert (r["keep_id"], r["group_size"]) == (best[2], len(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()
        if r["kept"]:
            assert (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]) == best
            kept[key] += 1
    assert kept == collections.Counter(groups.keys())


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_exact_groups(spark, hot_rows):
    draw = random.Random(3)
    rows = EDGES + [(100 + i, draw.choice(["a b", "ab ", "c", " c  ", "long text " * 500]), "s", "x") for i in range(60)]
    found = exact_dedup.exact_groups(frame(spark, rows), hot_rows=hot_rows)
    assert found.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept", "text_sha256"]
    check_groups(rows, found.collect())


def test_exact_groups_of_an_empty_table(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_copies(frame(spark, [])).columns == DOCS.names


def test_drop_copies_keeps_all_columns(spark):
    left = exact_dedup.drop_copies(frame(spark, EDGES))
    assert left.columns == DOCS.names
    assert left.count() == len({squeezed(r[1]) for r in EDGES})


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing by weight again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= above
    return out


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    draw = random.Random(seed)
    rows = EDGES + [(100 + i, " ".join(["w"] * draw.randint(0, 40)), draw.choice(["a", "b", "c", "d", "é", None, "a"][seed:]), "x") for i in range(500)]
    mixed = mixing.mix(frame(spark, rows).withColumnRenamed("kept", "size"), seed=seed)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    found = mixed.collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(words(text))
    want, taken, largest = targets(dict(sizes)), collections.Counter(), collections.Counter()
    for r in found:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"] * (2 if r["doc_id"] == 4 else 1))
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
    again = mixing.mix(frame(spark, rows[::-1]).withColumnRenamed("kept", "size").repartition(5), seed=seed)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["copies"])
    assert sorted(map(key, again.collect()), key=repr) == sorted(map(key, found), key=repr)


def test_copies_are_unbiased(spark):
    rows = [(i, "w " * 10, "b" if i % 4 else "a", "x") for i in range(400)]
    share = sum(r["copies"] for s in range(3) for r in mixing.mix(frame(spark, rows), seed=s).where("source = 'a'").collect()) / 300
    assert share == pytest.approx(4 / 3, abs=0.02)


def test_mix_of_empty_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None), (2, " ", "a", None)])).collect()] == [0, 0]
