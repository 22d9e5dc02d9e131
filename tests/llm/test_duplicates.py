import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialforge.llm import graph, line_dedup, near_dedup, substring_dedup
from trialforge.llm import words as w

from .helpers import DOCS, EDGES, components, frame, random_text, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAé \n\x0b zB", max_size=30)), max_size=12), st.integers(1, 20))
def test_words_of_a_column(texts, most):
    numbers = {}
    seen = 0
    for first, last, chunk in w.text_words(pa.array(texts, pa.string()), lower=True, most=most):
        assert first == seen
        seen = last
        for k in range(first, last):
            a, b = chunk.at[k - first], chunk.at[k - first + 1]
            expected = words(texts[k], lower=True)
            assert b - a == len(expected)
            for number, word in zip(chunk.hashes[a:b], expected):
                assert numbers.setdefault(int(number), word) == word
    assert seen == len(texts) and len(numbers) == len(set(numbers.values()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 6))
def test_windows_tell_runs_apart(run, k):
    hashes = w.mixed(np.array(run, np.uint64))
    numbers = w.windows(hashes, k)
    runs = [tuple(run[i : i + k]) for i in range(len(run) - k + 1)]
    assert len(numbers) == len(runs) and len(dict(zip(numbers.tolist(), runs))) == len(set(runs)) == len(set(zip(numbers.tolist(), runs)))
    at = np.arange(len(run))
    zero = np.zeros(len(run), int)
    without = w.spans_without(hashes, zero, zero + len(run), at)
    for i in range(len(run)):
        assert without[i] == w.spans(np.delete(hashes, i), np.array([0]), len(run) - 1)[0]


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)] + [(0, None), (7, 7)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert found == components({n for e in real for n in e}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    run = words(text, lower=True)
    return frozenset(tuple(run[i : i + 5]) for i in range(len(run) - 4)) if len(run) >= 5 else frozenset([tuple(run)] if run else [])


def near_copies(draw):
    """Families whose members are edited more and more, so that many pairs are near the threshold."""
    rows = []
    for family in range(4):
        base = random_text(draw, 120, 5000)
        for member in range(14):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = f"new{draw.random()}"
            rows.append((1000 + 100 * family + member, " ".join(copy), "s", "x"))
    return rows


@pytest.mark.parametrize("block", [5, 400])
def test_near_groups(spark, block):
    draw = random.Random(5)
    rows = EDGES + near_copies(draw) + [(2000, "Long " * 50_000, "s", "x"), (2001, "long " * 40_000, "s", "x")]
    found = near_dedup.near_groups(frame(spark, rows), block=block)
    assert found.columns == ["doc_id", "text", "source", "n_shingles", "component_id", "kept"]
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(ids, edges)
    assert len({want[i] for i in ids if 1000 <= i < 2000}) > 4  # some members are too far edited
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(shingles(r["text"]))
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]))
    left = near_dedup.drop_near_copies(frame(spark, rows))
    assert left.columns == DOCS.names
    assert {r["doc_id"] for r in left.collect()} == {None} | {i for i in ids if want[i] == i}


def test_near_groups_of_empty_tables(spark):
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    assert {r["kept"] for r in near_dedup.near_groups(frame(spark, [(1, None, None, None), (2, "", None, None)])).collect()} == {True}


def test_pruning_follows_the_posterior():
    least = near_dedup.least_matches(75, 1e-6)
    assert least == sorted(least) and least[-1] < 0.75 * near_dedup.HASHES
    loose = near_dedup.least_matches(75, 1e-2)
    assert all(a < b for a, b in zip(least, loose))


def removed_by_brute_force(rows, window):
    runs = [words(t) for _, t, *_ in rows]
    times = collections.Counter(tuple(r[i : i + window]) for r in runs for i in range(len(r) - window + 1))
    out = []
    for run in runs:
        gone = set()
        for i in range(len(run) - window + 1):
            if times[tuple(run[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(run), len(gone), " ".join(x for i, x in enumerate(run) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cut_repeats(spark, seed):
    draw = random.Random(seed)
    shared = [random_text(draw, draw.randint(4, 30), 4000) for _ in range(6)]
    rows = list(EDGES)
    for i in range(60):
        run = random_text(draw, draw.randint(0, 60), 30 if i % 7 == 0 else 4000)
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice(shared)
            at = draw.randint(0, len(run))
            cut = draw.randint(0, 6)
            run[at:at] = passage[cut:]
        rows.append((100 + i // 2, draw.choice([" ", "\n", "\t "]).join(run), "s", "x"))
    rows += [rows[-1], (900, "ab " * 3000, "s", "x"), (901, "ab ba " * 9 + "end", "s", "x")]
    found = substring_dedup.cut_repeats(frame(spark, rows).withColumnRenamed("kept", "n_words"), window=7, kmer=3)
    assert found.columns == ["doc_id", "source", "text", "n_words", "n_removed", "kept_text"]
    want = [(i, t, *r) for (i, t, *_), r in zip(rows, removed_by_brute_force(rows, 7))]
    got = [(r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] for r in want) > 100


def test_cut_repeats_of_an_empty_table(spark):
    assert substring_dedup.cut_repeats(frame(spark, [])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_drop_lines(spark):
    draw = random.Random(9)
    lines = [random_text(draw, draw.randint(1, 12), 900) for _ in range(25)]
    rows = list(EDGES)
    for i in range(50):
        text = []
        for _ in range(draw.randint(0, 5)):
            line = list(draw.choice(lines))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                at = draw.randrange(len(line) + 1)
                line[at : at + draw.randint(0, 1)] = ["Edit"] * draw.randint(0, 1)
            text.append(" ".join(line))
        rows.append((100 + i, "\n".join(text), "s", "x"))
    found = line_dedup.drop_lines(frame(spark, rows).withColumnRenamed("kept", "n_lines"), least_words=4)
    assert found.columns == ["doc_id", "source", "text", "n_lines", "n_dropped", "kept_text"]
    order = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t is not None})
    place = {}
    for no, i, t in order:
        for k, line in enumerate(t.split("\n")):
            run = tuple(words(line, lower=True))
            if run and (run not in place or (no, i, k) < place[run]):
                place[run] = (no, i, k)
    near = {a for a in place for b in place if place[b] < place[a] and min(len(a), len(b)) >= 4 and edits(a, b) <= 1}
    assert len(near) > 10
    for r in found.collect():
        if r["text"] is None:
            assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (0, 0, None)
            continue
        parts = r["text"].split("\n")
        gone = {k for k, line in enumerate(parts) if (run := tuple(words(line, lower=True))) and (run in near or place[run] != (r["doc_id"] is None, r["doc_id"] or 0, k))}
        assert (r["n_lines"], r["n_dropped"]) == (len(parts), len(gone))
        assert r["kept_text"] == "\n".join(x for k, x in enumerate(parts) if k not in gone)
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_short_lines_meet_within_one_edit(spark):
    """With the bounds of the query: lines of 4 to 7 words, and of 7 and 8."""
    draw = random.Random(12)
    rows, want = [], {}
    for n in range(1, 9):
        line = [f"n{n}w{i}" for i in range(n)]
        at = draw.randrange(n)
        for k, other in enumerate([line, [*line[:at], "new", *line[at + 1 :]], [*line[:at], "more", *line[at:]], [*line, "two", "more"]]):
            rows.append((10 * n + k, " ".join(other), "s", "x"))
            want[10 * n + k] = int(n >= 4 and k in (1, 2))
    found = line_dedup.drop_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in found} == want


def test_kept_text_digest_matches(spark):
    row = substring_dedup.cut_repeats(frame(spark, [(1, "a\nb", None, None)])).first()
    assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()
