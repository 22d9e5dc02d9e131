import random

import pytest

import corpus_pipeline
from check import canonical, tables
from trialforge.llm.queries import ORACLES, QUERIES

from .helpers import random_text

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_of_the_table(spark, name):
    found = QUERIES[name](spark, SMALL)
    keys = {"op8_url_filter": ("page_id", "pages"), "op12_filter_audit": ("lang", "documents"), "op13_whitening": ("vec_id", "embeddings")}
    key, table = keys.get(name, ("doc_id", "documents"))
    rows = found.collect()
    there = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect())
    if name == "op12_filter_audit":
        assert sorted(r["part"] for r in rows) == sorted([*dict.fromkeys(there)] * 600)
    else:
        assert sorted(r[key] for r in rows) == (sorted(there * 16) if name == "op13_whitening" else there)
    if name in ORACLES:
        result = tables(SMALL).execute(ORACLES[name])
        assert canonical(found.columns, rows) == canonical([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_exact_dedup", "op11_sharding"])
def test_native_operators_run_no_python(spark, plan, name):
    text = plan(QUERIES[name](spark, SMALL))
    for forbidden in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in text


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    """Each stage takes what was planted for it and leaves clean documents alone."""
    draw = random.Random(8)
    text = lambda n: " ".join(random_text(draw, n, 50_000))
    item = text(40)
    rows, kind = [], {}

    def add(what, content, source="a"):
        i = len(rows)
        rows.append((i, content, "en", source, len(content or "")))
        kind.setdefault(what, []).append(i)
        return i

    for k in range(200):
        add("clean", text(80), "abc"[k % 3])
    for k in range(100):
        add("toxic", text(40) + " vile rotten " + text(30), "abc"[k % 3])
    for i in range(5):
        add("exact", rows[i][1].replace(" ", "\n"))
    for i in range(10, 15):
        add("near", rows[i][1] + " added")
    for _ in range(6):
        add("leak", text(30) + " " + item + " " + text(30))
    add("empty", None, None)
    folder = str(tmp_path)
    write(spark, folder, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, folder, "labels", [(i, 1, int(i in kind["toxic"])) for i in range(300)], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [(1, item), (2, text(30))], "item_id long, text string")

    docs, left = corpus_pipeline.table(spark, folder, "documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == columns
        left.append({r["doc_id"] for r in docs.collect()})
    everything = set(range(len(rows)))
    assert everything - left[0] == set(kind["toxic"])
    assert left[0] - left[1] == set(kind["exact"])
    assert left[1] - left[2] == set(kind["near"])
    assert left[2] - left[3] == set(kind["leak"])
    mixed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in mixed} <= left[3] and all(1 <= r["copies"] <= 3 for r in mixed)
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def tables_of(spark, folder, rows):
    extra = "score double, kept string, item_id long, n_shingles long, key long"
    docs = [(*r, 0.5, "k", 7, 1, 2) for r in rows]
    write(spark, folder, "documents", docs, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    write(spark, folder, "labels", [(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", [(1, "rare item of the benchmark with some words in it"), (None, None), (2, "")], "item_id long, text string")


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Repeated ids and rows, null ids, null, empty and very long texts, and columns named like results."""
    draw, folder = random.Random(9), str(tmp_path)
    text = lambda n: " ".join(random_text(draw, n, 50_000))
    rows = [(i, text(60) + (" vile rotten" if i % 2 else ""), "en", "ab"[i % 2], 1) for i in range(200)]
    long_text = text(150_000)
    rows += [(300, long_text, "en", "a", 1), (300, long_text, "en", "a", 1), (301, text(50), "en", "a", 1), (301, text(50), "de", None, 1)]
    rows += [(None, text(40), None, None, None), (None, None, None, None, None), (302, "", "en", "b", 0), (303, None, "en", "b", 0)]
    tables_of(spark, folder, rows)
    docs = corpus_pipeline.table(spark, folder, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == columns
    left = docs.collect()
    assert all(r["kept"] == "k" and r["score"] == 0.5 and r["item_id"] == 7 for r in left)
    ids = [r["doc_id"] for r in left]
    assert ids.count(300) == 1 and sum(r["text"] is None or not r["text"] for r in left) == 1
    assert {i for i in range(0, 200, 2)} <= set(ids)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert set(columns) <= set(mixed.columns) and mixed.count() <= len(left)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    tables_of(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
