import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.llm import decontamination, language_model, quality, toxicity, url_filter

from .helpers import DOCS, EDGES, frame, random_text, words

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def marks_off(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text or "").split()


def align(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for x in item:
        last, row = row, [0]
        for j, y in enumerate(text, 1):
            row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[-1] - 1))
        best = max(best, *row)
    return best / (2 * len(item))


def scored(item, text):
    """Score of the best local alignment; an item of one or two words only as a whole run."""
    k = len(item)
    if k <= 2 and item not in [text[i : i + k] for i in range(len(text) - k + 1)]:
        return 0.0
    return align(item, text)


def leaked(draw):
    items = [(i, " ".join(random_text(draw, draw.randint(12, 40), 100_000))) for i in range(12)] + [(50, "tiny"), (51, None), (52, ""), (53, "Two, words!")]
    rows = list(EDGES)
    for k in range(60):
        body = random_text(draw, draw.randint(0, 200), 3000)
        run = marks_off(draw.choice(items[:12])[1])
        for _ in range(draw.choice([0, 2, 5, len(run)])):  # edited copies; the last kind is no copy
            run[draw.randrange(len(run))] = f"other{draw.random()}"[:9]
        at = draw.randint(0, len(body))
        body[at:at] = run
        rows.append((100 + k, "; ".join(body) if k % 2 else " ".join(body).upper(), "s", "x"))
    return rows + [(400, "x TINY y", "s", "x"), (401, "two words", "s", "x"), (402, "a " * 60_000 + items[0][1], "s", "x"), rows[-1]], items


@pytest.mark.parametrize("least_hits", [1, 4])
def test_leaks(spark, least_hits, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_HITS", least_hits)
    rows, items = leaked(random.Random(4))
    found = decontamination.leaks(frame(spark, rows).withColumnRenamed("kept", "score"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "text", "source", "item_id", "score", "n_items", "contaminated"]
    texts = {i: marks_off(t.lower()) for i, t in items if t}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        run = marks_off((r["text"] or "").lower())
        exact = {i: scored(t, run) for i, t in texts.items()} if len(run) < 5000 else {0: 1.0}
        bad = sorted((-s, i) for i, s in exact.items() if s >= 0.5)
        assert r["n_items"] == len(bad) and r["contaminated"] == bool(bad), r["doc_id"]
        if bad:
            assert r["score"] == pytest.approx(-bad[0][0]) and r["item_id"] == bad[0][1]
    clean = decontamination.drop_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == DOCS.names and clean.count() == sum(not r["contaminated"] for r in got)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.leaks(frame(spark, EDGES), none).collect()
    assert len(found) == len(EDGES) and not any(r["contaminated"] for r in found)
    assert decontamination.leaks(frame(spark, []), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def test_an_item_leaked_everywhere_is_still_found(spark):
    draw = random.Random(2)
    item = " ".join(random_text(draw, 20, 100_000))
    rows = [(i, item + " " + " ".join(random_text(draw, 20, 3000)), "s", "x") for i in range(100)]
    assert decontamination.leaks(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").count() == 100


def test_edited_copies_beside_a_verbatim_one_are_found(spark):
    """Runs that edited copies share are common beside those that only the verbatim copy has."""
    draw = random.Random(6)
    item = [f"word{i}" for i in range(40)]
    edited = [f"other{i}" if i % 5 == 4 else x for i, x in enumerate(item)]
    copies = [edited] * 9 + [item]
    rows = [(i, " ".join(random_text(draw, 30, 3000) + run + random_text(draw, 30, 3000)), "s", "x") for i, run in enumerate(copies)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.leaks(frame(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["contaminated"]} == {(i, 1) for i in range(10)}
    assert all(r["score"] == pytest.approx(align(item, marks_off(r["text"]))) for r in found)
    assert decontamination.drop_leaks(frame(spark, rows), benchmark).count() == 0


def edited(draw, item, kind):
    """A copy with every second or third word replaced, doubled or followed by another, or random edits."""
    if kind == "third":
        return [x if i % 3 != 2 else f"other{i}" for i, x in enumerate(item)]
    if kind == "after each":
        return [y for i, x in enumerate(item) for y in (x, f"more{i}")]
    if kind == "half gone":
        return [x for i, x in enumerate(item) if i % 4 != 3]
    out = list(item)
    for _ in range(draw.randint(1, len(item) // 2)):
        at = draw.randrange(len(out))
        out[at : at + draw.randint(0, 1)] = [draw.choice(item + ["zz"])] * draw.randint(0, 2) if len(out) > 3 else out[at : at + 1]
    return out


def test_every_copy_within_the_limit_is_found(spark):
    """All pairs of text and item by brute force, with copies at the very limit and items of common words."""
    draw = random.Random(11)
    items = [[f"i{k}w{j}" for j in range(draw.randint(3, 40))] for k in range(10)] + [[f"w{draw.randint(0, 6)}" for _ in range(draw.randint(3, 30))] for _ in range(8)] + [["w1"] * 12]
    texts = [random_text(draw, draw.randint(0, 60), 8) for _ in range(30)]
    for k in range(150):
        item = items[draw.randrange(len(items))]
        copy = edited(draw, item, draw.choice(["third", "after each", "half gone", "any", "any", "any"]))
        texts.append(random_text(draw, draw.randint(0, 40), 50) + copy + random_text(draw, draw.randint(0, 40), 50))
    rows = [(i, " ".join(t), "s", "x") for i, t in enumerate(texts)]
    found = decontamination.leaks(frame(spark, rows), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {r["doc_id"]: (r["n_items"], r["item_id"], r["score"]) for r in found.collect()}
    close = 0
    for i, text in enumerate(texts):
        best = sorted((-s, k) for k, item in enumerate(items) if (s := align(item, text)) >= 0.5)
        close += bool(best) and -best[0][0] < 0.6
        assert got[i] == ((len(best), best[0][1], pytest.approx(-best[0][0])) if best else (0, None, 0.0)), i
    assert close > 20


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    _, same, times = np.unique(np.asarray(scores), return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[same]
    one = np.asarray(labels) == 1
    assert len(order) == len(labels)
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(("name", "label", "operator", "modulus", "rest"), [("op3_toxicity", "toxic", toxicity, 4, 2), ("op7_quality", "quality", quality, 5, 0)])
def test_held_out_accuracy(spark, name, label, operator, modulus, rest):
    from trialforge.llm.queries import QUERIES

    scored = QUERIES[name](spark, MEDIUM).toPandas()
    documents, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(scored["doc_id"]) == sorted(r[0] for r in documents.select("doc_id").collect())
    assert list(scored["held_out"]) == [zlib.crc32(str(i).encode()) % modulus == rest for i in scored["doc_id"]]
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.3) == (scored["predicted"] == 1)).all()
    known = scored.merge(labels.toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert area(held["score"], held[label]) > 0.98
    wrong = (held["predicted"] != held[label]).mean()
    assert wrong < 0.03


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_classifiers_on_edges(spark, score):
    docs = frame(spark, EDGES).withColumn("predicted", F.lit("theirs"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (4, 1, 1), (4, 0, 0), (7, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.where("false")):
        found = score(docs, given)
        assert found.columns == ["doc_id", "text", "source", "kept", "score", "predicted"]
        rows = found.collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert score(docs.where("false"), labels).count() == 0


def test_gradient_is_the_slope_of_the_loss():
    draw = np.random.default_rng(0)
    x, first, y = draw.normal(size=(9, quality.FIGURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    network = quality.Network.start(x, 0.5, 1)

    def loss():
        p = network.forward(x, first)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for weights, gradient in zip(network.weights, network.gradient(x, first, y)):
        at = tuple(0 for _ in weights.shape)
        kept = weights[at]
        weights[at] = kept + 1e-6
        above = loss()
        weights[at] = kept - 1e-6
        below = loss()
        weights[at] = kept
        assert gradient[at] == pytest.approx((above - below) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    draw = random.Random(order)
    rows = EDGES + [(100 + i, " ".join(random_text(draw, draw.randint(0, 60), 60)), "s", "x") for i in range(120)]
    train = F.col("doc_id") % 7 != 2
    scored = language_model.score_texts(frame(spark, rows), train, order=order, block_tokens=500, bucket_entries=200).collect()
    runs = [(i, [*words(t, lower=True), None]) for i, t, *_ in rows]
    counts = Counter(x for i, run in runs if i is not None and i % 7 != 2 for x in run)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(run), sum(counts[x] > 0 for x in run), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in run), 6)) for i, run in runs)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored) == want
    assert all(r["score"] < 0 for r in scored)


def test_probabilities_sum_to_one(spark):
    """With the weights of a context, a mixture over the vocabulary and the unknown word is a distribution."""
    rows = [(i, f"a b{' a' * (i % 3)} c", "s", "x") for i in range(40)] + [(1000 + i, x, "s", "x") for i, x in enumerate(["", "a", "b", "c", "unknown"])]
    scored = language_model.score_texts(frame(spark, rows), F.col("doc_id") < 1000).where("doc_id >= 1000").collect()
    score = {r["doc_id"]: r["score"] for r in scored}
    end = score[1000]
    assert sum(10**s for s in score.values()) > 10**end  # longer texts share what is left
    assert all(s < 0 for s in score.values())


def test_em_finds_the_mixture():
    draw = np.random.default_rng(1)
    q = draw.random((3, 4000))
    truth = np.array([0.2, 0.5, 0.3])
    chosen = (truth[:, None] * q).sum(0)
    weights = language_model.learn_weights(np.zeros(4000, int), chosen / q.mean(0), q)[0]
    assert weights == pytest.approx(truth, abs=0.05)
    assert weights.sum() == pytest.approx(1)


def test_bigrams_beat_single_words(spark):
    rows = [(i, " ".join(["x y z"] * (i % 5 + 1)), "s", "x") for i in range(200)]
    scored = language_model.score_texts(frame(spark, rows), F.col("doc_id") % 7 != 2).where("doc_id % 7 = 2").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1] / 2


def test_language_model_edges(spark):
    assert language_model.score_texts(frame(spark, []), F.lit(True)).count() == 0
    alone = language_model.score_texts(frame(spark, EDGES), F.lit(False)).collect()
    assert len(alone) == len(EDGES) and {r["train_tokens"] for r in alone} == {0} and {r["n_known"] for r in alone} == {0}


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com", "http://a.example.com/en/1?x://y", "ftp://www.example.com/en/x#a", "http://com/", "x://telecom/", "a://b://c/d",
    "http://news.net/es/", "http://net/fr/2", "http://net?/es/", "http://Évil.NET/es/", "http://u@example.com:80/en/", "http://www.example.com/de/", "//example.com/en/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "theirs") for i, u in enumerate(URLS)] + [(None, URLS[5], None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = url_filter.judge_urls(pages, labels)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict", "confidence"]
    assert len(found.collect()) == len(URLS) + 1
    for r in found.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"])
    assert url_filter.judge_urls(pages.where("false"), labels).count() == 0


def test_mined_rules(spark):
    """A host with a certain path is bad, either alone is not."""
    urls = [(i, f"http://{'spam' if i % 2 else 'good'}.org/{'win' if i % 3 else 'read'}/{i}?ref={i}") for i in range(240)]
    labels = [(i, 0 if i % 2 and i % 3 else 1, 0) for i in range(0, 200)] + [(None, 0, 1)]
    found = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in found.collect():
        bad = bool(r["page_id"] % 2 and r["page_id"] % 3)
        assert (r["verdict"] == "block") == bad and (r["confidence"] == 1.0 if bad else r["confidence"] is None)


def blocked_by_any_set(urls, labels, least=10, sure=0.8):
    """Confidence of the surest token set of each URL with enough labelled URLs, over all sets."""
    import itertools

    marked = [(tokens, labels[i]) for i, tokens in enumerate(urls) if i in labels]
    out = []
    for tokens in urls:
        best = None
        for size in range(1, len(tokens) + 1):
            for chosen in itertools.combinations(sorted(tokens), size):
                met = [bad for other, bad in marked if set(chosen) <= other]
                if sum(met) >= least and sum(met) / len(met) >= sure:
                    best = max(best or 0, sum(met) / len(met))
        out.append(best)
    return out


def test_mined_rules_are_those_of_all_token_sets(spark):
    draw, urls, sets = random.Random(12), [], []
    for i in range(160):
        host, words, ref = draw.choice(["one", "two"]), draw.sample(["win", "buy", "read", "cheap"], draw.randint(0, 2)), draw.choice(["spam", "feed", None])
        urls.append(f"http://{host}/{'-'.join(words)}{f'?ref={ref}' if ref else ''}")
        path = {f"path:{w}" for w in words} | ({f"path:{'-'.join(words)}"} if words else set())
        sets.append({f"host:{host}"} | path | ({"key:ref", f"value:ref={ref}"} if ref else set()))
    labels = {i: ("ref=spam" in u and "win" in u) or ("buy" in u and "one" in u and draw.random() < 0.9) for i, u in enumerate(urls) if i % 8}
    want = blocked_by_any_set(sets, labels)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, bad in labels.items()], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.confidence for r in url_filter.judge_urls(pages, marks).collect()}
    assert 0 < sum(w is not None for w in want) < len(urls)
    assert found == {i: pytest.approx(w) if w is not None else None for i, w in enumerate(want)}


def test_long_urls_with_much_in_common_are_mined_in_seconds(spark):
    import time

    shared = "/".join(f"word{k}" for k in range(60))
    urls = [f"http://host/{shared}/{i}" for i in range(24)]
    # Every other URL lacks one word of its own, so that no two words are one class.
    urls += [f"http://host/{'/'.join(f'word{k}' for k in range(60) if k != i)}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(0, len(urls), 2)], "doc_id long, quality int, toxic int")
    start = time.time()
    found = url_filter.judge_urls(pages, labels).collect()
    assert all(r["verdict"] == "block" for r in found) and time.time() - start < 60


def test_rules_on_classes_beyond_the_core(spark):
    """Two words that are bad together, each with 14 words in its URLs that are commoner and more often blocked."""
    draw, urls, labels = random.Random(4), [], []
    for i in range(240):
        bad = i % 8 < 2
        words = [f"often{k}" for k in range(14) if (i != 8 * k if bad else draw.random() < 0.55)]
        words += {0: ["one", "two"], 1: ["other"], 2: ["one"], 3: ["one"], 4: ["two"], 5: ["two"]}.get(i % 8, [])
        urls.append((i, f"http://host/{'/'.join(words)}"))
        labels.append((i, 0 if bad else 1, 0))
    urls += [(240, "http://host/one/two"), (241, "http://host/one"), (242, "http://host/two"), (243, "http://host/other/one")]
    found = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["page_id"]: (r["verdict"], r["confidence"]) for r in found.collect()}
    assert [found[i] for i in range(240, 244)] == [("block", 1.0), ("allow", None), ("allow", None), ("block", 1.0)]
    assert all(found[i] == ("block", 1.0) for i in range(240) if i % 8 < 2)


@pytest.mark.parametrize("most_classes", [1, 3])
def test_any_core_finds_the_rules_of_all_token_sets(spark, monkeypatch, most_classes):
    monkeypatch.setattr(url_filter, "ASKED", 3)
    draw, urls = random.Random(21), []
    for i in range(140):
        words = draw.sample(["win", "buy", "read", "cheap", "now", "free"], draw.randint(0, 5))
        urls.append(f"http://{draw.choice(['one', 'two'])}/{'/'.join(words)}")
    sets = [{f"host:{u.split('/')[2]}"} | {f"path:{w}" for w in u.split("/")[3:] if w} for u in urls]
    labels = {i: ("win" in u and "buy" in u and draw.random() < 0.9) or ("cheap" in u and "one" in u and "now" in u) or draw.random() < 0.1 for i, u in enumerate(urls) if i % 8}
    want = blocked_by_any_set(sets, labels)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, bad in labels.items()], "doc_id long, quality int, toxic int")
    found = {r.page_id: r.confidence for r in url_filter.judge_urls(pages, marks, most_classes=most_classes).collect()}
    assert len(set(want)) > 3
    assert found == {i: pytest.approx(w) if w is not None else None for i, w in enumerate(want)}


def test_a_rule_at_the_least_number_of_urls(spark):
    """10 / 147 x 147 is above 10 in doubles."""
    pages = spark.createDataFrame([(i, f"http://all/{'bad' if i < 10 else 'good'}") for i in range(147)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 10), 0) for i in range(147)], "doc_id long, quality int, toxic int")
    found = url_filter.judge_urls(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 10) for r in found)


def test_surest_set_is_that_of_all_sets():
    import itertools

    draw = np.random.default_rng(1)
    for _ in range(200):
        rows, columns = draw.integers(1, 40), draw.integers(0, 8)
        has = draw.random((rows, columns)) < draw.choice([0.3, 0.6, 0.9])
        bad, good = draw.integers(0, 4, rows) * (draw.random(rows) < 0.6), draw.integers(0, 3, rows)
        least, want = int(draw.integers(1, 12)), (start := float(draw.choice([0, 0.4, 0.8])))
        for chosen in itertools.chain.from_iterable(itertools.combinations(range(columns), n) for n in range(columns + 1)):
            met = has[:, list(chosen)].all(axis=1)
            if bad[met].sum() >= least:
                want = max(want, float(bad[met].sum() / (bad[met].sum() + good[met].sum())))
        assert url_filter.surest_set(has, bad, good, least, start) == want
