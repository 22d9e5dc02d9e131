"""URL filters: given rules first, then association rules mined from labelled URLs.

A labelled URL is a transaction of its tokens and, when its label says so, of the item for
blocking.  Tokens that occur in the same labelled URLs are one class, so that URLs with a long part in
common don't multiply into all subsets of it.  Spark's FP-growth finds frequent sets of classes; one that is
frequent with the item as well gives a rule, kept when its support and confidence reach their limits and
no rule on part of its classes is as sure.  Kept rules are indexed by their rarest class; a
URL meets only the rules of its own classes, and fits a rule when it has a token of each of the rule's classes.

FP-growth takes the core classes: those among the few commonest of every labelled URL that has them, so that no
URL brings more than a few.  All sets with another class are searched for the URLs to be judged, a group for
each such class: labelled URLs with it meet URLs to be judged with it, and branch and bound finds the surest set
that both have.  Each set belongs to the group of its last class outside the core, so none is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

# The rules that come first, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LEAST_URLS, LEAST_CONFIDENCE = 10, 0.8
MOST_CLASSES = 12  # core classes of a labelled URL at most; subsets double with each
ASKED = 500  # sets of URLs to be judged that one task searches beside one class
BLOCKED = "!block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for a URL without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))


def given_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``; else null."""
    name = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def url_tokens() -> Column:
    """Distinct tokens of ``host``, ``path`` and ``rest``: host labels and path words, whole and cut at
    ``-`` and ``_``, query keys, keys with their values, and the fragment.

    Path words that are numbers are left out: they name single pages.
    """
    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))

    def whole_and_cut(parts: Column) -> Column:
        cut = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, "[-_]"))))
        return F.filter(cut, lambda p: ~p.rlike("^[0-9]+$"))

    query = F.split(F.regexp_extract("rest", "[?]([^#]*)", 1), "&")
    keys = F.transform(query, lambda p: F.regexp_extract(p, "^[^=]*", 0))
    fragment = F.array(F.regexp_extract("rest", "#(.*)", 1))
    return F.array_distinct(F.concat(
        named("host:", whole_and_cut(F.split("host", "[.]"))), named("path:", whole_and_cut(F.split("path", "[/.]"))),
        named("key:", keys), named("value:", F.filter(query, lambda p: p.contains("="))), named("part:", fragment),
    ))


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` (url) with host, path and tokens."""
    parts = urls.withColumn("rest", after_scheme(F.col("url")))
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOWER)
    parts = parts.withColumn("host", host).withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1))
    return parts.withColumn("tokens", url_tokens()).drop("rest")


def token_classes(labelled: DataFrame, least_urls: int) -> DataFrame:
    """``labelled`` (row, tokens, blocked) to (token, class, urls, bad): tokens of at least ``least_urls`` rows.

    A class is named by its smallest token.  Rows are told by two 64-bit numbers, and equal sets of rows by
    their count and the exclusive or of both numbers.
    """
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    tokens = labelled.select("row", "blocked", F.explode("tokens").alias("token")).groupBy("token")
    counted = tokens.agg(F.count("*").alias("urls"), F.count_if("blocked").alias("bad"), *marks).where(F.col("urls") >= least_urls)
    same = Window.partitionBy("urls", "mark1", "mark2")
    return counted.select("token", F.min("token").over(same).alias("class"), "urls", "bad")


def held_classes(urls: DataFrame, classes: DataFrame) -> DataFrame:
    """``urls`` (token and others), a row for each token, to (others, held): classes of a URL, commonest first."""
    others = [c for c in urls.columns if c != "token"]
    place = F.struct((-F.col("urls")).alias("order"), "class", "core")
    return urls.join(classes, "token").groupBy(others).agg(F.array_sort(F.collect_set(place)).alias("held"))


def mine_rules(labelled: DataFrame, least_urls: int = LEAST_URLS, least_confidence: float = LEAST_CONFIDENCE, most_classes: int = MOST_CLASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``labelled`` (tokens, blocked) to rules (tokens, key, support, confidence), on classes, (token, class, urls, core), and the rest.

    A class is core when it is among the ``most_classes`` commonest of each labelled URL that has it; the rules are
    all those on core classes.  The rest (held, urls, bad) is all labelled URLs with another class, for ``surest_sets``.
    Classes with fewer than ``least_urls`` blocked URLs are in no rule and left out.
    """
    rows = checkpointed(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"))
    tokens = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    classes = checkpointed(token_classes(rows, least_urls).where(F.col("bad") >= least_urls).select("token", "class", "urls", F.lit(True).alias("core")))
    kept = checkpointed(held_classes(tokens, classes))
    beyond = kept.select(F.posexplode("held").alias("at", "one")).groupBy("one.class").agg((F.max("at") < most_classes).alias("core")).where("NOT core")
    beyond = checkpointed(beyond)
    if not beyond.isEmpty():
        classes = classes.drop("core").join(beyond, "class", "left").select("token", "class", "urls", F.coalesce("core", F.lit(True)).alias("core"))
        classes = checkpointed(classes)
        kept = checkpointed(held_classes(tokens, classes))
    core = F.filter("held", lambda one: one["core"])["class"]
    basket = F.when(F.col("blocked"), F.concat(core, F.array(F.lit(BLOCKED)))).otherwise(core)
    baskets = checkpointed(kept.where(F.size(core) > 0).select(basket.alias("items")))
    rules = rules_of(baskets, least_urls, least_confidence)
    rest = kept.where(other_class()).groupBy("held").agg(F.count("*").alias("urls"), F.count_if("blocked").alias("bad"))
    return rules, classes, rest


def other_class() -> Column:
    """Whether ``held`` has a class outside the core."""
    return F.exists("held", lambda one: ~one["core"])


def beside(urls: DataFrame) -> DataFrame:
    """``urls`` (held and others) to (others, key, beside), a row for each class outside the core, with the core
    classes and those before it outside the core."""
    each = urls.select("*", F.posexplode("held").alias("at", "one")).where("NOT one.core")
    near = F.filter("held", lambda one, at: (at < F.col("at")) | (one["core"] & (at != F.col("at"))))["class"]
    return each.withColumn("key", F.col("one.class")).withColumn("beside", near).drop("at", "one")


def surest_sets(asked: DataFrame, rest: DataFrame, least_urls: int, least_confidence: float) -> DataFrame:
    """``asked`` (held, confidence) to (held, confidence) where a set with a class outside the core is surer.

    The confidence is that of the surest set of classes in ``held`` that ``least_urls`` blocked URLs of ``rest`` have
    and that reaches ``least_confidence``.
    """
    known = F.coalesce("confidence", F.lit(0.0)).alias("known")
    asked = checkpointed(asked.where(other_class() & (F.coalesce("confidence", F.lit(0.0)) < 1)).select("held", known, F.monotonically_increasing_id().alias("id")))
    questions = beside(asked).drop("held")
    pieces = checkpointed(questions.groupBy("key").agg(F.ceil(F.count("*") / ASKED).alias("pieces")))
    questions = questions.join(pieces, "key").withColumn("piece", F.pmod(F.xxhash64("beside"), "pieces")).drop("pieces")
    sets = beside(rest).groupBy("key", "beside").agg(F.sum("urls").alias("urls"), F.sum("bad").alias("bad"))
    sets = sets.join(pieces, "key").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    found = sets.groupBy("key", "piece").cogroup(questions.groupBy("key", "piece")).applyInArrow(
        _surest(least_urls, math.nextafter(least_confidence, -1.0)), "id long, confidence double"
    )
    return asked.join(found.groupBy("id").agg(F.max("confidence").alias("confidence")), "id").select("held", "confidence")


def _surest(least: int, floor: float):
    def search(sets: pa.Table, questions: pa.Table) -> pa.Table:
        urls, bad = (sets[c].to_numpy() for c in ("urls", "bad"))
        near = sets["beside"].combine_chunks()
        row = np.repeat(np.arange(len(sets)), near.value_lengths().to_numpy())
        coded = near.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        often = np.flatnonzero(np.bincount(code, bad[row], len(coded.dictionary)) >= least)
        column = {coded.dictionary[int(c)].as_py(): k for k, c in enumerate(often)}
        has = np.zeros((len(sets), len(coded.dictionary)), bool)
        has[row, code] = True
        has = has[:, often]
        alike = {}
        for n, known, asked in zip(*(questions[c].to_pylist() for c in ("id", "known", "beside"))):
            alike.setdefault(tuple(column[c] for c in asked if c in column), []).append((n, max(known, floor)))
        out = []
        for columns, ids in alike.items():
            best = surest_set(has[:, list(columns)], bad, urls - bad, least, min(start for _, start in ids))
            out += [{"id": n, "confidence": best} for n, start in ids if best > start]
        return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("confidence", pa.float64())]))

    return search


def surest_set(has: np.ndarray, bad: np.ndarray, good: np.ndarray, least: int, best: float) -> float:
    """Confidence of the surest set of columns, or none, that ``least`` bad URLs have, if above ``best``; else ``best``.

    ``has`` says which rows have which columns, ``bad`` and ``good`` how many URLs a row stands for.  A column that
    all good URLs of a set have can't make it or a larger set surer.  A set and j columns more keep no more
    bad URLs than the j-th commonest column, and lose no more good ones than the j columns that lose most.
    """
    open_sets = [(has[bad > 0], bad[bad > 0], has[good > 0], good[good > 0])]
    while open_sets:
        has_bad, bad, has_good, good = open_sets.pop()
        kept, wrong = bad.sum(), good.sum()
        if kept < least:
            continue
        best = max(best, float(kept / (kept + wrong)))
        support, lost = bad @ has_bad, good @ ~has_good
        use = (support >= least) & (lost > 0)
        has_bad, has_good, support, lost = has_bad[:, use], has_good[:, use], support[use], lost[use]
        never_lost = good[has_good.all(axis=1)].sum()
        most = np.sort(support)[::-1]
        fewest = np.maximum(never_lost, wrong - np.cumsum(np.sort(lost)[::-1]))
        if not len(most) or (most / (most + fewest)).max() <= best:
            continue
        one = np.lexsort((support, support / (support + wrong - lost), support == kept))[-1]
        others = np.arange(len(support)) != one
        if support[one] < kept:  # else any set is as sure with it
            open_sets.append((has_bad[:, others], bad, has_good[:, others], good))
        meets_bad, meets_good = has_bad[:, one], has_good[:, one]
        open_sets.append((has_bad[meets_bad][:, others], bad[meets_bad], has_good[meets_good][:, others], good[meets_good]))
    return best


def rules_of(baskets: DataFrame, least_urls: int, least_confidence: float) -> DataFrame:
    """``baskets`` (items) to minimal rules for blocking."""
    n = baskets.count()
    shape = "tokens array<string>, key string, support long, confidence double"
    if n == 0:
        return baskets.sparkSession.createDataFrame([], shape)
    # FP-growth rounds support x n up; half a URL less keeps a rounded quotient from asking for one URL more.
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least_urls - 0.5) / n), minConfidence=1.0).fit(baskets).freqItemsets
    found = checkpointed(found.select(F.array_sort("items").alias("items"), "freq"))
    blocked = found.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("tokens"), F.col("freq").alias("support"))
    rules = blocked.join(found.withColumnRenamed("items", "tokens"), "tokens").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = rules.where(F.col("confidence") >= least_confidence).select("tokens", "support", "confidence")
    # A rule is redundant when leaving one token out gives a rule that is as sure.
    shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("one")).select("tokens", "confidence", F.array_remove("tokens", F.col("one")).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("known"))
    redundant = shorter.join(known, "part").where("known >= confidence").select("tokens").distinct()
    rules = rules.join(redundant, "tokens", "left_anti")
    single = found.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("urls"))
    rarest = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("urls", "token")).alias("key"))
    return rules.join(rarest, "tokens").select("tokens", "key", "support", "confidence")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", least_urls: int = LEAST_URLS, least_confidence: float = LEAST_CONFIDENCE, most_classes: int = MOST_CLASSES) -> DataFrame:
    """All rows of ``pages`` with host, path, the given rule that decides, and the verdict.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; the path follows up to ``?``, ``#`` or the end.  Both are empty for null and
    for a URL without ``://``.  A given rule fits its host and all subdomains when the path
    starts with the rule's; the longest wins.  Other URLs are blocked when a mined rule fits, on core
    classes or any others (``most_classes`` says how many a labelled URL has in the core at most, and changes cost only), else allowed.  A page is labelled by the row of ``labels`` with its id, to be blocked when
    ``quality`` is 0 or ``toxic`` is 1.  Adds host, path, rule (null: none), verdict and
    ``confidence`` (of the surest mined rule; null: none), which take the place of columns so named.  Repeated rows and ids
    are judged one by one; empty tables give empty results, and without labels no rule is mined.
    """
    added = ["host", "path", "rule", "verdict", "confidence"]
    rows = pages.select(packed(pages, added).alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    marked = labels.select(F.col(label_id_col).alias("id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("blocked"))
    marked = marked.groupBy("id").agg(F.max("blocked").alias("blocked"))
    mined, classes, rest = mine_rules(parsed(rows.select("id", "url")).join(marked, "id").select("tokens", "blocked"), least_urls, least_confidence, most_classes)
    mined = checkpointed(mined)
    urls = parsed(rows.select("url").where("url IS NOT NULL").distinct()).select("url", F.explode("tokens").alias("token"))
    known = held_classes(urls, classes).withColumn("classes", F.col("held")["class"])
    met = known.select("url", "classes", F.explode("classes").alias("key")).join(mined.withColumnRenamed("tokens", "needed"), "key")
    fitting = met.where(F.size(F.array_except("needed", "classes")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))
    if not classes.where("NOT core").isEmpty():
        asked = checkpointed(known.select("url", "held").join(fitting, "url", "left"))
        surer = surest_sets(asked.groupBy("held").agg(F.max("confidence").alias("confidence")), rest, least_urls, least_confidence)
        fitting = asked.join(surer.withColumnRenamed("confidence", "surer"), "held", "left").select("url", F.greatest("confidence", "surer").alias("confidence"))
    judged = parsed(rows).drop("tokens").join(fitting, "url", "left")
    rule, verdict = given_rule(rules)
    other = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select(*unpacked(judged, "row"), "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "confidence")
