"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A match counts 2, a mismatch or a gap -1; the score is the best local alignment over that of
the whole item with itself.  Seeds are pairs of words that stand next to each other or have one word
between them, in the item and in the text alike.  How many a copy must share follows from the score:

    An alignment with m matches and ``ops`` mismatches and gaps scores 2m - ops.  For an item of n
    words and a limit s, 2m - ops >= 2ns.  If q of the m - 1 intervals between matches have two ops or
    more, then 2q <= ops <= 2m - 2ns, so at least ns - 1 intervals have one op at most: their two
    matches are next to each other, or one word apart, on both sides.

So a copy shares at least t = ceil(ns - 1) of the 2n - 3 places of seeds in the item.  When all but the
t - r places that are most frequent in the corpus are kept, r of them still hit: rare seeds lose no
copy, however often copies or common words occur.

1. One scan counts the items' seeds in the corpus; each item keeps its rarest places.
2. A second scan emits the hits of kept seeds, and joins give (text, item) pairs with r places or more.
3. Only texts with such a pair travel, once; the stretches around hits, which hold any alignment
   that reaches the limit, are joined to the items' words and aligned.

The scans look seeds up in a bitmap of bounded size; what it lets through by chance meets nothing
in the join.  So the number of scans doesn't depend on the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import Bitmap, likely_in
from .common import checkpointed, packed, unpacked
from .words import ODD, Words, mixed, text_words

LEAST_SCORE = 0.5
LEAST_HITS = 4  # places that a pair must share to be aligned, where the limit allows so many
MATCH, OTHER = 2, -1
CELLS = 1 << 20  # cells of alignments that advance together
SPREAD = 64  # bits of the bitmap for each seed
_PAIR, _SINGLE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def pair_seeds(h: np.ndarray, d: int) -> np.ndarray:
    """A number for each word and the one ``d`` places on; equal pairs are equal at every distance."""
    return mixed(h[:-d] * ODD + mixed(h[d:]))


def item_seeds(h: np.ndarray) -> np.ndarray:
    """The seeds of an item at its places; an item of one or two words is a seed as a whole."""
    if len(h) == 1:
        return mixed(h ^ _SINGLE)
    if len(h) == 2:
        return mixed(pair_seeds(h, 1) ^ _PAIR)
    return np.concatenate([pair_seeds(h, 1), pair_seeds(h, 2)])


def text_seeds(words: Words, short: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, seed) for all seeds of some texts; those of items of one or two words where ``short`` has them."""
    h, row = words.hashes, np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    found = []
    for d in (1, 2):
        at = np.flatnonzero(row[:-d] == row[d:])
        seed = pair_seeds(h, d)[at]
        found.append((at, seed))
        if d == 1 and 2 in short:
            found.append((at, mixed(seed ^ _PAIR)))
    if 1 in short:
        found.append((np.arange(len(h)), mixed(h ^ _SINGLE)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _long(numbers: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(numbers).view(np.int64))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, words) of the items that have words."""
    for batch in batches:
        for first, _, words in text_words(batch.column("text"), lower=True, marks=True):
            rows = np.flatnonzero(np.diff(words.at))
            lists = pa.array([words.hashes[words.at[k] : words.at[k + 1]].view(np.int64) for k in rows], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("item").take(pa.array(first + rows)), lists], ["item", "words"])


def _item_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, n, place, seed) from (item, words)."""
    for batch in batches:
        for item, words in zip(batch.column("item").to_pylist(), batch.column("words")):
            h = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            seeds = item_seeds(h)
            k = len(seeds)
            yield pa.record_batch([pa.array([item] * k, pa.int64()), pa.array([len(h)] * k, pa.int64()), pa.array(np.arange(k)), _long(seeds)], ["item", "n", "place", "seed"])


def _counts(held, short: set[int]):
    """Rows (seed, times): how often texts have the seeds of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in text_words(batch.column("text"), lower=True, marks=True):
                _, seed = text_seeds(words, short)
                seed, times = np.unique(seed[held.value.has(seed)], return_counts=True)
                yield pa.record_batch([_long(seed), pa.array(times)], ["seed", "times"])

    return run


def _hits(held, short: set[int]):
    """Rows (id, h, at, seed): where texts have seeds of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in text_words(batch.column("text"), lower=True, marks=True):
                at, seed = text_seeds(words, short)
                k = np.flatnonzero(held.value.has(seed))
                row = np.searchsorted(words.at, at[k], "right") - 1
                who = pa.array(first + row)
                yield pa.record_batch([batch.column("id").take(who), batch.column("h").take(who), pa.array((at[k] - words.at[row]).astype(np.int64)), _long(seed[k])], ["id", "h", "at", "seed"])

    return run


def kept_places(items: DataFrame, texts: DataFrame, least_score: float) -> tuple[DataFrame, set[int]]:
    """(seed, item, n, needed, places): the rarest places of each item, by seed; and the lengths of short items.

    ``needed`` is the number of kept places that a text within the limit has.
    """
    places = checkpointed(items.mapInArrow(_item_places, "item long, n long, place long, seed long"))
    short = {r["n"] for r in places.where("n <= 2").select("n").distinct().collect()}
    seeds = checkpointed(places.select("seed").distinct())
    held = texts.sparkSession.sparkContext.broadcast(Bitmap(seeds, "seed", SPREAD))
    counted = texts.select("text").mapInArrow(_counts(held, short), "seed long, times long").groupBy("seed").agg(F.sum("times").alias("times"))
    counted = checkpointed(counted.join(seeds, "seed", "left_semi"))
    shared = F.when(F.col("n") <= 2, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") * least_score - 1 - 1e-9)))
    ranked = (
        places.join(counted, "seed", "left")
        .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("times", F.lit(0)), "place")))
        .withColumn("all", F.count("*").over(Window.partitionBy("item")))
        .withColumn("shared", shared).withColumn("needed", F.least("shared", F.lit(LEAST_HITS)))
    )
    kept = ranked.where(F.col("rank") <= F.col("all") - F.col("shared") + F.col("needed"))
    return checkpointed(kept.groupBy("seed", "item", "n", "needed").agg(F.collect_list("place").alias("places"))), short


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each item with its text, all pairs advancing together."""
    n, m = max(map(len, items)), max(map(len, texts))
    item = np.full((len(items), n), -1, np.int32)
    text = np.zeros((len(texts), m), np.int32)
    for k, (i, t) in enumerate(zip(items, texts)):
        item[k, : len(i)], text[k, : len(t)] = i, t
    slope = -OTHER * np.arange(m, dtype=np.int32)
    last = np.zeros((len(items), m + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for i in range(n):
        pair = np.where(text == item[:, i : i + 1], MATCH, OTHER).astype(np.int32)
        now = np.maximum(np.maximum(last[:, :-1] + pair, last[:, 1:] + OTHER), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps in the item
        last[:, 1:] = now
        np.maximum(best, now.max(axis=1), out=best)
    return best


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, item, stretch): the words of (id, text) around the hits of its items.

    An alignment within the limit spans at most 2n words of the text.
    """
    for batch in batches:
        found = batch.column("found").to_pylist()
        for first, last, words in text_words(batch.column("text"), lower=True, marks=True):
            rows, items, stretches = [], [], []
            for k in range(first, last):
                low, high = words.at[k - first], words.at[k - first + 1]
                for f in found[k] or ():
                    reach, at = 2 * f["n"], np.sort(f["at"])
                    ends = np.flatnonzero(np.diff(at) > 2 * reach)
                    for a, b in zip([0, *(ends + 1)], [*ends, len(at) - 1]):
                        rows.append(k)
                        items.append(f["item"])
                        stretches.append(words.hashes[max(low, low + at[a] - reach) : min(high, low + at[b] + reach + 1)].view(np.int64))
            yield pa.record_batch([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(stretches, pa.list_(pa.int64()))], ["id", "item", "stretch"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, item, score) from (id, item, words, stretch)."""
    for batch in batches:
        pairs = []
        for words, stretch in zip(batch.column("words"), batch.column("stretch")):
            item, text = (x.values.to_numpy(zero_copy_only=False) for x in (words, stretch))
            known, place = np.unique(item, return_inverse=True)
            at = np.minimum(np.searchsorted(known, text), len(known) - 1)
            pairs.append(((place + 1).astype(np.int32), np.where(known[at] == text, at + 1, 0).astype(np.int32)))
        order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
        scores, at = np.zeros(len(pairs)), 0
        while at < len(order):
            width = len(pairs[order[min(at + 512, len(order)) - 1]][1]) + 1
            group = order[at : at + max(1, min(512, CELLS // width))]
            best = align([pairs[k][0] for k in group], [pairs[k][1] for k in group])
            for k, score in zip(group, best):
                scores[k] = score / (MATCH * len(pairs[k][0]))
            at += len(group)
        yield pa.record_batch([batch.column("id"), batch.column("item"), pa.array(scores)], ["id", "item", "score"])


def alignments(texts: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``texts`` (id, text) and ``items`` (item, words) to (id, item, score) for every pair within the limit, and a few others."""
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    texts = texts.select("id", F.hash("text").alias("h"), "text")
    seeds, short = kept_places(items, texts, least_score)
    held = spark.sparkContext.broadcast(Bitmap(seeds, "seed", SPREAD))
    hits = texts.mapInArrow(_hits(held, short), f"id {kind}, h int, at long, seed long")
    met = hits.join(seeds, "seed").groupBy("id", "h", "item").agg(
        F.first("n").alias("n"), F.first("needed").alias("needed"), F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")
    )
    enough = met.where(F.size("places") >= F.col("needed"))
    found = enough.groupBy("id", "h").agg(F.collect_list(F.struct("item", "n", "at")).alias("found"))
    found = checkpointed(found.withColumn("key", F.xxhash64("id", "h")))
    likely = likely_in(texts.withColumn("key", F.xxhash64("id", "h")), "key", found, "key")
    same = likely["id"].eqNullSafe(found["id"]) & (likely["h"] == found["h"])
    stretches = likely.join(found, same).select(likely["id"], "text", "found").mapInArrow(_stretches, f"id {kind}, item long, stretch array<long>")
    pairs = stretches.join(items, "item").select("id", "item", "words", "stretch")
    return pairs.mapInArrow(_align, f"id {kind}, item long, score double")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """All rows of ``docs`` with the test item that each resembles most.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  Adds
    ``item_id`` (of equal scores the smallest) and ``score`` of the best item that reaches
    ``least_score`` (null and 0 if none does), ``n_items`` (items that do) and ``contaminated``
    (at least one does), which take the place of columns so named.  Null and empty texts and
    items match nothing; an empty benchmark leaves all rows clean; rows that repeat an id
    share the highest score.  An item of one or two words is met only as a whole.
    """
    added = ["item_id", "score", "n_items", "contaminated"]
    rows = docs.select(packed(docs, added).alias("row"), F.col(id_col).alias("row_id"))
    best = scores(docs, benchmark, id_col, text_col, item_col, item_text_col, least_score)
    joined = rows.join(best, rows["row_id"].eqNullSafe(best["id"]), "left")
    return joined.select(
        *unpacked(rows, "row"), F.col("best.item_id").alias("item_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"),
    )


def scores(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row (id, best, n_items) for each id of ``docs`` with an item that reaches ``least_score``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = checkpointed(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    items = checkpointed(named.mapInArrow(_item_words, "item long, words array<long>"))
    aligned = alignments(texts, items, least_score).where(F.col("score") >= least_score).groupBy("id", "item").agg(F.max("score").alias("score"))
    found = aligned.join(named.select("item", "item_id"), "item")
    top = F.struct((-F.col("score")).alias("order"), F.col("item_id").isNull().alias("unnamed"), "item_id", "score")
    return found.groupBy("id").agg(F.min(top).alias("best"), F.count("*").alias("n_items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that resemble no test item, with the columns of ``docs``."""
    bad = scores(docs, benchmark, id_col, text_col, item_col, item_text_col).select("id")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id"]), "left_anti")
