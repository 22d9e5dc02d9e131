"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and beginnings of words that are much more frequent in toxic
than in other labelled texts, weighted by log odds.  The features of a labelled text come
from the lexicon of the other half of the labelled texts, so that trees never see weights
their own labels made; texts to be scored get the lexicon of both halves.

The fit reads at most ``fit_rows`` labelled rows, chosen by a hash of their id.  Scoring
reads all texts once and moves no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .common import checkpointed, packed, unpacked
from .labelled import fit_sample
from .words import Words, text_words

FIT_ROWS = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8, 9)  # lengths of word beginnings, in bytes
LEAST_DOCS, LEAST_ODDS = 3, 1.5  # toxic texts that have a lexicon entry, and its least log odds
STRONG = 3.0  # log odds
NEAR = 6  # words
FEATURES = [
    "top_odds", "top_three", "odds_density", "strong_density", "weak_density", "strong_words", "second_person",
    "near_second_person", "capitals", "capital_words", "marks", "loud_marks", "hidden_letters", "digits_in_words",
    "letter_runs", "words",
]
# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti contigo tuyo usted ustedes vosotros"
).split()


def _hashes(words: list[str]) -> np.ndarray:
    column = pa.array([" ".join(words)])
    return np.unique(np.concatenate([w.hashes for _, _, w in text_words(column, lower=True, marks=True)]))


def entries(words: Words) -> Iterator[np.ndarray]:
    """Numbers for all words, then for their beginnings of each length (0: none)."""
    yield words.hashes
    for k in PREFIXES:
        yield words.prefixes(k)


class Lexicon:
    def __init__(self, entry: np.ndarray, odds: np.ndarray):
        order = np.argsort(entry)
        self.entry, self.odds = entry[order], odds[order]

    def of(self, words: Words) -> np.ndarray:
        """The highest log odds of each word's entries, 0 without any."""
        best = np.zeros(len(words))
        if len(self.entry):
            for numbers in entries(words):
                place = np.searchsorted(self.entry, numbers)
                place[place == len(self.entry)] = 0
                np.maximum(best, np.where(self.entry[place] == numbers, self.odds[place], 0), out=best)
        return best


def features(words: Words, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    rows = len(words.at) - 1
    out = np.zeros((rows, len(FEATURES)))
    odds = lexicon.of(words)
    you = np.isin(words.hashes, second)
    data = words.data
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & ~letter & ~digit & (data < 127)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = letter[:-2] & letter[2:]
    triple = np.zeros(len(data), bool)
    triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    lengths = np.maximum(np.diff(words.bounds), 1)
    starts_upper = upper[words.start] & (words.stop - words.start > 1)
    second_upper = upper[np.minimum(words.start + 1, max(len(data) - 1, 0))] if len(words) else np.empty(0, bool)
    loud = starts_upper & second_upper
    for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
        if a == b:
            continue
        w, n = odds[a:b], b - a
        top = np.sort(np.partition(w, max(0, n - 3))[max(0, n - 3) :])[::-1]
        strong = np.flatnonzero(w >= STRONG)
        pronouns = np.flatnonzero(you[a:b])
        near = 0.0
        if len(strong) and len(pronouns):
            after = np.searchsorted(pronouns, strong)
            left = strong - pronouns[np.maximum(after - 1, 0)]
            right = pronouns[np.minimum(after, len(pronouns) - 1)] - strong
            near = float(np.mean(np.minimum(np.abs(left), np.abs(right)) <= NEAR))
        out[k, :8] = [
            top[0], top.sum(), w.sum() / n, len(strong) / n, np.count_nonzero((w > 0) & (w < STRONG)) / n,
            np.log1p(len(strong)), len(pronouns) / n, near,
        ]
        out[k, 9] = loud[a:b].mean()
        out[k, 15] = np.log1p(n)
    for at, mask in ((8, upper), (10, mark), (11, (data == 33) | (data == 63)), (12, mark & inner), (13, digit & inner), (14, triple)):
        out[:, at] = words.count(mask) / lengths
    return out


def _features(lexicons: list[Lexicon], by: str | None):
    """Features of every text; column ``by`` tells which lexicon to take, else the first."""
    second = _hashes(SECOND_PERSON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n != "text"])
            for first, last, words in text_words(batch.column("text"), lower=True, marks=True):
                made = [features(words, lexicon, second) for lexicon in lexicons]
                rows = made[0]
                if by:
                    choice = batch.column(by).slice(first, last - first).to_numpy(zero_copy_only=False)
                    rows = np.where((choice == 0)[:, None], made[0], made[1])
                kept = rest.slice(first, last - first)
                yield pa.record_batch([*kept.columns, *(pa.array(c) for c in rows.T)], [*kept.schema.names, *FEATURES])

    return run


def _entry_counts(wanted):
    """Rows (entry, half, toxic, texts) for each task: texts that have each wanted entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in text_words(batch.column("text"), lower=True, marks=True):
                row = np.repeat(np.arange(last - first), np.diff(words.at))
                half, toxic = (batch.column(c).slice(first, last - first).to_numpy(zero_copy_only=False) for c in ("half", "label"))
                group = half.astype(np.int64) * 2 + toxic
                found, groups = [], []
                for numbers in entries(words):
                    known = (numbers != 0) if wanted is None else (numbers != 0) & wanted.value.has(numbers)
                    pair = np.unique(np.stack([numbers[known], row[known].astype(np.uint64)]), axis=1) if known.any() else np.empty((2, 0), np.uint64)
                    found.append(pair[0])
                    groups.append(group[pair[1].astype(np.int64)])
                entry, key = np.concatenate(found), np.concatenate(groups)
                for g in np.unique(key):
                    values, times = np.unique(entry[key == g], return_counts=True)
                    n = len(values)
                    yield pa.record_batch(
                        [pa.array(values.astype(np.int64)), pa.array(np.full(n, g // 2)), pa.array(np.full(n, g % 2)), pa.array(times)],
                        ["entry", "half", "label", "texts"],
                    )

    return run


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Of ``sample`` (text, label, half): the lexicon of half 1, of half 0, and of both.

    Entries are counted and weighed in Spark; only the lexicons come to the driver, which are
    part of the entries that ``LEAST_DOCS`` toxic texts of the bounded sample have.
    """
    kind = "entry long, half long, label long, texts long"
    toxic = sample.where("label = 1").mapInArrow(_entry_counts(None), kind).groupBy("entry").agg(F.sum("texts").alias("texts"))
    wanted = checkpointed(toxic.where(F.col("texts") >= LEAST_DOCS).select("entry"))
    held = sample.sparkSession.sparkContext.broadcast(Bitmap(wanted, "entry"))
    totals = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    texts = {(h, t): F.sum(F.when((F.col("half") == h) & (F.col("label") == t), F.col("texts")).otherwise(0)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)}
    counts = sample.mapInArrow(_entry_counts(held), kind).join(wanted, "entry", "left_semi").groupBy("entry").agg(*texts.values())

    def odds(halves: list[int]) -> Column:
        """Log odds of an entry in the halves; null where it is too rare or too weak."""
        seen = [sum(F.col(f"n{h}{t}") for h in halves) for t in (0, 1)]
        n = [sum(totals.get((h, t), 0) for h in halves) + 1 for t in (0, 1)]
        value = F.log((seen[1] + 0.3) / n[1]) - F.log((seen[0] + 1.0) / n[0])
        return F.when((value >= LEAST_ODDS) & (seen[1] >= (LEAST_DOCS if len(halves) > 1 else min(LEAST_DOCS, 2))), value)

    kept = counts.select("entry", odds([1]).alias("one"), odds([0]).alias("zero"), odds([0, 1]).alias("both"))
    kept = kept.where(F.coalesce("one", "zero", "both").isNotNull()).toPandas()

    def lexicon(name: str) -> Lexicon:
        mine = kept[kept[name].notna()]
        return Lexicon(mine["entry"].to_numpy(np.int64).astype(np.uint64), mine[name].to_numpy(float))

    return [lexicon(name) for name in ("one", "zero", "both")]


class ToxicityModel:
    """Trees, calibration and lexicon; ``score`` applies them to every row of a table."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, trees: int = 20, depth: int = 3):
        sample = fit_sample(docs, labels, label, train, id_col, text_col, fit_rows)
        sample = sample.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
        self.kind = sample.schema["id"].dataType.simpleString()
        other, one, self.lexicon = learn_lexicons(sample.select("text", "label", "half"))
        columns = ", ".join(f"{f} double" for f in FEATURES)
        rows = sample.select("id", "label", "half", "text").mapInArrow(_features([other, one], "half"), f"id {self.kind}, label int, half long, {columns}")
        rows = checkpointed(rows.coalesce(4))
        classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        self.trees = self.curve = None
        self.rate = classes.get(1, 0) / max(1, sum(classes.values()))
        if min(classes.get(0, 0), classes.get(1, 0)) < 2:
            return  # one class only: every text gets its share
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="dense")
        known = self.assembler.transform(rows).select("id", F.col("label").cast("double").alias("label"), "dense")
        calibration = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0
        fit, held = known.where(~calibration), known.where(calibration)
        if fit.select("label").distinct().count() < 2 or held.isEmpty():
            fit = held = known
        self.trees = GBTClassifier(featuresCol="dense", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, maxBins=64).fit(fit)
        self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(self._raw(held))

    def _raw(self, dense: DataFrame) -> DataFrame:
        return self.trees.transform(dense).withColumn("raw", vector_to_array("probability")[1])

    def score(self, texts: DataFrame, keep: list[str]) -> DataFrame:
        """``texts`` (``keep`` and text) with ``score``, without the text."""
        columns = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
        doubles = ", ".join(f"{f} double" for f in FEATURES)
        rows = texts.select(*keep, "text").mapInArrow(_features([self.lexicon], None), f"{columns}, {doubles}")
        if self.trees is None:
            return rows.select(*keep, F.lit(float(self.rate)).alias("score"))
        done = self.curve.transform(self._raw(self.assembler.transform(rows)))
        # Isotonic steps tie many texts; a thousandth of the trees' own probability keeps their order.
        score = 0.999 * F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("raw")
        return done.select(*keep, score.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, train: Callable[[Column], Column] = lambda id: F.lit(True), label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    ``train`` says of an id whether its label may be learned.  Labels other than 0 and 1 and
    labels without a text are left out; without both classes every score is the share of 1.
    Null and empty texts are scored as texts without words.  The new columns take the place
    of columns so named; an empty table gives an empty table.
    """
    model = ToxicityModel(docs, labels, label, train, id_col, text_col, fit_rows)
    rows = docs.select(packed(docs, ["score", "predicted"]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = model.score(rows, ["row"])
    return scored.select(*unpacked(scored, "row"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the columns of ``docs``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    model = ToxicityModel(docs, labels, "toxic", lambda id: F.lit(True), id_col, text_col)
    scored = model.score(docs.select(whole, F.coalesce(F.col(text_col), F.lit("")).alias("text")), ["doc"])
    return scored.where(F.col("score") < THRESHOLD).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
