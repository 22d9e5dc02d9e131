"""Quality: attention-based multiple-instance learning on passages.

A text is a bag of passages; only the text has a label.  Every passage is encoded by a dense
layer over its figures; gated attention gives each passage a weight, and the weighted sum of
the encodings is scored.  ``MEMBERS`` networks are fitted side by side, each in a task of its
own on its share of at most ``fit_rows`` labelled texts, and their probabilities are averaged.
Scoring reads all texts once and moves no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked
from .labelled import fit_sample
from .words import Words, text_words

FIT_ROWS = 9_000
MEMBERS = 3
THRESHOLD = 0.3
PASSAGE = 64  # words
HIDDEN, GATES = 16, 8
EPOCHS, BATCH, RATE = 30, 64, 0.01
# Groups of ASCII marks that are counted apart.
MARKS = [".", ",", "!?", "|", "#$%&*", "/@\\_=<>{}[]", "-'\"():;"]
FIGURES = 10 + len(MARKS)


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first passage of each row (and the end), and the figures of each passage.

    A text without words is one passage whose figures are all 0.
    """
    counts = np.diff(words.at)
    pieces = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(pieces)])
    row = np.repeat(np.arange(len(counts)), pieces)
    start = words.at[:-1][row] + PASSAGE * (np.arange(len(row)) - first[row])
    stop = np.minimum(start + PASSAGE, words.at[1:][row])
    n = np.maximum(stop - start, 1)
    data = words.data
    low = np.append(words.start, len(data))[start]
    high = np.where(stop > start, np.append(words.stop, len(data))[np.maximum(stop - 1, 0)], low)
    size = np.maximum(high - low, 1)

    def share(mask: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[end] - sums[begin]) / of

    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    sums_letters = np.concatenate([[0], np.cumsum(letter)])
    sums_upper = np.concatenate([[0], np.cumsum(upper)])
    letters = sums_letters[words.stop] - sums_letters[words.start]
    capitals = sums_upper[words.stop] - sums_upper[words.start]
    same = np.zeros(len(words), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    # Distinct words of a passage: a word counts where it comes first in the passage.
    piece = np.repeat(np.arange(len(row)), np.maximum(stop - start, 0))
    order = np.lexsort((words.hashes, piece))
    new = np.ones(len(words), bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (piece[order][1:] != piece[order][:-1])
    figures = [
        np.log1p(stop - start), share(words.stop - words.start, start, stop, n) / 10,
        share(new, start, stop, n), share(same, start, stop, n),
        share((capitals == letters) & (letters > 1), start, stop, n), share(letters == 0, start, stop, n),
        share(upper, low, high, size), share(digit, low, high, size), share(data == 10, low, high, n), share(data >= 128, low, high, size),
    ]
    for marks in MARKS:
        figures.append(share(np.isin(data, np.frombuffer(marks.encode(), np.uint8)), low, high, n))
    out = np.stack(figures, axis=1)
    out[stop <= start] = 0
    return first, out


class Network:
    """Gated attention over the passages of each text."""

    def __init__(self, weights: list[np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    @classmethod
    def start(cls, x: np.ndarray, rate: float, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
        weights = [draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        weights[4], weights[5] = draw.normal(0, 0.3, GATES), draw.normal(0, 0.3, HIDDEN)
        weights[6][0] = np.log(rate / (1 - rate))
        return cls(weights, x.mean(0), x.std(0) + 1e-6)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w1, b1, v, u, w, c, b = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ w
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, first[:-1])[text])
        a /= np.add.reduceat(a, first[:-1])[text]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        p = 1 / (1 + np.exp(-np.clip(z @ c + b[0], -30, 30)))
        return x, h, t, s, text, a, z, p

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        _, _, v, u, w, c, _ = self.weights
        x, h, t, s, text, a, z, p = self.forward(x, first)
        error = (p - y) / len(y)
        dz = error[:, None] * c
        da = (h * dz[text]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[text])
        dv, du = de[:, None] * w * s * (1 - t * t), de[:, None] * w * t * s * (1 - s)
        dh = (a[:, None] * dz[text] + dv @ v.T + du @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dv, h.T @ du, (t * s).T @ de, z.T @ error, np.array([error.sum()])]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int) -> None:
        """Adam over batches of texts, with a rate that falls to a tenth."""
        draw = np.random.default_rng(seed)
        one, two, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.1 ** (epoch / EPOCHS)
            order = draw.permutation(len(y))
            for k in range(0, len(y), BATCH):
                chosen = order[k : k + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
                ends = np.concatenate([[0], np.cumsum(first[chosen + 1] - first[chosen])])
                step += 1
                for w, g, m, q in zip(self.weights, self.gradient(x[rows], ends, y[chosen]), one, two):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)

    def pack(self) -> list[float]:
        return np.concatenate([w.ravel() for w in [*self.weights, self.mean, self.scale]]).tolist()

    @classmethod
    def unpack(cls, values: list[float]) -> Network:
        shapes = [(FIGURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,), (FIGURES,), (FIGURES,)]
        parts = np.split(np.array(values), np.cumsum([np.prod(s) for s in shapes])[:-1])
        parts = [p.reshape(s) for p, s in zip(parts, shapes)]
        return cls(parts[:7], *parts[7:])


def _fit(member: pa.Table) -> pa.Table:
    """One network on one share of the sample."""
    table = member.sort_by("id")
    firsts, figures, total = [np.zeros(1, np.int64)], [], 0
    for _, _, words in text_words(table.column("text"), lower=False):
        first, x = passages(words)
        firsts.append(first[1:] + total)
        figures.append(x)
        total += len(x)
    x, first = np.concatenate(figures), np.concatenate(firsts)
    y = table.column("label").to_numpy().astype(float)
    seed = int(table.column("member")[0].as_py())
    network = Network.start(x, (y.sum() + 1) / (len(y) + 2), seed)
    network.fit(x, first, y, seed)
    return pa.table([pa.array([seed], pa.int64()), pa.array([network.pack()], pa.list_(pa.float64()))], names=["member", "weights"])


def _score(networks: list[Network]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n != "text"])
            for begin, end, words in text_words(batch.column("text"), lower=False):
                first, x = passages(words)
                p = np.mean([n.forward(x, first)[-1] for n in networks], axis=0) if networks else np.full(end - begin, 0.5)
                kept = rest.slice(begin, end - begin)
                yield pa.record_batch([*kept.columns, pa.array(p)], [*kept.schema.names, "score"])

    return run


class QualityModel:
    """The fitted networks; ``score`` applies them to every row of a table."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, members: int = MEMBERS):
        sample = fit_sample(docs, labels, label, train, id_col, text_col, fit_rows)
        shares = sample.withColumn("member", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(members)))
        fitted = shares.groupBy("member").applyInArrow(_fit, "member long, weights array<double>").collect()
        self.networks = [Network.unpack(r["weights"]) for r in sorted(fitted, key=lambda r: r["member"])]

    def score(self, texts: DataFrame, keep: list[str]) -> DataFrame:
        """``texts`` (``keep`` and text) with ``score``, without the text."""
        columns = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
        return texts.select(*keep, "text").mapInArrow(_score(self.networks), f"{columns}, score double")


def quality(docs: DataFrame, labels: DataFrame, train: Callable[[Column], Column] = lambda id: F.lit(True), label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    ``train`` says of an id whether its label may be learned.  Labels other than 0 and 1 and
    labels without a text are left out; without any label every score is 0.5.  Null and empty
    texts are one passage without words.  The new columns take the place of columns so named;
    an empty table gives an empty table.
    """
    model = QualityModel(docs, labels, label, train, id_col, text_col, fit_rows)
    rows = docs.select(packed(docs, ["score", "predicted"]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = model.score(rows, ["row"])
    return scored.select(*unpacked(scored, "row"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
