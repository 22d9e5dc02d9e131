"""LM scoring by deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates of all orders, from
the uniform one up; the weights depend on how often the longest context was met (in buckets
of powers of two) and are learned by expectation-maximisation on the training texts of a
held-out part, with counts of the other part.  Scores then take counts of both parts.

Occurrences never travel one by one.  Texts are put into blocks; a block sends each of its
distinct n-grams once, with counts, to the hash bucket of the n-gram.  Buckets add the counts of all
blocks and send the sums back.  An n-gram is one entry of a block however frequent it is, so
no word makes a bucket hot.  Blocks and buckets are rows of bounded size that Spark shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .words import mixed, text_words

ORDER = 2
BLOCK_TOKENS = 1_000_000
BUCKET_ENTRIES = 1_000_000
STEPS, TOLERANCE = 200, 1e-9  # of the EM; it stops when the gain in log likelihood falls below
CELLS = 8  # grid cells for each doubling of an estimate, in what the EM sees
UNTRAINED, FIT, WEIGHTS = 0, 1, 2  # roles of texts
_END, _START = np.uint64(0x5DEECE66D1B54A33), np.uint64(0x2545F4914F6CDD1D)


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _blocks(kind: pa.DataType, most: int):
    """Rows (block, weighs, ids, lengths, roles, vocabulary, tokens): texts as word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_ = {False: [], True: []}  # (ids, roles, lengths, tokens) of texts for each kind of block

        def close(weighs: bool) -> pa.RecordBatch:
            nonlocal made
            parts, open_[weighs] = open_[weighs], []
            vocabulary, tokens = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            made += 1
            ids = pa.concat_arrays([p[0] for p in parts])
            rows = [np.concatenate([p[k] for p in parts]) for k in (2, 1)]
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.record_batch(
                [
                    pa.array([(task << 32) + made], pa.int64()), pa.array([weighs]), pa.ListArray.from_arrays(ends, ids),
                    *(pa.ListArray.from_arrays(ends, pa.array(r, pa.int64())) for r in rows),
                    pa.array([_pack(np.diff(vocabulary, prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(tokens.astype(np.uint32))], pa.binary()),
                ],
                ["block", "weighs", "ids", "lengths", "roles", "vocabulary", "tokens"],
            )

        for batch in batches:
            for first, last, words in text_words(batch.column("text"), lower=True):
                n = last - first
                row = np.repeat(np.arange(n), np.diff(words.at))
                tokens = np.empty(len(words) + n, np.uint64)
                tokens[np.arange(len(words)) + row] = words.hashes
                tokens[words.at[1:] + np.arange(n)] = _END
                lengths = np.diff(words.at) + 1
                ids, roles = (batch.column(c).slice(first, n) for c in ("id", "role"))
                roles = roles.to_numpy(zero_copy_only=False).astype(np.int64)
                for weighs in (False, True):
                    mine = (roles == WEIGHTS) == weighs
                    if mine.any():
                        open_[weighs].append((ids.filter(pa.array(mine)).cast(kind), roles[mine], lengths[mine], tokens[np.repeat(mine, lengths)]))
                        if sum(len(p[3]) for p in open_[weighs]) >= most:
                            yield close(weighs)
        for weighs in (False, True):
            if open_[weighs]:
                yield close(weighs)

    return run


class Block:
    """A block's texts and its n-grams: for each order the numbers of all runs that end at a token."""

    def __init__(self, row: dict, order: int):
        self.lengths = np.array(row["lengths"])
        self.roles = np.array(row["roles"])
        self.first = np.cumsum(self.lengths) - self.lengths
        tokens = np.cumsum(_unpack(row["vocabulary"], np.uint64))[_unpack(row["tokens"], np.uint32)]
        # The last two bits of an n-gram's number are its order less one, so orders never mix.
        run, back, self.grams = tokens, tokens, []
        for n in range(order):
            if n:
                back = np.concatenate([[_START], back[:-1]])
                back[self.first] = _START  # texts start with as many marks as an order looks back
                run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + back)
            self.grams.append((run & ~np.uint64(3)) | np.uint64(n))
        self.first_token = np.zeros(len(tokens), bool)
        self.first_token[self.first] = True
        self.entries, where = np.unique(np.concatenate(self.grams), return_inverse=True)
        self.where = where.reshape(order, len(tokens))

    def counts(self, role: int) -> np.ndarray:
        mine = np.repeat(self.roles == role, self.lengths)
        return np.bincount(self.where[:, mine].ravel(), minlength=len(self.entries)).astype(np.uint32)


def _entries(order: int, buckets: int):
    """Rows (bucket, block, entries, fit, weights): a block's n-grams by hash bucket."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, order)
                fit, weights = block.counts(FIT), block.counts(WEIGHTS)
                cuts = [*np.searchsorted(block.entries, edges), len(block.entries)]
                out = [(b, row["block"], lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
                columns = [
                    pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([_pack(np.diff(block.entries[lo:hi], prepend=np.uint64(0))) for _, _, lo, hi in out], pa.binary()),
                    *(pa.array([_pack(c[lo:hi]) for _, _, lo, hi in out], pa.binary()) for c in (fit, weights)),
                ]
                yield pa.record_batch(columns, ["bucket", "block", "entries", "fit", "weights"])

    return run


def _sum(bucket: pa.Table) -> pa.Table:
    """The sums over all blocks for each block's entries of the bucket; block -1 has the words."""
    rows = bucket.select(["bucket", "block", "entries", "fit", "weights"]).to_pylist()
    entries = [np.cumsum(_unpack(r["entries"], np.uint64)) for r in rows]
    known, where = np.unique(np.concatenate(entries), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([_unpack(r[c], np.uint32) for r in rows]), len(known)).astype(np.int64) for c in ("fit", "weights")]
    cuts = np.cumsum([0, *map(len, entries)])
    packed = [[_pack(s[where[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:])] for s in sums]
    words = (known & np.uint64(3)) == 0
    distinct = [int(np.count_nonzero(words & (sums[0] > 0))), int(np.count_nonzero(words & (sums[0] + sums[1] > 0)))]
    n = len(rows)
    return pa.table(
        [
            pa.array([-1, *(r["block"] for r in rows)], pa.int64()), pa.array([rows[0]["bucket"]] * (n + 1), pa.int32()),
            *(pa.array([b"", *p], pa.binary()) for p in packed), pa.array([distinct[0], *[0] * n], pa.int64()), pa.array([distinct[1], *[0] * n], pa.int64()),
        ],
        names=["block", "bucket", "fit", "weights", "fit_words", "all_words"],
    )


def _estimates(block: Block, counts: np.ndarray, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count of each token's word, the bucket of its longest context, and estimates by order."""
    by_order = counts[block.where]
    out, context = [np.full(by_order.shape[1], 1 / (totals["words"] + 1))], np.zeros(by_order.shape[1])
    for n, c in enumerate(by_order):
        if n == 0:
            context = np.full(len(c), max(totals["tokens"], 1))
        else:
            context = np.concatenate([[0], by_order[n - 1][:-1]])
            # A text's first context is marks alone, met once in each text.
            context[block.first_token] = totals["texts"]
        out.append(np.divide(c, context, out=np.zeros(len(c)), where=context > 0))
    return by_order[0], np.floor(np.log2(context + 1)).astype(np.int64), np.stack(out)


def _counts_of(right: pa.Table, columns: list[str]) -> np.ndarray:
    rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    return sum(np.concatenate([_unpack(r[c], np.int64) for r in rows]) for c in columns)


def _observed(order: int, totals: dict):
    """What the EM needs of a block: events by context bucket and grid cell of the estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], order)
        _, bucket, q = _estimates(block, _counts_of(right, ["fit"]), totals)
        cell = bucket
        for estimate in q[1:]:
            grid = np.where(estimate > 0, np.clip(np.rint(-np.log2(np.maximum(estimate, 1e-300)) * CELLS) + 1, 1, 1023), 0).astype(np.int64)
            cell = cell * 1024 + grid
        cells, where, times = np.unique(cell, return_inverse=True, return_counts=True)
        sums = [np.bincount(where, estimate, len(cells)) for estimate in q[1:]]
        return pa.table([cells, times, pa.array(np.stack(sums, 1).tolist(), pa.list_(pa.float64()))], names=["cell", "times", "sums"])

    return run


def learn_weights(bucket: np.ndarray, times: np.ndarray, q: np.ndarray) -> dict[int, np.ndarray]:
    """Mixture weights by context bucket; ``q`` has an event's estimates by order."""
    weights = {}
    for b in np.unique(bucket):
        mine = bucket == b
        n, p = times[mine], q[:, mine]
        w, before = np.full(len(p), 1 / len(p)), -math.inf
        for _ in range(STEPS):
            share = w[:, None] * p
            whole = share.sum(0)
            gain = float((n * np.log(whole)).sum() / n.sum())
            w = (n * share / whole).sum(1) / n.sum()
            if gain - before < TOLERANCE:
                break
            before = gain
        w = np.maximum(w, 1e-9)  # the uniform part never vanishes, so no text gets probability 0
        weights[int(b)] = w / w.sum()
    return weights


def _score(order: int, totals: dict, weights: dict[int, np.ndarray], kind: pa.DataType):
    table = np.stack([weights[min(weights, key=lambda known: abs(known - b))] for b in range(64)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row, order)
        count, bucket, q = _estimates(block, _counts_of(right, ["fit", "weights"]), totals)
        p = (table[bucket].T * q).sum(0)
        base = np.log10((count + 1) / (totals["tokens"] + totals["words"] + 1))
        add = lambda x: np.add.reduceat(x, block.first)
        return pa.table(
            [pa.array(row["ids"], kind), pa.array(block.lengths, pa.int64()), pa.array(add((count > 0).astype(np.int64)), pa.int64()), add(base), add(np.log10(p))],
            names=["id", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row for each row of ``docs``: its id and its scores under a model of all training rows.

    ``train`` says of a row whether the model learns from it.  Texts are words outside U+0020
    and U+0009 to U+000D, A-Z lower-cased, and one end, which counts as a token.  Returns the
    id, ``n_tokens``, ``n_known`` (tokens met in training), ``train_tokens``, ``base_score``
    (add-one unigram) and ``score`` (the mixture), both as log10 of the text's probability.
    Null texts are empty: one end.  Rows that repeat an id are scored one by one.  Without
    training rows every token has the uniform probability.  An empty table gives an empty
    table.  Of training rows, about one in eight (by a hash of the id) fits the weights.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)
    name = docs.schema[id_col].dataType.simpleString()
    role = F.when(~F.coalesce(train, F.lit(False)), UNTRAINED).when(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(8)) == 0, WEIGHTS).otherwise(FIT)
    texts = docs.select(F.col(id_col).alias("id"), role.alias("role"), F.col(text_col).alias("text"))
    shape = f"block long, weighs boolean, ids array<{name}>, lengths array<long>, roles array<long>, vocabulary binary, tokens binary"
    blocks = checkpointed(texts.mapInArrow(_blocks(kind, block_tokens), shape))

    texts_of = blocks.select(F.explode(F.arrays_zip("lengths", "roles")).alias("t")).select("t.lengths", "t.roles")
    sums = {r["roles"]: r for r in texts_of.groupBy("roles").agg(F.sum("lengths").alias("tokens"), F.count("*").alias("texts")).collect()}
    total = lambda roles, what: sum(sums[r][what] for r in roles if r in sums)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(order * total((0, 1, 2), "tokens") / bucket_entries))
    entries = blocks.mapInArrow(_entries(order, buckets), "bucket int, block long, entries binary, fit binary, weights binary")
    counted = checkpointed(entries.groupBy("bucket").applyInArrow(_sum, "block long, bucket int, fit binary, weights binary, fit_words long, all_words long"))
    words = counted.where("block = -1").agg(F.sum("fit_words"), F.sum("all_words")).first()
    fit = {"tokens": total((FIT,), "tokens"), "texts": total((FIT,), "texts"), "words": words[0] or 0}
    both = {"tokens": total((FIT, WEIGHTS), "tokens"), "texts": total((FIT, WEIGHTS), "texts"), "words": words[1] or 0}

    counts = counted.where("block >= 0").select("block", "bucket", "fit", "weights")
    seen = blocks.where("weighs").groupBy("block").cogroup(counts.join(blocks.where("weighs").select("block"), "block", "left_semi").groupBy("block"))
    cells = seen.applyInArrow(_observed(order, fit), "cell long, times long, sums array<double>")
    sums_of = [F.sum(F.col("sums")[n]).alias(f"s{n}") for n in range(order)]
    grid = cells.groupBy("cell").agg(F.sum("times").alias("times"), *sums_of).toPandas()  # bounded by the grid
    weights = {0: np.full(order + 1, 1 / (order + 1))}
    if len(grid):
        times = grid["times"].to_numpy(float)
        q = np.stack([np.full(len(grid), 1 / (fit["words"] + 1)), *(grid[f"s{n}"].to_numpy(float) / times for n in range(order))])
        weights = learn_weights(grid["cell"].to_numpy() >> (10 * order), times, q)
    scored = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        _score(order, both, weights, kind), f"id {name}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(both["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
