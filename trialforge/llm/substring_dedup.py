"""Substring dedup by minimizer buckets, in place of a compacted de Bruijn graph.

A window of ``WINDOW`` words holds a run of word k-mers.  The one with the smallest number is
its node; equal windows have the same node at the same place.  The windows that follow each
other on one node in a text form a path: the run of words they cover together.

1. Nodes are counted over the corpus; windows on a node met once occur once.
2. A node that only one path runs through is nonbranching: the path repeats as a whole, so
   all windows on it do, and it stays one row.
3. A node with several paths branches.  Only there paths are taken apart into windows, which
   are counted by their content.
4. Every path and window carries its text and place, and the words at repeated places go.

Nodes that may repeat or branch are looked up in a bitmap of bounded size before paths are
emitted; what it lets through by chance is dropped by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, likely_in
from .common import checkpointed, packed, unpacked
from .words import Words, spans, text_words, windows

WINDOW = 35
KMER = 16


class Paths:
    """The paths of a chunk of texts: row, first window, number of windows, node."""

    def __init__(self, words: Words, window: int, kmer: int):
        nodes = windows(words.hashes, kmer)
        counts = np.maximum(np.diff(words.at) - window + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.at[:-1], counts)
        if not len(at):
            self.row = self.at = self.n = self.node = self.place = np.empty(0, np.int64)
            return
        place = np.empty(len(at), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(nodes, window - kmer + 1)
        for low in range(0, len(at), 1 << 15):
            part = at[low : low + (1 << 15)]
            place[low : low + len(part)] = part + view[part].argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(row) != 0)]))
        self.row, self.at = row[first], at[first]
        self.n = np.diff(np.append(first, len(at)))
        self.node = nodes[place[first]]


def _signed(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.view(np.int64))


def _nodes(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in text_words(batch.column("text"), lower=False):
                node, times = np.unique(Paths(words, window, kmer).node.astype(np.uint64), return_counts=True)
                yield pa.record_batch([_signed(node), pa.array(times)], ["node", "times"])

    return run


def _paths(window: int, kmer: int, wanted):
    """Rows (id, h, at, n, node, path) for the paths on nodes of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in text_words(batch.column("text"), lower=False):
                p = Paths(words, window, kmer)
                k = np.flatnonzero(wanted.value.has(p.node.astype(np.uint64)))
                row, at, n, node = p.row[k], p.at[k], p.n[k], p.node[k].astype(np.uint64)
                path = spans(words.hashes, at, n + window - 1)
                who = pa.array(first + row)
                yield pa.record_batch(
                    [batch.column("id").take(who), batch.column("h").take(who), pa.array((at - words.at[row]).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(node), _signed(path)],
                    ["id", "h", "at", "n", "node", "path"],
                )

    return run


def _windows(window: int, kmer: int, wanted):
    """Rows (id, h, at, node, window): every window of the paths on nodes of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in text_words(batch.column("text"), lower=False):
                p = Paths(words, window, kmer)
                k = np.flatnonzero(wanted.value.has(p.node.astype(np.uint64)))
                n = p.n[k]
                row, node = np.repeat(p.row[k], n), np.repeat(p.node[k].astype(np.uint64), n)
                at = np.repeat(p.at[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = pa.array(first + row)
                yield pa.record_batch(
                    [batch.column("id").take(who), batch.column("h").take(who), pa.array((at - words.at[row]).astype(np.int32)), _signed(node), _signed(spans(words.hashes, at, window))],
                    ["id", "h", "at", "node", "window"],
                )

    return run


def _cut(window: int, keep_text: bool, other_than=None):
    """Each text without the words of its repeated windows; with a bitmap, only of rows whose ``key`` isn't in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if other_than is not None:
                key = batch.column("key").to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(~other_than.value.has(key)))
            total, removed, kept = [], [], []
            for text, places in zip(batch.column("text").cast(pa.large_binary()), batch.column("places")):
                words = (text.as_py() or b"").split()
                total.append(len(words))
                gone = 0
                if places.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = places.values.field("at").to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + places.values.field("n").to_numpy() + window - 1, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(np.count_nonzero(stays))
                    words = [words[k] for k in np.flatnonzero(stays)]
                removed.append(gone)
                kept.append(b" ".join(words))
            out = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            given = [n for n in batch.schema.names if n not in ("key", "places") and (keep_text or n != "text")]
            yield pa.record_batch([*batch.select(given).columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), out], [*given, "n_words", "n_removed", "kept_text"])

    return run


def repeated_places(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``texts`` (id, h, text) to (id, h, places): first windows and numbers of repeated windows."""
    context = texts.sparkSession.sparkContext
    kind = texts.schema["id"].dataType.simpleString()
    counted = texts.select("text").mapInArrow(_nodes(window, kmer), "node long, times long")
    repeated = checkpointed(counted.groupBy("node").agg(F.sum("times").alias("times")).where("times > 1").select("node"))
    may_repeat = context.broadcast(Bitmap(repeated, "node"))
    paths = texts.mapInArrow(_paths(window, kmer, may_repeat), f"id {kind}, h int, at int, n int, node long, path long")
    paths = checkpointed(paths.join(repeated, "node", "left_semi"))
    nodes = paths.groupBy("node").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    branching = checkpointed(nodes.where("low <> high").select("node"))
    whole = paths.join(branching, "node", "left_anti").select("id", "h", "at", "n")
    may_branch = context.broadcast(Bitmap(branching, "node"))
    apart = texts.mapInArrow(_windows(window, kmer, may_branch), f"id {kind}, h int, at int, node long, window long").join(branching, "node", "left_semi")
    apart = checkpointed(apart.select("id", "h", "at", "window"))
    # Written first, so that the join's side with hot windows is an exchange Spark can split.
    met = checkpointed(apart.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window"))
    single = apart.join(met, "window", "left_semi").select("id", "h", "at", F.lit(1).alias("n"))
    return whole.union(single).groupBy("id", "h").agg(F.collect_list(F.struct("at", "n")).alias("places"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with their text after repeated passages are cut.

    Words are runs outside U+0020 and U+0009 to U+000D.  Every word goes that is covered by a
    window of ``window`` words whose sequence also starts elsewhere, in the same text or
    another; windows are judged on the input.  Adds ``n_words``, ``n_removed`` and
    ``kept_text`` (kept words joined by one space), which take the place of columns so named.
    Null and empty texts have no words; texts shorter than a window lose none; of rows that
    repeat a text all lose what is covered.  An empty table gives an empty table.  Without
    ``keep_text`` the text column is left out.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("h"), F.col(text_col).alias("text"))
    # Only texts that may have a repeated place are shuffled; the others are cut into words where they are.
    places = checkpointed(repeated_places(texts, window, kmer).withColumn("key", F.xxhash64("id", "h")))
    added = ["n_words", "n_removed", "kept_text"]
    key = F.xxhash64(F.col(id_col), F.hash(text_col))
    rows = docs.select(packed(docs, [*added, text_col]).alias("row"), F.col(id_col).alias("row_id"), F.hash(text_col).alias("row_h"), F.col(text_col).alias("text"), key.alias("key"))
    losing = likely_in(rows, "key", places, "key")
    same = losing["row_id"].eqNullSafe(places["id"]) & (losing["row_h"] == places["h"])
    joined = losing.join(places, same, "left").select("row", "text", "places")
    whole = rows.select("row", "text", "key", F.lit(None).cast(places.schema["places"].dataType).alias("places"))
    shape = f"row {joined.schema['row'].dataType.simpleString()}" + ", text string" * keep_text + ", n_words long, n_removed long, kept_text string"
    held = docs.sparkSession.sparkContext.broadcast(Bitmap(places, "key"))
    cut = joined.mapInArrow(_cut(window, keep_text), shape).union(whole.mapInArrow(_cut(window, keep_text, held), shape))
    return cut.select(*unpacked(cut, "row"), *[F.col("text").alias(text_col)] * keep_text, *added)
