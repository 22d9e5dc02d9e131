"""Line dedup by a deletion-neighbourhood join.

Lines are compared on their words; an edit inserts, deletes or replaces one word.  Two lines
are within one edit exactly when they are equal after one word is left out of either, at the
same place, or of the longer one only.  So every line emits hashed keys: itself, and each
variant without one word, once with the word's place and once without.  Lines that share a
key are within the bound, so the earliest of each key is found by an aggregate and no pair is
listed; the line each is to be dropped for is then verified word by word.

All texts are cut into words once.  That gives a table of lines (two hashes, place, keys of
halves), and everything else starts from its distinct lines: those that share a half with
another line are fetched as text, and emit variants where they also share all but an eighth,
which any two lines within one edit do, and only for the words of that eighth.  Shared eighths
are looked up in sets of bounded size; what these let through by chance costs variants only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import Sieve, maybe_in
from .common import SPACES, checkpointed, packed, unpacked, written
from .words import _ODD_INVERSE, ODD, Words, mixed, powers, spans_without, text_words

HALVES, PIECES = 2, 8  # cuts of a line in the first and the second look for likely neighbours
LEAST_WORDS = 4  # lines with fewer words, of which an edit changes a third or more, are only compared for equality
_SECOND, _HEAD, _PLACE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3))


class Lines:
    """The lines with words of a chunk of texts: row, place in the text, words, two hashes."""

    def __init__(self, words: Words):
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        row = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
        line = breaks[words.start] - breaks[words.bounds[:-1]][row]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(row) != 0)])) if len(row) else np.empty(0, np.int64)
        self.row, self.at, self.first = row[first], line[first], first
        self.n = np.diff(np.append(first, len(row)))
        self.sums = np.zeros(len(row) + 1, np.uint64)
        np.cumsum(words.hashes * powers(ODD, len(row)), out=self.sums[1:])
        self.shift = powers(_ODD_INVERSE, len(row) + 1)
        self.a = self.run(first, self.n)
        # Not a polynomial, so no line that fools the first hash fools the second too.
        place = np.arange(len(row)) - np.repeat(first, self.n)
        sums = np.zeros(len(row) + 1, np.uint64)
        np.cumsum(mixed(words.hashes ^ mixed(place.astype(np.uint64) + _SECOND)), out=sums[1:])
        self.b = mixed(sums[first + self.n] - sums[first] + self.n.astype(np.uint64))

    def run(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What ``spans`` gives for runs of words, from sums made once."""
        return mixed((self.sums[start + length] - self.sums[start]) * self.shift[start] + length.astype(np.uint64))

    def pieces(self, parts: int) -> np.ndarray:
        """For each line, twice ``parts`` keys; two lines within one edit share at least one.

        A line is cut into ``parts`` pieces, and a key stands for all of it but one piece.  The
        edit of two equally long lines is in one piece, so they share the key without it.  A
        line with one word more than another shares a key when it is cut where the shorter one
        is, counted from either end; so it is cut for its own length and for one word less.
        """
        keys = []
        for m in (self.n, self.n - 1):
            for k in range(parts):
                head, tail = k * m // parts, m - (k + 1) * m // parts
                one = self.run(self.first, head)
                two = self.run(self.first + self.n - tail, tail)
                keys.append(mixed((one ^ _HEAD) + mixed(two + (m * parts + k).astype(np.uint64))))
        return np.stack(keys, axis=1)


def _long(numbers: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(numbers).view(np.int64))


def _who(batch: pa.RecordBatch, first: int, row: np.ndarray) -> list[pa.Array]:
    rows = pa.array(first + row)
    return [batch.column("id").take(rows), batch.column("h").take(rows)]


def _lines(least: int):
    """Rows (id, h, at, a, b, halves), one for each line with words; short lines have no halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in text_words(batch.column("text"), lower=True):
                lines = Lines(words)
                long = lines.n >= least
                ends = np.concatenate([[0], np.cumsum(long * 2 * HALVES)]).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(ends), _long(lines.pieces(HALVES)[long].ravel()))
                yield pa.record_batch([*_who(batch, first, lines.row), pa.array(lines.at.astype(np.int32)), _long(lines.a), _long(lines.b), halves], ["id", "h", "at", "a", "b", "halves"])

    return run


def _eighths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, longer, b): the keys of lines; ``longer`` where cut for one word less."""
    for batch in batches:
        for _, _, words in text_words(batch.column("line"), lower=True):
            lines = Lines(words)
            longer = np.tile(np.repeat([False, True], PIECES), len(lines.n))
            yield pa.record_batch([_long(lines.pieces(PIECES).ravel()), pa.array(longer), _long(np.repeat(lines.b, 2 * PIECES))], ["piece", "longer", "b"])


def _variants(equal, across):
    """Rows (first, key, role): role 0 the line itself, 1 a word left out, 2 the same at its place.

    Words are left out where the edit can be: in pieces without which a line of the same length
    (role 2) or of one word less (role 1) may be the same; role 0 is for lines that may have a
    neighbour with one word more.
    """

    def chosen(lines: Lines, words: int, m: np.ndarray, mine: np.ndarray, more: int) -> np.ndarray:
        edge = np.zeros(words + 1, np.int64)
        for k in range(PIECES):
            at = mine[:, k]
            np.add.at(edge, (lines.first + k * m // PIECES)[at], 1)
            np.add.at(edge, (lines.first + (k + 1) * m // PIECES + more)[at], -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in text_words(batch.column("line"), lower=True):
                lines = Lines(words)
                keys = lines.pieces(PIECES)
                same = equal.value.has(keys[:, :PIECES].ravel()).reshape(-1, PIECES)
                other = across.value.has(keys.ravel()).reshape(-1, 2 * PIECES)
                own = np.flatnonzero(other[:, :PIECES].any(axis=1))
                cut = chosen(lines, len(words), lines.n - 1, other[:, PIECES:], 1)
                placed = chosen(lines, len(words), lines.n, same, 0)
                cut_row, placed_row = (np.searchsorted(lines.first, w, "right") - 1 for w in (cut, placed))
                start, n = lines.first[placed_row], lines.n[placed_row]
                at = placed - start
                before, after = lines.run(start, at), lines.run(placed + 1, n - at - 1)
                hashes = [
                    lines.a[own],
                    spans_without(words.hashes, lines.first[cut_row], lines.n[cut_row], cut - lines.first[cut_row]),
                    mixed((before ^ _PLACE) + mixed(after + at.astype(np.uint64))),
                ]
                rows = np.concatenate([own, cut_row, placed_row])
                role = np.repeat(np.array([0, 1, 2], np.int32), [len(own), len(cut), len(placed)])
                yield pa.record_batch([batch.column("first").take(pa.array(first + lines.row[rows])), _long(np.concatenate(hashes)), pa.array(role)], ["first", "key", "role"])

    return run


def line_words(line: Column) -> Column:
    """The words of a line, A-Z lower-cased."""
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return F.array_remove(F.split(F.translate(line, upper + SPACES, upper.lower() + " " * len(SPACES)), " "), "")


def within_one(a: Column, b: Column) -> Column:
    """Whether word arrays differ by at most one edit: what is left of the longer one between
    the common start and the common end is one word at most."""
    n, m = F.size(a), F.size(b)
    shorter = F.least(n, m)
    start = F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= shorter) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(s))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= shorter) & (F.get(a, n - i) == F.get(b, m - i)), i).otherwise(s))
    return F.greatest(n, m) - F.least(start + end, shorter) <= 1


def _shared(keys: DataFrame) -> DataFrame:
    """``keys`` (piece, longer, b) to (piece, equal, across): pieces that two lines of one length
    share, and pieces that a line shares with one of a word more."""
    short = F.when(~F.col("longer"), F.col("b"))
    found = keys.groupBy("piece").agg(F.min(short).alias("low"), F.max(short).alias("high"), F.max("longer").alias("longer"))
    met = found.select("piece", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("equal"), (F.col("low").isNotNull() & F.col("longer")).alias("across"))
    return checkpointed(met.where("equal or across"))


def likely_lines(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows (a, b, first, line, words) of the distinct lines that share a half with another line."""
    held = texts.sparkSession.sparkContext.broadcast

    def halves(frame: DataFrame) -> DataFrame:
        return frame.select("a", "b", "first", F.posexplode("halves").alias("k", "piece")).withColumn("longer", F.col("k") >= HALVES)

    shared = _shared(halves(distinct))
    near = halves(distinct.where(maybe_in(F.col("halves"), held(Sieve(shared, "piece")))))
    near = near.join(shared, "piece").where("across or (equal and not longer)").groupBy("a", "b").agg(F.first("first").alias("first"))
    near = checkpointed(near.select("a", "b", "first", F.xxhash64("first.id", "first.h").alias("text_key"), F.xxhash64("first.id", "first.h", "first.at").alias("line_key")))

    holders = texts.where(maybe_in(F.xxhash64("id", "h"), held(Sieve(near, "text_key"))))
    lines = holders.select("id", "h", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(maybe_in(F.xxhash64("id", "h", "at"), held(Sieve(near, "line_key"))))
    lines = lines.select(place().alias("first"), F.xxhash64("id", "h", "at").alias("line_key"), "line")
    found = near.join(lines.withColumnRenamed("first", "at"), "line_key").where(F.col("first").eqNullSafe(F.col("at")))
    found = found.groupBy("a", "b").agg(F.first("first").alias("first"), F.first("line").alias("line"))
    # Words are written: as an expression, each step of the folds that compare lines would cut them again.
    return written(found.withColumn("words", line_words(F.col("line"))))


def earlier_lines(likely: DataFrame) -> DataFrame:
    """``likely`` (a, b, first, line, words) to (a, b) of lines that have an earlier neighbour."""
    held = likely.sparkSession.sparkContext.broadcast
    shared = _shared(likely.select("line").mapInArrow(_eighths, "piece long, longer boolean, b long"))
    variants = _variants(*(held(Sieve(shared.where(kind), "piece")) for kind in ("equal", "across")))
    shape = likely.schema["first"].dataType.simpleString()
    emitted = likely.select("first", "line").mapInArrow(variants, f"first {shape}, key long, role int")

    def by_role(pick, role: int) -> Column:
        return pick(F.when(F.col("role") == role, F.col("first")))

    met = emitted.groupBy("key").agg(by_role(F.min, 0).alias("own"), by_role(F.min, 1).alias("cut"), by_role(F.min, 2).alias("placed"), by_role(F.max, 2).alias("last"))
    met = met.where("(own is not null and cut is not null) or placed <> last").drop("last")
    met = checkpointed(met)  # so that the join's side with hot keys is an exchange Spark can split
    # A whole line meets lines with one word more; those meet it, not each other; places meet places.
    by = F.when(F.col("role") == 0, F.col("cut")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("placed"))
    found = emitted.where(maybe_in(F.col("key"), held(Sieve(met, "key")))).join(met, "key").select("first", by.alias("by")).where("by < first")
    earliest = found.groupBy("first").agg(F.min("by").alias("by"))
    other = likely.select(F.col("first").alias("by"), F.col("words").alias("by_words"))
    pairs = likely.join(earliest, "first").join(other, "by")
    return pairs.where(within_one(F.col("words"), F.col("by_words"))).select("a", "b")


def place() -> Column:
    """Order of lines: id (null last), hash of the text, place in it."""
    return F.struct(F.col("id").isNull().alias("unnamed"), "id", "h", "at")


def dropped_lines(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``texts`` (id, h, text) to (id, h, gone), the places of the lines that go."""
    kind = texts.schema["id"].dataType.simpleString()
    lines = written(texts.mapInArrow(_lines(least_words), f"id {kind}, h int, at int, a long, b long, halves array<long>"))
    distinct = written(lines.groupBy("a", "b").agg(F.min(place()).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves")))
    firsts = distinct.where("times > 1").select("a", "b", "first", F.lit(False).alias("near"))
    near = earlier_lines(likely_lines(texts, distinct)).select("a", "b", F.lit(None).cast(firsts.schema["first"].dataType).alias("first"), F.lit(True).alias("near"))
    known = checkpointed(firsts.union(near).groupBy("a", "b").agg(F.max("first").alias("first"), F.max("near").alias("near")))
    held = texts.sparkSession.sparkContext.broadcast(Sieve(known, "b"))
    met = lines.drop("halves").where(maybe_in(F.col("b"), held)).join(known, ["a", "b"])
    gone = met.where(F.col("near") | (F.col("first").isNotNull() & (place() != F.col("first"))))
    return gone.groupBy("id", "h").agg(F.collect_set("at").alias("gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows of ``docs`` with what is left of their text.

    Lines end at ``\\n`` and are compared on their words, A-Z lower-cased; a line without words
    stays.  Of equal lines the earliest stays, by id (null last), hash of the text and place in
    it; a line of ``least_words`` or more also goes when an earlier line of as many words is
    within one edit.  Adds ``n_lines``, ``n_dropped`` and ``kept_text`` (null for a null text), which take the
    place of columns so named.  Rows that repeat id and text share their lines: the first
    place counts for all of them.  An empty table gives an empty table.
    """
    added = ["n_lines", "n_dropped", "kept_text"]
    texts = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("h"), F.col(text_col).alias("text"))
    gone = dropped_lines(texts, least_words)
    rows = docs.select(packed(docs, [*added, text_col]).alias("row"), F.col(id_col).alias("row_id"), F.hash(text_col).alias("row_h"), F.col(text_col).alias("text"))
    # Only texts that may lose lines are shuffled; the others stay where they are.
    gone = checkpointed(gone.withColumn("key", F.xxhash64("id", "h")))
    keyed = rows.withColumn("key", F.xxhash64("row_id", "row_h"))
    held = docs.sparkSession.sparkContext.broadcast(Sieve(gone, "key"))
    losing = keyed.where(maybe_in(F.col("key"), held))
    same = losing["row_id"].eqNullSafe(gone["id"]) & (losing["row_h"] == gone["h"])
    whole = keyed.where(~maybe_in(F.col("key"), held)).select("row", "text", F.lit(None).cast("array<int>").alias("gone"))
    joined = losing.join(gone, same, "left").select("row", "text", "gone").union(whole)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, at: ~F.coalesce(F.array_contains("gone", at), F.lit(False)))
    counts = F.coalesce(F.size(lines), F.lit(0))
    return joined.select(
        *unpacked(joined, "row"), F.col("text").alias(text_col), F.when(F.col("text").isNull(), 0).otherwise(counts).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
