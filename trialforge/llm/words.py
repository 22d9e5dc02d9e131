"""Words of many texts at once, as 64-bit hashes, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # bytes of text worked on at a time; a longer text is a chunk of its own
ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# For looser matching, everything in ASCII but letters and digits separates words.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


class Words:
    """The words of the rows ``first`` to ``last`` of a text column.

    ``hashes`` has a 64-bit number for each word, ``at`` the first word of each row and the
    end; ``start`` and ``stop`` are byte positions in ``data``.  With ``marks``, ASCII marks
    separate words like spaces do.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, lower: bool, marks: bool = False):
        low = int(offsets[first])
        self.data = data[low : int(offsets[last])]
        bounds = offsets[first : last + 1] - low
        text = _LOWER[self.data] if lower else self.data
        word = ~(_IS_MARK if marks else _IS_SPACE)[text]
        breaks = np.zeros(len(text) + 1, bool)
        breaks[bounds] = True
        before = np.empty(len(text), bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(len(text), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | breaks[:-1]))
        self.stop = np.flatnonzero(word & (~after | breaks[1:])) + 1
        self.at = np.searchsorted(self.start, bounds)
        lengths = self.stop - self.start
        firsts = np.cumsum(lengths) - lengths
        letters = text[word]
        place = np.arange(len(letters)) - np.repeat(firsts, lengths)
        terms = _BYTE[letters] * powers(ODD, int(lengths.max(initial=0)))[place]
        self._firsts, self._lengths = firsts, lengths
        self._sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=self._sums[1:])
        self.hashes = self._upto(lengths)
        self.bounds = bounds

    def _upto(self, lengths: np.ndarray) -> np.ndarray:
        return mixed(self._sums[self._firsts + lengths] - self._sums[self._firsts] + lengths.astype(np.uint64))

    def prefixes(self, k: int) -> np.ndarray:
        """A number for the first ``k`` bytes of each word, 0 for words that aren't longer."""
        long = self._lengths > k
        out = self._upto(np.minimum(self._lengths, k))
        return np.where(long, out ^ np.uint64(k), np.uint64(0))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """For each row, the bytes of ``data`` where ``mask`` holds."""
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[self.bounds])

    def __len__(self) -> int:
        return len(self.hashes)


def text_words(column: pa.Array, lower: bool, most: int = CHUNK_BYTES, marks: bool = False) -> Iterator[tuple[int, int, Words]]:
    """The column's words in chunks of whole rows: first row, last row (excluded), words."""
    data, offsets = text_bytes(column)
    for first, last in chunks(offsets, most):
        yield first, last, Words(data, offsets, first, last, lower, marks)


def spans(hashes: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A 64-bit number for each run of ``length`` words from ``start``, by words and order."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(ODD, len(hashes)), out=sums[1:])
    shift = powers(_ODD_INVERSE, len(hashes) + 1)[start]
    return mixed((sums[start + length] - sums[start]) * shift + np.asarray(length).astype(np.uint64))


def spans_without(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``spans`` would give for the run without its word ``at``."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(ODD, len(hashes)), out=sums[1:])
    shift = powers(_ODD_INVERSE, len(hashes) + 2)
    before = (sums[start + at] - sums[start]) * shift[start]
    after = (sums[start + length] - sums[start + at + 1]) * shift[start + 1]
    return mixed(before + after + (length - 1).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` words, as of ``spans``."""
    return spans(hashes, np.arange(max(0, len(hashes) - k + 1)), k)
