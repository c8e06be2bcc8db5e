"""Numpy helpers that work on a whole batch of texts at once.

A batch is one flat array of units (bytes, or word hashes) and the offsets at
which its documents begin. Nothing here crosses a document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Texts are handled in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: ASCII white space: a space and the bytes 9 to 13.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefixes:
    """Hashes of any range of units from one cumulative sum."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + end.astype(np.uint64) - start.astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every k consecutive units."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[:n])


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator:
    """Parts of a batch whose texts have about `most` bytes; a longer text is a part of its own."""
    _, at = utf8(batch.column(column))
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(flat: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each white-space separated word begins and ends, and the first word of each document (one more at the end)."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACES[flat]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(flat))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(flat: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each document, and where documents begin among them."""
    start, end, first = words(flat, at)
    return Prefixes(ASCII_LOWER[flat] if lower else flat).of(start, end), first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if len(x) >= w else x[:0]


class Anchors:
    """Content-defined anchors: each window of `length` units owns the least of its `gram`-unit hashes (the leftmost of equals).

    Equal windows own equal anchors at equal distances, wherever they stand. Windows that own one anchor are
    consecutive. Arrays: doc, first window and number of windows (relative to the document), key (hash of the
    anchor's gram), where that gram begins, and span (hash of all units that the windows cover).
    """

    def __init__(self, units: np.ndarray, at: np.ndarray, length: int, gram: int):
        prefixes, w = Prefixes(units), length - gram + 1
        grams = prefixes.grams(gram)
        marked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(marked, w)
        sizes = np.diff(at)
        ok = np.zeros(len(units) + 1, np.int32)
        has = sizes >= length
        np.add.at(ok, at[:-1][has], 1)
        np.add.at(ok, (at[1:] - length + 1)[has], -1)
        windows = np.flatnonzero(np.cumsum(ok[:-1]))
        anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        heads = np.flatnonzero(new)
        begin = windows[heads]
        self.gram_at = anchor[heads]
        self.windows = np.diff(np.append(heads, len(windows)))
        self.flat_start = begin
        self.flat_end = begin + self.windows + length - 1
        self.doc = np.searchsorted(at, begin, "right") - 1
        self.first = begin - at[self.doc]
        self.key = grams[anchor[heads]]
        self.span = prefixes.of(begin, self.flat_end)
