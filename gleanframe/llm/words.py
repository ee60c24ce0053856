"""Words, word hashes and shingles of a whole Arrow batch of texts at once, with numpy.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 these six bytes
never occur inside another character.  Hashes have 64 bits.  Work arrays cover a block of
about ``BLOCK`` bytes, so a very long text costs memory for its words, not for its bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that sums and products become well spread keys."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """Byte bounds of every word of a batch and the words of each row.

    Row ``r`` has the words ``first[r]`` up to ``first[r + 1]``.
    """

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def trimmed(w: Words, cut: np.ndarray) -> Words:
    """Words less the ASCII characters of ``cut`` (a flag per byte) at their ends; one of these alone stays whole."""
    edge = np.flatnonzero(cut[w.data[w.starts]] | cut[w.data[w.ends - 1]]) if len(w.starts) else ()
    inner = np.flatnonzero(~cut[w.data]) if len(edge) else edge
    if not len(inner):
        return w
    starts, ends = w.starts.copy(), w.ends.copy()
    first = inner[np.minimum(np.searchsorted(inner, starts[edge]), len(inner) - 1)]
    last = inner[np.maximum(np.searchsorted(inner, ends[edge]) - 1, 0)]
    some = (first >= starts[edge]) & (first < ends[edge])
    starts[edge[some]], ends[edge[some]] = first[some], last[some] + 1
    return w._replace(starts=starts, ends=ends)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    begins[heads] = inside[heads]
    finishes[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(w: Words, base: np.uint64 = _BASE) -> np.ndarray:
    """One hash per word, equal for equal words wherever they stand."""
    sizes = w.ends - w.starts
    upto = np.cumsum(sizes)
    out = np.empty(len(sizes), dtype=np.uint64)
    i = 0
    while i < len(sizes):
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + BLOCK, side="right")))
        size, first = sizes[i:j], upto[i:j] - sizes[i:j] - before
        place = np.arange(upto[j - 1] - before) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max()), base, dtype=np.uint64))
        value = w.data[np.repeat(w.starts[i:j], size) + place].astype(np.uint64) + np.uint64(1)
        out[i:j] = np.add.reduceat(value * powers[place], first)
        i = j
    return mix(out + sizes.astype(np.uint64))


class Shingles(NamedTuple):
    """Hashes of word n-grams in text order; row ``r`` has ``first[r]`` up to ``first[r + 1]``."""

    hashes: np.ndarray
    first: np.ndarray


def shingles(hashes: np.ndarray, first: np.ndarray, n: int, whole: bool = False) -> Shingles:
    """Word n-grams per row.  With ``whole`` a shorter row of at least one word is one shingle."""
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, 0)
    if whole:
        grams = np.where((counts > 0) & (counts < n), 1, grams)
    begin = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], grams) + np.repeat(first[:-1], grams)
    last = np.repeat(first[1:], grams)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        here = at + k
        part = hashes[np.minimum(here, len(hashes) - 1)] if len(hashes) else value
        value = value * _STEP + np.where(here < last, part, np.uint64(k + 1))
    return Shingles(mix(value), begin)


def spans(w: Words, row: int) -> str:
    """The text of a row, for what numpy can't do."""
    return w.data[w.offsets[row] : w.offsets[row + 1]].tobytes().decode("utf-8")


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return x.view(np.int64)


def lists(values: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), values)
