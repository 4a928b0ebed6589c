"""Vectorised word handling over Arrow text columns.

Words are maximal runs of non-space characters.  For matching, a word is
lower-cased and stripped of punctuation at both ends; a word of punctuation
only is kept as it is.  A null text has no words.  Only the distinct words of a
batch pass through Python code; everything of the size of the text is numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’„…–—"
M64 = np.uint64(0xFF51AFD7ED558CCD)


def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def pieces(batch: pa.RecordBatch, column: str, limit: int = 6 << 20):
    """Slices of a batch with about ``limit`` bytes of text each (one row at least),
    so that a task's memory doesn't depend on the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.string())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(batch):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def split_words(col) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, one after another, and the offsets of each row."""
    col = as_array(col).cast(pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(col, "")))
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "")
    if pc.min(full).as_py() is False:
        keep = np.concatenate([[0], np.cumsum(np.asarray(full.to_numpy(zero_copy_only=False)))])
        words, offsets = words.filter(full), keep[offsets]
    return words, offsets


def normalised(words: pa.Array) -> pa.Array:
    low = pc.utf8_lower(words)
    bare = pc.utf8_trim(low, characters=PUNCTUATION)
    return pc.if_else(pc.equal(bare, ""), low, bare)


def word_codes(col) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the normalised words of a text column, and row offsets."""
    words, offsets = split_words(col)
    if not len(words):
        return np.empty(0, np.uint64), offsets
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in normalised(coded.dictionary).to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * M64
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` codes of a flat array, runs over row ends included;
    the array returned is shorter than ``codes`` by ``n - 1``.  Prefix sums of a
    polynomial modulo 2**64, so that the cost doesn't depend on ``n``."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    if n <= 4:
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * BASE + codes[i : i + m]
        return mix(out)
    mixed = mix(codes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(BASE, len(codes)), dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * _powers(INVERSE, m))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the run of ``n`` words that starts at each word stays in its row."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(total) + n <= ends


INK = np.ones(256, np.uint8)
INK[[9, 10, 12, 13, 32]] = 0


def count_words(col) -> np.ndarray:
    """Runs of bytes other than space, tab, newline, form feed and carriage
    return in each text; 0 for null."""
    col = pc.fill_null(as_array(col).cast(pa.large_string()), "")
    if not len(col):
        return np.empty(0, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if bounds[-1] == bounds[0]:
        return np.zeros(len(col), np.int64)
    ink = INK[np.frombuffer(col.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    begins = bounds - bounds[0]
    word = ink.copy()
    word[1:] &= ink[:-1] ^ 1
    heads = begins[:-1][np.diff(begins) > 0]
    word[heads] = ink[heads]
    out = np.zeros(len(col), np.int64)
    out[np.diff(begins) > 0] = np.add.reduceat(word, heads, dtype=np.int64)
    return out
