"""Vectorised word handling over Arrow batches (runs in the executors' Python workers).

A word is ``[^\\x20\\x09-\\x0D]+``.  Words are dictionary-encoded by Arrow in C++, so Python only
touches each distinct word of a batch once; everything per word position is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift) applied to every element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``max_bytes`` of ``column`` each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of consecutive documents: ``codes`` index ``vocab``; document i has [starts[i], starts[i+1])."""

    codes: np.ndarray
    vocab: pa.StringArray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word position."""
        table = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab.cast(pa.binary()).to_pylist()] or [0], dtype=np.uint64)
        return table[self.codes]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; null counts as empty.  ``lower`` lower-cases A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)))
    encoded = flat.filter(keep).dictionary_encode()
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, kept[offsets])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from every position that has n successors in ``h`` (document ends not heeded)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    g = h[:size] + _GOLD
    for k in range(1, n):
        g = g * _STEP + h[k : k + size]
    return mix(g)


def within(starts: np.ndarray, n: int) -> np.ndarray:
    """Which window starts keep all n words inside one document."""
    size = int(starts[-1]) - n + 1
    if size <= 0:
        return np.empty(0, dtype=bool)
    ok = np.ones(size, dtype=bool)
    for k in range(1, n):
        cut = starts[1:-1] - k
        ok[cut[(cut >= 0) & (cut < size)]] = False
    return ok
