"""Hashed features of texts: the words that occur, and bands of a few ratios of the whole text."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from jurisindex.llm.words import MARK, Words, mixed, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: Upper ends of the bands that ratios fall in; a text has the feature of each band that it is above.
BANDS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7])
LENGTHS = np.array([2, 4, 8, 16, 32, 64, 128, 256, 1024, 4096, 16384])


def _share(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of `values` (one for each word) over each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers): the distinct features of each text, in a row for each text."""
    words = Words(texts)
    n, first, text = len(texts), words.first, words.text
    hashes = words.hashes(lower=True, bare=True)
    raw = words.hashes()
    marks = np.concatenate([[0], np.cumsum(MARK[words.data])])
    uppers = np.concatenate([[0], np.cumsum(UPPER[words.data])])
    size = words.end - words.start
    marked = (marks[words.end] - marks[words.start]) >= 2
    shouted = (uppers[words.end] - uppers[words.start]) * 2 > size
    bare_mark = (marks[words.end] - marks[words.start]) == size
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    grams = windows(raw, 3) if len(words) >= 3 else np.zeros(0, np.uint64)
    inside = text[2:] == text[:-2] if len(words) >= 3 else np.zeros(0, bool)
    keyed = mixed(grams + text[:len(grams)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, index, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    seen = np.zeros(len(words), bool)
    seen[:len(grams)] = (counts[index] > 1) & inside
    length = np.digitize(np.diff(first), LENGTHS)
    ratios = [_share(v, first) for v in (marked, shouted, bare_mark, again, seen)] + [_share(size, first) / 20]
    rows, numbers = [text], [hashes >> np.uint64(64 - bits)]
    for k, ratio in enumerate(ratios):
        above = ratio[:, None] > BANDS
        r, band = np.nonzero(above)
        rows.append(r)
        numbers.append(mixed((1000 * (k + 1) + band).astype(np.uint64)) >> np.uint64(64 - bits))
    for level in range(1, len(LENGTHS) + 1):
        r = np.flatnonzero(length >= level)
        rows.append(r)
        numbers.append(np.full(len(r), mixed(np.array([100 + level], np.uint64))[0] >> np.uint64(64 - bits)))
    both = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | np.concatenate(numbers))
    offsets = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
    return offsets, (both & np.uint64((1 << bits) - 1)).astype(np.int64)
