"""Words of a whole batch of texts at once, as arrays of hashes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RANDOM = np.random.default_rng(20240607)
#: A value for each byte; words are polynomials of these.
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII marks, which bare words go without.
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Bytes of text that a task holds as arrays at a time, but for a single longer text.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts are small enough to be held as arrays."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a or not batch.num_rows:
                yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbours, from theirs."""
    return mixed(a * BASE + b)


class Words:
    """The words of a batch: bytes other than white space (0x20, 0x09-0x0D).

    data: all texts, one after the other, with a space between; start, end: where each word lies in it;
    text: the number of its text; first: the number of each text's first word (one more entry than texts).
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        raw = texts.cast(pa.large_binary()).to_pylist()
        self.data = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)
        space = WHITE[self.data]
        inner = ~space
        change = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8)))
        self.start, self.end = change[::2], change[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False, bare: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; `lower`: of A-Z as a-z, `bare`: without ASCII marks around it."""
        if not len(self):
            return np.zeros(0, np.uint64)
        data = LOWER[self.data] if lower else self.data
        value = BYTE[data]
        start, end = self.start, self.end
        if bare:
            plain = ~MARK[self.data] & ~WHITE[self.data]
            count = np.concatenate([[0], np.cumsum(plain)])
            places = np.flatnonzero(plain)
            some = count[end] > count[start]
            start = np.where(some, places[np.minimum(count[start], len(places) - 1)] if len(places) else start, start)
            end = np.where(some, places[count[end] - 1] + 1 if len(places) else end, end)
        # Powers of an odd number have inverses, so one running sum serves words at any place.
        block, out = 1 << 20, np.empty(len(start), np.uint64)
        powers = np.empty(block + 1, np.uint64)
        powers[0] = 1
        powers[1:] = BASE
        powers = np.multiply.accumulate(powers)
        inverse = np.empty(block + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = BACK
        inverse = np.multiply.accumulate(inverse)
        w = 0
        while w < len(start):
            at = start[w]
            stop = max(w + 1, int(np.searchsorted(end, at + block, "right")))
            if end[stop - 1] - at > block:  # one very long word
                piece = value[at:end[stop - 1]]
                total = np.zeros(1, np.uint64)
                for k in range(0, len(piece), block):
                    part = piece[k:k + block]
                    total = mixed(total + (part * powers[:len(part)]).sum(dtype=np.uint64, keepdims=True))
                out[w] = total[0]
            else:
                sums = np.concatenate([[np.uint64(0)], np.cumsum(value[at:end[stop - 1]] * powers[:end[stop - 1] - at], dtype=np.uint64)])
                s, e = start[w:stop] - at, end[w:stop] - at
                out[w:stop] = (sums[e] - sums[s]) * inverse[s]
            w = stop
        return mixed(out + (end - start).astype(np.uint64) * BASE)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` words from each place on, by doubling; those that fit in the array."""
    size, level, out, covered = 1, hashes, None, 0
    while True:
        if length & size:
            if out is None:
                out, covered = level, size
            else:
                n = max(0, len(hashes) - covered - size + 1)
                out, covered = joined(out[:n], level[covered:covered + n]), covered + size
        if covered == length:
            return out
        n = max(0, len(level) - size)
        level, size = joined(level[:n], level[size:size + n]), size * 2
