"""Hamming links inside a bucket of fingerprints, by a hierarchical index in Gray order.

Sorted by Gray rank, neighbours share most bits.  Each run of fingerprints is a node that keeps the bits all
of them share, runs of nodes form the nodes above.  Two nodes whose shared bits differ in more places than
the limit have no link between them, whatever their other bits are: the pair is dropped with all below it.
A child shares every bit its parent shares, so differences only accumulate on the way down.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF, FAN = 32, 8
PAIRS = 1 << 14


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each of n members' component, with links a-b, on top of earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= limit


def small_buckets(code: np.ndarray, bucket: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside buckets of at most LEAF codes; `bucket` numbers them in order."""
    found = [], []
    at = np.arange(len(code))
    for shift in range(1, LEAF):
        at = at[:-1] if len(at) and at[-1] + shift >= len(code) else at
        at = at[at + shift < len(code)]
        at = at[bucket[at] == bucket[at + shift]]
        if not len(at):
            break
        near = at[_near(code[at], code[at + shift], limit)]
        found[0].append(near)
        found[1].append(near + shift)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found[0]]), np.concatenate([empty, *found[1]])


def large_bucket(code: np.ndarray, limit: int) -> np.ndarray:
    """The component labels inside one bucket of codes in Gray order."""
    n = len(code)
    label = np.arange(n)
    starts = np.arange(0, n, LEAF)
    all_, any_ = np.bitwise_and.reduceat(code, starts), np.bitwise_or.reduceat(code, starts)
    levels = [(all_, ~(all_ ^ any_))]  # of each node: the pattern, and the mask of the bits that are shared
    while len(all_) > 1:
        starts = np.arange(0, len(all_), FAN)
        all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
        levels.append((all_, ~(all_ ^ any_)))
    padded = np.resize(code, len(levels[0][0]) * LEAF)
    work = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        depth, i, j = work.pop()
        if len(i) > PAIRS:
            work += [(depth, i[k:k + PAIRS], j[k:k + PAIRS]) for k in range(0, len(i), PAIRS)]
            continue
        pattern, mask = levels[depth]
        alive = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= limit
        i, j = i[alive], j[alive]
        if depth:
            step = np.arange(FAN)
            low = np.repeat(i * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(i))
            high = np.repeat(j * FAN, FAN * FAN) + np.tile(np.tile(step, FAN), len(j))
            held = (low <= high) & (high < len(levels[depth - 1][0]))
            work.append((depth - 1, low[held], high[held]))
            continue
        step = np.arange(LEAF)
        for k in range(0, len(i), 1024):
            left, right = i[k:k + 1024, None] * LEAF + step, j[k:k + 1024, None] * LEAF + step
            pair, x, y = np.nonzero(_near(padded[left][:, :, None], padded[right][:, None, :], limit))
            a, b = left[pair, x], right[pair, y]
            inside = (a < b) & (b < n)
            label = roots(n, a[inside], b[inside], label)
    return label


def _ends(keys: list[np.ndarray]) -> np.ndarray:
    """Where the next of each run of equal keys begins, without the first."""
    changed = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    return np.flatnonzero(changed) + 1


def _linked(code: np.ndarray, starts: np.ndarray, limit: int) -> pa.RecordBatch:
    """Links of whole buckets that begin at `starts`: each code with the first of its component there."""
    sizes = np.diff(np.append(starts, len(code)))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= LEAF
    chosen = np.flatnonzero(small[bucket] & (sizes[bucket] > 1))
    a, b = small_buckets(code[chosen], bucket[chosen], limit)
    label = roots(len(code), chosen[a], chosen[b])
    for k in np.flatnonzero(~small):
        begin, end = starts[k], starts[k] + sizes[k]
        label[begin:end] = begin + large_bucket(code[begin:end], limit)
    moved = np.flatnonzero(label != np.arange(len(code)))
    return pa.RecordBatch.from_arrays(
        [pa.array(code[moved].view(np.int64)), pa.array(code[label[moved]].view(np.int64))], names=["a", "b"])


def links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of codes (choice, key, code) sorted by choice, key and Gray rank."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(n).to_numpy() for n in ("choice", "key", "code")]
        ends = _ends(new[:2])
        same = not held or all(new[k][0] == held[-1][k][-1] for k in (0, 1))
        if same and not len(ends):
            held.append(new)
            continue
        # All that is held, and what comes before the last bucket of this batch, is whole.
        cut = ends[-1] if len(ends) else 0
        parts = [*held, [c[:cut] for c in new]]
        whole = [np.concatenate([p[k] for p in parts]) for k in range(3)]
        if len(whole[0]):
            yield _linked(whole[2].view(np.uint64), np.append(0, _ends(whole[:2])), limit)
        held = [[c[cut:] for c in new]]
    if held:
        whole = [np.concatenate([p[k] for p in held]) for k in range(3)]
        yield _linked(whole[2].view(np.uint64), np.append(0, _ends(whole[:2])), limit)
