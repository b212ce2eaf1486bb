"""The work inside tasks of the search for repeated windows: one Arrow batch of texts at a time."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from jurisindex.llm.words import Words, joined, mixed, sliced, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAR = np.int64(1 << 40)


class Anchored:
    """The windows of a batch, each with its anchor: the place of its least gram, of equal ones the last."""

    def __init__(self, texts: pa.Array, length: int, gram: int) -> None:
        self.words = words = Words(texts)
        self.hashes = words.hashes()
        self.grams = windows(self.hashes, gram) if len(words) >= gram else np.zeros(0, np.uint64)
        sizes = np.diff(words.first)
        starts, counts = words.first[:-1][sizes >= length], sizes[sizes >= length] - length + 1
        skipped = np.cumsum(np.concatenate([[0], counts]))
        #: Where each window starts, and the number of its text.
        self.at = np.repeat(starts - skipped[:-1], counts) + np.arange(skipped[-1])
        self.text = words.text[self.at] if len(self.at) else self.at
        self.anchor = self._least(length - gram + 1)[self.at] if len(self.at) else self.at

    def _least(self, span: int) -> np.ndarray:
        """For each place, that of the last least gram among `span` from there on."""

        def last(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(self.grams[b] <= self.grams[a], b, a)

        best, size = np.arange(len(self.grams)), 1
        while size < span:
            step = min(size, span - size)
            best = last(best[:len(best) - step], best[step:])
            size += step
        return best

    def own(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places inside their texts."""
        return (at - self.words.first[text]).astype(np.int32)


def _lists(values: list[pa.Array], text: np.ndarray, texts: int) -> list[pa.Array]:
    """List columns, a row for each text, of values sorted by text."""
    offsets = pa.array(np.searchsorted(text, np.arange(texts + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each; null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(hash, id, th, at) of each anchor of the texts (id, th, text)."""
    for batch in sliced(batches):
        found = Anchored(batch.column("text"), length, gram)
        places, index = np.unique(found.anchor, return_index=True)
        text = found.text[index]
        yield pa.RecordBatch.from_arrays(
            [_longs(found.grams[places]), batch.column("id").take(pa.array(text)), batch.column("th").take(pa.array(text)),
             pa.array(found.own(places, text))], names=["hash", "id", "th", "at"])


def blocks(batches: Iterator[pa.RecordBatch], length: int, gram: int, half: int) -> Iterator[pa.RecordBatch]:
    """Each text (id, th, doc_id, text, places) with its blocks: the windows of each anchor in `places`.

    `anchor`, `low` and `high` are the block's anchor and first and last window, `right` and `left` the hashes of
    the half windows that hold the anchor and `hull` that of all its words.  Texts without blocks are dropped
    for the digest of their words.
    """
    for batch in sliced(batches):
        texts = batch.column("text")
        found = Anchored(texts, length, gram)
        first = found.words.first
        change = np.flatnonzero(np.diff(found.anchor, prepend=-1))
        low, anchor, text = found.at[change], found.anchor[change], found.text[change]
        high = np.append(found.at[change[1:] - 1], found.at[-1:])
        places, row = _flat(batch.column("places"))
        alive = np.isin(anchor, places + first[row])
        low, anchor, text, high = low[alive], anchor[alive], text[alive], high[alive]
        halves, whole = windows(found.hashes, half), windows(found.hashes, length)
        begin, end = first[text], first[text + 1]
        # A half window that leaves the text belongs to no window: it gets a hash of its own.
        alone = mixed(np.arange(len(anchor), dtype=np.uint64) + found.grams[anchor])
        to_right = np.where(anchor + half <= end, halves[np.minimum(anchor, len(halves) - 1)], alone) if len(anchor) else alone
        from_left = anchor + gram - half
        to_left = np.where(from_left >= begin, halves[np.maximum(from_left, 0)], ~alone) if len(anchor) else alone
        hull = joined(joined(whole[low], whole[high]), (high - low).astype(np.uint64)) if len(low) else alone
        own = [found.own(x, text) for x in (anchor, low, high)]
        lists = _lists([*map(pa.array, own), *map(_longs, (to_right, to_left, hull))], text, batch.num_rows)
        has = np.bincount(text, minlength=batch.num_rows) > 0
        sizes = np.diff(first)
        digests = [None if h else hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
                   for h, t in zip(has, texts.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("id", "th", "doc_id")), pa.array(sizes), pa.array(digests, pa.string()),
             pa.array([t if h else None for h, t in zip(has, texts.to_pylist())], pa.string()), *lists],
            names=["id", "th", "doc_id", "n_words", "whole", "text", "anchor", "low", "high", "right", "left", "hull"])


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of intervals, and the number of the interval of each."""
    sizes = np.maximum(high - low + 1, 0)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes), np.repeat(np.arange(len(low)), sizes)


def open_windows(batches: Iterator[pa.RecordBatch], length: int, gram: int, half: int) -> Iterator[pa.RecordBatch]:
    """(hash, id, th, at, weight) of the windows that blocks leave open, and of one copy of each known block.

    `halves` are the repeated half windows (place of the anchor, negative less one on the left side), `copies`
    the anchors of repeated blocks, negative less one if this one stands for all.
    """
    for batch in sliced(batches):
        words = Words(batch.column("text"))
        whole = windows(words.hashes(), length) if len(words) >= length else np.zeros(0, np.uint64)
        anchor, row = _flat(batch.column("anchor"))
        low, high = _flat(batch.column("low"))[0], _flat(batch.column("high"))[0]
        halves, half_row = _flat(batch.column("halves"))
        copies, copy_row = _flat(batch.column("copies"))
        key = row * FAR
        chosen = np.isin(key - anchor - 1, copy_row * FAR + copies)
        known = chosen | np.isin(key + anchor, copy_row * FAR + copies)
        right = np.isin(key + anchor, half_row * FAR + halves)
        left = np.isin(key - anchor - 1, half_row * FAR + halves)
        # A window whose anchor is too far in for the right half window to fit holds the left one.
        edge = anchor - (length - half)
        low = np.where(known | left, low, np.maximum(low, edge))
        high = np.where(known | right, high, np.minimum(high, edge - 1))
        take = np.flatnonzero(chosen | ~known)
        at, which = _expand(low[take].astype(np.int64), high[take].astype(np.int64))
        text = row[take][which]
        yield pa.RecordBatch.from_arrays(
            [_longs(whole[at + words.first[text]]), batch.column("id").take(pa.array(text)), batch.column("th").take(pa.array(text)),
             pa.array(at.astype(np.int32)), pa.array(np.where(chosen[take], 2, 1)[which].astype(np.int32))],
            names=["hash", "id", "th", "at", "weight"])


def cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) of the texts: words of repeated windows are gone."""
    for batch in sliced(batches):
        found = Words(batch.column("text"))
        anchor, row = _flat(batch.column("anchor"))
        low, high = _flat(batch.column("low"))[0], _flat(batch.column("high"))[0]
        copies, copy_row = _flat(batch.column("copies"))
        known = np.isin(row * FAR + anchor, copy_row * FAR + np.where(copies < 0, -copies - 1, copies))
        singles, single_row = _flat(batch.column("singles"))
        edges = np.zeros(len(found) + 1, np.int64)
        np.add.at(edges, low[known] + found.first[row[known]], 1)
        np.add.at(edges, high[known] + length + found.first[row[known]], -1)
        np.add.at(edges, singles + found.first[single_row], 1)
        np.add.at(edges, singles + length + found.first[single_row], -1)
        stay = np.cumsum(edges[:-1]) == 0
        sizes = np.diff(found.first)
        kept = np.bincount(found.text[stay], minlength=batch.num_rows)
        out = []
        for k, whole in enumerate(batch.column("text").to_pylist()):
            mine = stay[found.first[k]:found.first[k + 1]]
            out.append(None if whole is None else b" ".join([w for w, s in zip(whole.encode().split(), mine) if s]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(sizes - kept), pa.array(out, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])
