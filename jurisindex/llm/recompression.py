"""Longest common extensions inside a sequence, on a run-length grammar made by recompression.

Levels alternate.  A block level makes one symbol of each maximal block of equal symbols; a pair level deals
the alphabet into two sides and makes one symbol of each left symbol that a right one follows.  Where two
places continue alike, all levels cut them alike but for one symbol or block at the ends.  So an extension is
found by going up while the symbols at both places agree, and down again to the first symbols that differ:
a constant number of steps a level, for arrays of queries at a time.  New symbols stand for equal content
only, never for a hash of it, so the answers are exact.

A level is made when some query comes that far.  Marks are symbols that stand once; they are never merged.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from jurisindex.llm.words import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Grammar:
    """The levels over `symbols` (from 0 on); those from `marks` on stand once each, also first and last."""

    def __init__(self, symbols: np.ndarray, marks: int) -> None:
        self.symbols = [symbols]
        self.marks, self.next = (marks, int(symbols.max()) + 1), int(symbols.max()) + 1
        self.first: list[np.ndarray] = []  # where each symbol of the next level begins, and the end
        self.group: list[np.ndarray] = []  # the symbol of the next level that each symbol is part of

    def _named(self, named: np.ndarray, chosen: np.ndarray, content: np.ndarray) -> None:
        """New names for the `chosen` of `named`, equal where `content` is."""
        codes, distinct = pd.factorize(content)
        named[chosen] = self.next + codes
        self.next += len(distinct)

    def _raise(self) -> None:
        """One more level."""
        low = self.symbols[-1]
        if len(self.symbols) % 2:
            starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            size = np.diff(np.append(starts, len(low)))
            named = low[starts]
            more = np.flatnonzero(size > 1)
            self._named(named, more, named[more] * (len(low) + 1) + size[more])
        else:
            side = (mixed(low.astype(np.uint64) + np.uint64(len(self.symbols) << 40)) & np.uint64(1)).astype(bool)
            free = (low < self.marks[0]) | (low >= self.marks[1])
            both = free[1:] & free[:-1]
            one, other = both & ~side[:-1] & side[1:], both & side[:-1] & ~side[1:]
            paired = np.append(one if one.sum() >= other.sum() else other, False)
            starts = np.flatnonzero(np.concatenate([[True], ~paired[:-1]]))
            size = np.diff(np.append(starts, len(low)))
            named = low[starts]
            more = np.flatnonzero(size > 1)
            self._named(named, more, named[more] * self.next + low[starts[more] + 1])
        self.first.append(np.append(starts, len(low)))
        self.group.append(np.repeat(np.arange(len(starts)), size))
        self.symbols.append(named)

    def extensions(self, x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from x and from y on (or back) agree.  Between x and y, or at one, a mark must end it."""
        a, b, step = x.copy(), y.copy(), 1 if forward else -1
        stop = np.zeros(len(x), np.int64)
        going, level = np.arange(len(x)), 0
        while len(going):
            symbols = self.symbols[level]
            i, j = a[going], b[going]
            same = symbols[i] == symbols[j]
            stop[going[~same]] = level
            going, i, j = going[same], i[same], j[same]
            if not len(going):
                break
            if level == len(self.first):
                self._raise()
            first, group = self.first[level], self.group[level]
            gi, gj = group[i], group[j]
            # What is left of the group at each place; a group that is whole is compared above.
            left = first[gi + 1] - i if forward else i - first[gi] + 1
            right = first[gj + 1] - j if forward else j - first[gj] + 1
            whole = (left == first[gi + 1] - first[gi]) & (right == first[gj + 1] - first[gj])
            ends = ~whole & (left != right) if level % 2 == 0 else np.zeros(len(going), bool)
            moved = step * np.minimum(left, right)[ends]
            a[going[ends]], b[going[ends]] = i[ends] + moved, j[ends] + moved
            stop[going[ends]] = level
            on = ~ends
            shift = np.where(whole, 0, step)[on]
            going = going[on]
            a[going], b[going] = gi[on] + shift, gj[on] + shift
            level += 1
        for level in range(int(stop.max(initial=0)) - 1, -1, -1):
            down = np.flatnonzero(stop > level)
            first, symbols = self.first[level], self.symbols[level]
            ga, gb = a[down], b[down]
            i, j = (first[ga], first[gb]) if forward else (first[ga + 1] - 1, first[gb + 1] - 1)
            common = np.minimum(first[ga + 1] - first[ga], first[gb + 1] - first[gb])
            if level % 2:
                common = np.minimum(common, 1)
            moved = step * np.where(symbols[i] == symbols[j], common, 0)
            a[down], b[down] = i + moved, j + moved
        return np.abs(a - x)
