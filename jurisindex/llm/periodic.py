"""Periodic runs: stretches of words that repeat themselves, found by recompression.

A run of period p and length `times` p or more holds a place of the grid 0, (times - 1) p, 2 (times - 1) p, ...
whose word comes again p words on.  Over all periods these grids are harmonic: they have n log n places, not n
for each period.  From each candidate place the exact extensions to both sides are read off a run-length
grammar of the words (see recompression), without a suffix array.  Of equal stretches the least period counts:
longer ones that fit it are its multiples.

Each text is worked on by itself; nothing is shuffled.  Texts go through as batches of bounded size, a longer
text alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisindex.functions.binding import let
from jurisindex.llm.recompression import Grammar
from jurisindex.llm.texts import word_array
from jurisindex.llm.words import sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TIMES, LEAST = 4, 6
#: Grid places that are held at a time.
PLACES = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _candidates(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, most: np.ndarray):
    """(place, period) arrays of the grid places whose symbol comes again a period on."""
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (size[text] - period - 1) // (step * period) + 1
    ends = np.cumsum(count)
    row = 0
    while row < len(text):
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PLACES, "right")))
        own = count[row:last]
        p = np.repeat(period[row:last], own)
        k = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        place = np.repeat(begin[text[row:last]], own) + step * k * p
        again = symbols[place] == symbols[place + p]
        yield place[again], p[again]
        row = last


def runs_of(words: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run in texts of numbered words, by text, start and period.

    Text t has the words first[t] to first[t + 1].  A run has `least` words and `times` periods or more.
    """
    texts, size = len(first) - 1, np.diff(first)
    begin = first[:-1] + np.arange(texts) + 1
    top = int(words.max(initial=-1)) + 1
    symbols = np.insert(words, first, top + np.arange(texts + 1))
    most = np.where(size >= least, size // times, 0)
    grammar = Grammar(symbols, top)
    found = [(np.zeros(0, np.int64),) * 3]
    for place, period in _candidates(symbols, begin, size, times - 1, most):
        after = grammar.extensions(place, place + period)
        before = grammar.extensions(place - 1, place + period - 1, forward=False)
        length = before + after + period
        long = length >= np.maximum(least, times * period)
        found.append((place[long] - before[long], length[long], period[long]))
    start, length, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    text = np.searchsorted(begin, start, "right") - 1
    start = start - begin[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _found(texts: pa.Array, times: int, least: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and the text without their repetitions."""
    numbers: dict[bytes, int] = {}
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts.to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in split for w in own), np.int64, first[-1])
    text, start, length, period = runs_of(words, first, times, least)
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, first[text] + start + period, 1)
    np.add.at(change, first[text] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed = []
    for t, own in enumerate(split):
        stay = kept[first[t]:first[t + 1]]
        own = own if stay.all() else [own[i] for i in np.flatnonzero(stay)]
        collapsed.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    offsets = np.searchsorted(text, np.arange(len(split) + 1))
    rows = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(_ARROW_RUNS), pa.array(collapsed, pa.string())


def with_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, text: str = "text") -> DataFrame:
    """`docs` with `runs` (array of start, length and period in words) and `collapsed_text`.

    Words are what white space (0x20, 0x09-0x0D) parts, unchanged.  A run is a stretch whose words agree with
    those a period on, of `least` words and `times` periods or more, that no word next to it extends; its
    period is the least one.  Runs stand by start, then period.  The collapsed text has the words that no run
    repeats (each run's first period stays unless another run repeats it), joined by a space.  A null or empty
    text has no runs and an empty collapsed text; repeated rows each get theirs, an empty table gives no rows.
    Other columns stay as they are; those named like the new ones, in any case, are replaced.
    """
    new = ("runs", "collapsed_text")
    own = [c for c in docs.columns if c.lower() not in new]
    fields = [*docs.select(*[f"`{c}`" for c in own]).schema.fields,
              T.StructField("runs", RUNS), T.StructField("collapsed_text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced((pa.RecordBatch.from_struct_array(b.column("row")) for b in batches), text):
            columns = _found(batch.column(text), times, least)
            rows = pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])
            yield pa.RecordBatch.from_arrays([rows.to_struct_array()], names=["row"])

    # A row as one column: names with a dot are none to mapInArrow.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.StructType(fields))])).select("row.*")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length by period, of equal ones the first; null without runs."""
    none = F.lit(None).cast(RUNS.elementType)
    return F.reduce(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by the CRC of its doc_id) repeats words of its own to the end.

    From word a on, the first p words come again and again; a and p follow from the CRC.  A null doc_id keeps
    its text.
    """
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(crc / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(w, lambda x, i: F.when(
            i < s["a"], x).otherwise(F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))

    changed = let(word_array(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.select("doc_id", F.coalesce(F.when(crc % 10 == 0, changed), F.col("text")).alias("text"))


def periodic_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of the runs and of the collapsed text, of every document."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = with_runs(repeated_tails(docs)).withColumn("best", strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
