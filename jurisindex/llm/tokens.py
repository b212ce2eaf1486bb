"""Token counts of whole texts and of all their prefixes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisindex.llm.prefix_bpe import PrefixCounter

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _with(docs: DataFrame, vocabulary: str, fields: T.StructType, rows) -> DataFrame:
    """`docs` with more columns, made by rows(counter, texts) for each batch.

    The vocabulary file (a few MB) is read here and sent to the tasks, which need no such file.  A worker
    keeps its counter, with the pieces that it knows, next to the file from task to task.
    """
    added = [f.name for f in fields]
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    sent = docs.sparkSession.sparkContext.broadcast({"file": Path(vocabulary).read_bytes()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if "counter" not in held:
            held["counter"] = PrefixCounter(held["file"])
        counter = held["counter"]
        for batch in batches:
            columns = rows(counter, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields.fields]))


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`docs` (with text) with `counts`: the tokens of the first k characters at each k from 0 on.

    A null text counts as an empty one.  A column of docs named counts is replaced.
    """
    fields = T.StructType([T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return _with(docs, vocabulary, fields,
                 lambda counter, texts: [pa.array([counter.counts(t or "") for t in texts], pa.list_(pa.int32()))])


def tokens_of_prefix(counts: Column, characters: Column) -> Column:
    """The tokens of so many characters at the start of a text, from its stored counts."""
    return F.get(counts, F.least(characters, F.size(counts) - 1))


def longest_prefix(counts: Column, budget: Column) -> Column:
    """The most characters whose tokens fit the budget, from the stored counts."""
    return F.array_max(F.filter(F.transform(counts, lambda c, i: F.when(c <= budget, i)), lambda i: i.isNotNull()))


def token_counts(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """`docs` (with text) with n_tokens (long) and fit_chars (long), the longest prefix of `limit` tokens at most.

    Both are read from one table of the text's prefixes.  A null text counts as an empty one; a very long piece
    is counted whole, but not remembered.  Repeated rows each get theirs, an empty table gives no rows.  Columns
    of docs with these names are replaced.
    """

    def rows(counter: PrefixCounter, texts: list[str | None]) -> list[pa.Array]:
        totals, fits = [], []
        for text in texts:
            text = text or ""
            table = counter.table(text)
            totals.append(table[1][-1] if table[1] else 0)
            fits.append(counter.longest(text, limit, table))
        return [pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]

    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())])
    return _with(docs, vocabulary, fields, rows)


def token_report(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """Bytes, tokens and the longest prefix within the limit, of every document."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return token_counts(docs.select("doc_id", "text", size.alias("n_bytes")), vocabulary, limit).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
