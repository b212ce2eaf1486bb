"""Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.binding import let

WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def word_array(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    none = F.array().cast("array<string>")
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)),
        lambda t: F.when(t == "", none).otherwise(F.split(t, GAP)),
    )


def word_count(text: Column) -> Column:
    """The number of words as a long; 0 for null."""
    return F.size(word_array(text)).cast("long")


def as_row(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of `docs` as the struct `row`, so that no name of theirs meets one of a step.

    Those named in `but`, in any case, are left out.
    """
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in but]).alias("row")


def source_key(source: Column) -> Column:
    """A name of a source that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
