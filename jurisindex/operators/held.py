"""A search result that is held while a user refines it.

The result is fetched once and kept by the executors as compressed columns with the least and greatest value of
each batch, in memory and, where that is full, on disk.  Its six searched fields are lower-cased once, into one
prepared column, so that a refinement is one look through held text.  A lost executor's part is made again from
the store.  Nothing of the result comes to the driver.
"""

from __future__ import annotations

from types import TracebackType

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.functions import predicates as P
from jurisindex.functions.predicates import keep
from jurisindex.functions.text import is_blank, text

LOWERED_COLUMN = "buscable_minusculas"


class HeldResult:
    """`result`, held until `release()` or the end of a with-block.

    `rows` are the rows themselves; refinements are DataFrames over the held columns.  Releasing does not spoil
    them: they read the store again.  A blank keyword refines nothing.  A column named `buscable_minusculas` in
    the result is replaced.
    """

    def __init__(self, result: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self._columns = [c for c in result.columns if c.lower() != LOWERED_COLUMN]
        lowered = F.concat_ws(P.FIELD_DIVIDER, *[F.lower(text(c)) for c in P.FIELDS6])
        self._held = result.withColumn(LOWERED_COLUMN, lowered).persist(level)

    def __enter__(self) -> HeldResult:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.release()

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"`{c}`" for c in self._columns])

    @property
    def rows(self) -> DataFrame:
        return self._shown(self._held)

    def refine(self, *keywords: str, sala: str = "todas", mes: str = "todo_el_ano") -> DataFrame:
        """Rows that hold every keyword in one of the six fields, of a chamber and month if given."""
        found = self._held
        for kw in keywords:
            if P.FIELD_DIVIDER in kw:
                found = keep(found, P.keyword6(kw, trimmed=True))
            elif not is_blank(kw):
                found = found.where(F.col(LOWERED_COLUMN).contains(kw.lower().strip()))
        return self._shown(keep(keep(found, P.sala_plain(sala)), P.month_plain(mes)))

    def counts(self) -> DataFrame:
        """Rows held for each chamber and year."""
        return self._held.groupBy("sala", "ano").agg(F.count("*").alias("n"))

    def total(self) -> int:
        return self._held.count()

    def release(self) -> None:
        self._held.unpersist()
