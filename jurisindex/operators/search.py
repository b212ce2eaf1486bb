"""Scans and searches of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from jurisindex.functions import predicates as P
from jurisindex.functions.constants import (
    CAPTURE_TOPIC, DETAIL_DEFAULT, NO_JUDGE, STORE_SUBJECT_AREA, TECH_CATEGORY,
)
from jurisindex.functions.predicates import keep
from jurisindex.functions.text import first_truthy, preview


def newest_first(store: DataFrame) -> DataFrame:
    """Newest year first, then the latest inserted."""
    return store.orderBy(F.desc("ano"), F.desc("first_seen"))


def tech_filter(decisions: DataFrame, body: str = "texto_completo") -> DataFrame:
    """Decisions whose text holds a technology keyword, with their category."""
    return decisions.where(P.has_keyword(body)).withColumn("categoria", F.lit(TECH_CATEGORY))


def search4(df: DataFrame, kw: str) -> DataFrame:
    return keep(df, P.keyword4(kw))


def search6(df: DataFrame, kw: str) -> DataFrame:
    return keep(df, P.keyword6(kw))


def search6_folded(df: DataFrame, kw: str) -> DataFrame:
    return keep(df, P.keyword6_folded(kw, df.columns))


def store_search(store: DataFrame, query: str = "", sala: str = "", ano: int | None = None) -> DataFrame:
    """LIKE search over six fields, chamber text and year, newest first."""
    found = keep(keep(keep(store, P.year_is(ano)), P.like_sala(sala)), P.like6(query))
    return newest_first(found)


def faceted_search(
    store: DataFrame, sala: str = "todas", mes: str = "todo_el_ano", q: str = "", folded: bool = False
) -> DataFrame:
    """Chamber, month and keyword together; an unknown choice filters nothing.

    `folded` ignores accents and finds chambers by any alias; choices are then given by key only,
    otherwise by key or code.
    """
    if folded:
        sala = P.choice(sala, P.SALA_CHOICES, by_code=False)[0]
        conditions = [P.sala_by_alias(sala), P.month_folded(mes), P.keyword6_folded(q, store.columns)]
    else:
        conditions = [P.sala_plain(sala), P.month_plain(mes), P.keyword6(q)]
    for condition in conditions:
        store = keep(store, condition)
    return store


def faceted_count(store: DataFrame, **facets: str) -> DataFrame:
    """The size of a faceted search, as one row."""
    return faceted_search(store, **facets).agg(F.count("*").alias("total"))


def refine(result: DataFrame, kw: str) -> DataFrame:
    """Narrow a result by one more keyword (persist the result to refine it repeatedly)."""
    return keep(result, P.keyword6(kw, trimmed=True))


# --- presentation --------------------------------------------------------------------------


def _judge(df: DataFrame) -> Column:
    return first_truthy("ponente", default=NO_JUDGE) if "ponente" in df.columns else F.lit(NO_JUDGE)


def _date() -> Column:
    return F.coalesce(first_truthy("fecha"), F.col("ano").cast("string"))


def decision_cards(store: DataFrame, cut_always: bool = True) -> DataFrame:
    """What a result card shows."""
    return store.select(
        "sala", _date().alias("fecha"), "numero_sentencia", "expediente",
        _judge(store).alias("ponente"),
        first_truthy("tema", default=CAPTURE_TOPIC).alias("tema"),
        first_truthy("materia", default=STORE_SUBJECT_AREA).alias("materia"),
        preview("extracto", "asunto", always=cut_always).alias("vista"),
        "link_directo",
    )


def detail_view(store: DataFrame) -> DataFrame:
    """What the detail of a decision shows."""
    return store.select(
        "sala", "expediente", "numero_sentencia",
        F.coalesce(_date(), F.lit("")).alias("fecha"),
        _judge(store).alias("ponente"),
        first_truthy("tema", default=DETAIL_DEFAULT).alias("tema"),
        first_truthy("materia", default=DETAIL_DEFAULT).alias("materia"),
        F.coalesce(first_truthy("extracto", "asunto"), F.lit("")).alias("extracto"),
        first_truthy("link_directo", default="#").alias("url"),
    )


def decision_detail(store: DataFrame, link: str) -> DataFrame:
    """Detail of the decision with this link."""
    return detail_view(store.where(F.col("link_directo") == link))


def decision_at(result: DataFrame, position: int) -> DataFrame:
    """Detail of the row at a position of an ordered result: a top-k, for the first places of a result."""
    return detail_view(result.offset(position).limit(1))


def newest_at(store: DataFrame, position: int, ranges: int = 256, key: str | None = None) -> DataFrame:
    """The row at a place (from 0) of `newest_first`, however far down; no row beyond the end.

    Rows are counted by year and, in the year that holds the place, by ranges of their arrival.  Only the
    range with the place is sorted.  What comes to the driver is a count for each year and each range.
    `key` names a column without repeats, for stores that are made when read: the place is then found by years,
    arrivals and keys alone, and the row is read by its key, so that no other row's values are made or moved.
    """
    def placed(counts: list[Row], left: int) -> tuple[Row | None, int]:
        for row in counts:
            if left < row["count"]:
                return row, left
            left -= row["count"]
        return None, left

    years = store.groupBy("ano").count().orderBy(F.desc("ano")).collect()
    year, left = placed(years, position)
    if year is None:
        return store.limit(0)
    inside = store.where(F.col("ano").eqNullSafe(F.lit(year.ano)))
    cuts = inside.agg(F.percentile_approx("first_seen", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = F.array(*[F.lit(c).cast(store.schema["first_seen"].dataType) for c in sorted(set(cuts))])
    ranged = inside.withColumn("_rango", F.size(F.filter(cuts, lambda c: c < F.col("first_seen"))))
    chosen, left = placed(ranged.groupBy("_rango").count().orderBy(F.desc("_rango")).collect(), left)
    part = ranged.where(F.col("_rango") == chosen["_rango"]).drop("_rango")
    if key is None:
        return newest_first(part).offset(left).limit(1)
    found = newest_first(part.select(key, "ano", "first_seen")).offset(left).limit(1).first()
    return store.where(F.col(key).eqNullSafe(F.lit(found[key]).cast(store.schema[key].dataType)))
