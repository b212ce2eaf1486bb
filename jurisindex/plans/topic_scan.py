"""Scan listing pages for decisions on a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.operators.pages import first_links, first_links_by, page_decisions, resolve_links
from jurisindex.operators.search import tech_filter


def topic_scan(
    listings: DataFrame, pages: DataFrame, base: Column | str, as_of: str, per_listing: int = 3,
    per_sala: int | None = None, order: str = "resp_id",
) -> DataFrame:
    """Decisions on digital evidence among the first links of every listing, or with `per_sala` of every chamber.

    `listings` has `sala_key`, `sala` and `html`; `pages` has `url` and `html`.  The limit comes
    before the topic filter.  A chamber's listings are taken by `order`.  Only the short link rows are
    joined to the pages by address; text is read once, after the join.
    """
    if per_sala is None:
        first = first_links(listings, per_listing)
    else:
        first = first_links_by(listings, F.col("sala_key"), order, per_sala)
    links = resolve_links(first, base).select("sala_key", "sala", "link")
    opened = links.join(pages.select(F.col("url").alias("link"), "html"), "link")
    return tech_filter(page_decisions(opened.withColumnRenamed("link", "url"), as_of))
