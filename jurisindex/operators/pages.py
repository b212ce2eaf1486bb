"""Decision pages: plain text, metadata, links and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurisindex.functions.constants import (
    HEADING_PATTERN, KEY_TERMS, NO_DOCKET, NO_JUDGE, NO_NUMBER, PAGE_PATTERNS, PAGE_SUBJECT_AREA,
    PAGE_TOPIC, STRICT_PAGE_PATTERNS, SUBJECT_LENGTH, SUMMARY_LENGTH,
)
from jurisindex.functions.predicates import any_of
from jurisindex.functions.markup import hrefs, visible_text, without_hidden
from jurisindex.functions.text import clean_text, prefix, strip, summary, text


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the markup by `texto_completo`, the shown text."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, visible_text(html).alias("texto_completo"))


def page_decisions(pages: DataFrame, as_of: str, strict: bool = False, html: str = "html") -> DataFrame:
    """Metadata of decision pages, by pattern over the shown text.

    `as_of` is the date text of pages that state none.  The loose patterns also match inside words
    and let the judge's name run into the next line; `strict` stops at word and line ends.
    """
    patterns = STRICT_PAGE_PATTERNS if strict else PAGE_PATTERNS
    texts = page_text(pages, html)
    found = lambda name: F.regexp_extract("texto_completo", patterns[name], 1)
    raw = texts.select("*", *[found(name).alias("_" + name) for name in patterns])
    value = lambda name, default: F.when(
        F.col("_" + name) == "", F.lit(default)
    ).otherwise(F.col("_" + name)).alias(name)
    cleaned = lambda name, default: F.when(
        F.col("_" + name) == "", F.lit(default)
    ).otherwise(clean_text("_" + name)).alias(name)
    return raw.select(
        *[c for c in texts.columns if c != "texto_completo"],
        value("numero_sentencia", NO_NUMBER),
        value("expediente", NO_DOCKET),
        value("fecha", as_of),
        cleaned("ponente", NO_JUDGE),
        cleaned("materia", PAGE_SUBJECT_AREA),
        cleaned("tema", PAGE_TOPIC),
        summary("texto_completo", SUMMARY_LENGTH).alias("resumen"),
        "texto_completo",
    )


def with_subject(decisions: DataFrame) -> DataFrame:
    """Page decisions with `asunto`: the start of their summary."""
    return decisions.withColumn("asunto", prefix("resumen", SUBJECT_LENGTH))


def _links(html: str, suffix: str | None) -> Column:
    links = hrefs(without_hidden(html))
    if suffix is None:
        return links
    return F.filter(links, lambda href: href.rlike(suffix))


DECISION_SUFFIX = r"(?i)\.html$"


def page_links(pages: DataFrame, suffix: str | None = DECISION_SUFFIX, html: str = "html") -> DataFrame:
    """Links of every page in order: `pos` and `href`; `suffix` None keeps every link."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(_links(html, suffix)).alias("pos", "href"))


def resolve_links(links: DataFrame, base: Column | str) -> DataFrame:
    """Adds `link`: the address itself if it starts with 'http', else the base and the address."""
    base = F.lit(base) if isinstance(base, str) else base
    relative = F.concat(base, F.ltrim("href", F.lit("/")))
    return links.withColumn("link", F.when(F.col("href").startswith("http"), F.col("href")).otherwise(relative))


def first_links(
    listings: DataFrame, k: int = 3, suffix: str | None = DECISION_SUFFIX, html: str = "html"
) -> DataFrame:
    """The first k links of every listing page.  The cut is made inside the page's own row."""
    kept = [c for c in listings.columns if c != html]
    return listings.select(*kept, F.posexplode(F.slice(_links(html, suffix), 1, k)).alias("pos", "href"))


def first_links_by(
    listings: DataFrame, group: Column, order: str, k: int = 3, suffix: str | None = DECISION_SUFFIX,
    html: str = "html",
) -> DataFrame:
    """The first k links of every group of listing pages, pages taken by `order`.

    Each page gives at most k candidates, and Spark cuts every task's rows to k per group before
    the shuffle, so a large group does not gather in one task.
    """
    candidates = first_links(listings.withColumn("grupo", group), k, suffix, html)
    place = F.row_number().over(Window.partitionBy("grupo").orderBy(order, "pos"))
    return candidates.withColumn("puesto", place).where(F.col("puesto") <= k)


def limit_links(
    listings: DataFrame, order: str, limit: int, suffix: str | None = DECISION_SUFFIX, html: str = "html"
) -> DataFrame:
    """The first `limit` links of all listing pages, as a top-k (no full sort)."""
    return first_links(listings, limit, suffix, html).orderBy(order, "pos").limit(limit)


def decision_sections(decisions: DataFrame, body: str = "texto_completo") -> DataFrame:
    """Paragraphs of decision texts: `parrafo` (number), `seccion` (headings so far), `es_titulo`, `texto`.

    A paragraph that is a heading phrase or a roman numeral is a title and is upper-cased; in the
    others markup characters are escaped and the key legal terms marked.  Section numbers count
    the headings up to a paragraph inside the text's own row, so no text is shuffled.
    """
    kept = [c for c in decisions.columns if c != body]
    paragraphs = F.filter(F.transform(F.split(text(body), "\n\n"), strip), lambda p: p != "")
    split = decisions.select(*kept, paragraphs.alias("_paragraphs"))
    titles = F.filter(
        F.transform("_paragraphs", lambda p, i: F.when(p.rlike(HEADING_PATTERN), i)), lambda i: i.isNotNull()
    )
    rows = split.select("*", titles.alias("_titles")).select(
        *kept, "_titles", F.posexplode("_paragraphs").alias("parrafo", "_p")
    )
    number = F.col("parrafo")
    is_title = F.array_contains("_titles", number)
    escaped = F.replace(F.replace(F.col("_p"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # Plain containment is much cheaper than the pattern and rules out nearly all paragraphs.
    marked = F.when(
        any_of([F.col("_p").contains(term) for term in KEY_TERMS]),
        F.regexp_replace(escaped, r"(?U)\b(" + "|".join(KEY_TERMS) + r")\b", "<b>$1</b>"),
    ).otherwise(escaped)
    return rows.select(
        *kept,
        "parrafo",
        F.size(F.filter("_titles", lambda t: t <= number)).alias("seccion"),
        is_title.alias("es_titulo"),
        F.when(is_title, F.upper("_p")).otherwise(marked).alias("texto"),
    )
