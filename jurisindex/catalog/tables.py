"""Queries of scans, dimensions, counts, links and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.catalog.fixture import DEC, HOSTS, STORE, decisions, single_responses, store, table
from jurisindex.catalog.registry import query
from jurisindex.functions.constants import MES_CHOICES, SALA_CHOICES, SEED_DECISIONS
from jurisindex.operators import stats
from jurisindex.operators.fallback import first_non_empty
from jurisindex.operators.pages import (
    first_links, first_links_by, limit_links, page_decisions, page_links, page_text, resolve_links, with_subject,
)
from jurisindex.operators.scan_plan import missing_scans, scan_plan
from jurisindex.operators.search import newest_first
from jurisindex.plans.sync import captured_decisions
from jurisindex.sources.dimensions import mes_choices, sala_choices

_STORE_COLUMNS = ("link_directo, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, materia, asunto, "
                  "extracto, first_seen, last_seen")


def _captured(spark, sf):
    """The rows of one response for each decision: JSON, table rows and anchors, with the years of their scans."""
    responses = single_responses(decisions(spark, sf))
    return captured_decisions(responses, row_hosts=HOSTS, anchor_hosts=HOSTS, scan_year=True)


@query("store_scan", STORE + f"SELECT {_STORE_COLUMNS} FROM store")
def store_scan(spark, sf):
    return newest_first(store(spark, sf)).select(*_STORE_COLUMNS.split(", "))


@query("dim_sala", DEC + """
, salas(key, nombre, code) AS (SELECT * FROM (VALUES """ + ", ".join(map(str, SALA_CHOICES)) + """) AS t(a, b, c))
SELECT s.key, s.nombre, s.code,
  CASE WHEN s.key = 'todas' THEN (SELECT count(*) FROM dec) ELSE count(d.arrival) END AS decisiones
FROM salas s LEFT JOIN dec d ON d.sala_key = s.key GROUP BY s.key, s.nombre, s.code""")
def dim_sala(spark, sf):
    """The chamber choices, each with its number of decisions."""
    counts = decisions(spark, sf).rollup("sala_key").agg(F.count("*").alias("decisiones"))
    counts = counts.select(F.coalesce("sala_key", F.lit("todas")).alias("key"), "decisiones")
    choices = sala_choices(spark).drop("opcion")
    return choices.join(counts, "key", "left").fillna(0, ["decisiones"])


@query("dim_mes", DEC + """
, meses(key, nombre, code) AS (SELECT * FROM (VALUES """ + ", ".join(map(str, MES_CHOICES)) + """) AS t(a, b, c))
SELECT m.key, m.nombre, m.code,
  CASE WHEN m.key = 'todo_el_ano' THEN (SELECT count(*) FROM dec) ELSE count(d.arrival) END AS decisiones
FROM meses m LEFT JOIN dec d ON contains(lower(d.fecha), m.key) GROUP BY m.key, m.nombre, m.code""")
def dim_mes(spark, sf):
    """The month choices, each with its number of decisions."""
    mes = F.lower(F.split("fecha", " de ")[1]).alias("key")
    counts = decisions(spark, sf).select(mes).rollup("key").agg(F.count("*").alias("decisiones"))
    counts = counts.select(F.coalesce("key", F.lit("todo_el_ano")).alias("key"), "decisiones")
    return mes_choices(spark).drop("opcion").join(counts, "key", "left").fillna(0, ["decisiones"])


@query("scan_plan", DEC + """
SELECT s.sala_key, s.code, CAST(s.i + 1 AS STRING) AS portal_id, s.sala AS nombre, CAST(y.ano AS INT) AS ano
FROM sala s, (SELECT unnest(generate_series(1994, 2003)) AS ano) y
WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.sala_key = s.sala_key AND d.ano = y.ano)""")
def plan(spark, sf):
    """What is left of a scan of all chambers once what was captured is taken off."""
    return missing_scans(scan_plan(spark, "todas", 1994, 2003), _captured(spark, sf))


# --- counts --------------------------------------------------------------------------------


@query("stats_total", STORE + "SELECT count(*) AS total FROM store")
def stats_total(spark, sf):
    return stats.stats_total(store(spark, sf, late=False))


@query("stats_by_sala", STORE + "SELECT sala, count(*) AS n FROM store GROUP BY sala")
def stats_by_sala(spark, sf):
    return stats.stats_by_sala(store(spark, sf, late=False))


@query("sala_ranking", STORE + """
SELECT sala, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, sala) AS INT) AS puesto FROM store GROUP BY sala""")
def sala_ranking(spark, sf):
    return stats.sala_ranking(store(spark, sf, late=False))


@query("stats_by_year", STORE + "SELECT ano, count(*) AS n FROM store GROUP BY ano")
def stats_by_year(spark, sf):
    return stats.stats_by_year(store(spark, sf, late=False))


@query("stats_all", STORE + """
SELECT 'total' AS dim, NULL AS clave, count(*) AS n FROM store
UNION ALL SELECT 'sala', sala, count(*) FROM store GROUP BY sala
UNION ALL SELECT 'ano', CAST(ano AS STRING), count(*) FROM store GROUP BY ano""")
def stats_all(spark, sf):
    return stats.stats_all(store(spark, sf, late=False))


@query("store_stats", STORE + """
SELECT 'sala_' || sala_key AS almacen, 'total' AS dim, NULL AS clave, count(*) AS n FROM store GROUP BY sala_key
UNION ALL SELECT 'sala_' || sala_key, 'sala', sala, count(*) FROM store GROUP BY sala_key, sala
UNION ALL SELECT 'sala_' || sala_key, 'ano', CAST(ano AS STRING), count(*) FROM store GROUP BY sala_key, ano""")
def store_stats(spark, sf):
    return stats.store_stats(store(spark, sf, late=False))


@query("capture_counts", DEC + """
SELECT sala_key, ano, 0 AS nivel, count(*) AS n FROM dec GROUP BY sala_key, ano
UNION ALL SELECT sala_key, NULL, 1, count(*) FROM dec GROUP BY sala_key
UNION ALL SELECT NULL, NULL, 3, count(*) FROM dec""")
def capture_counts(spark, sf):
    return stats.capture_counts(_captured(spark, sf))


# --- fallback ------------------------------------------------------------------------------


@query("fallback_chain", STORE + """
SELECT link_directo, sala, numero_sentencia, fecha, ano, tema FROM store""")
def fallback_chain(spark, sf):
    """Nothing live, nothing in the chamber's store: the general store answers, not the seed rows."""
    columns = ["link_directo", "sala", "numero_sentencia", "fecha", "ano", "tema"]
    dec = decisions(spark, sf)
    live = dec.where(F.col("ano") > 2019).select(*columns)
    chamber = dec.where(F.col("sala_key") == "otra").select(*columns)
    general = store(spark, sf).select(*columns)
    seed = spark.createDataFrame(SEED_DECISIONS).select(*columns)
    return first_non_empty([live, chamber, general, seed.withColumn("ano", F.col("ano").cast("int"))])


@query("fallback_each_leg", DEC + f"""
SELECT 'vivo' AS caso, count(*) AS n, min(link_directo) AS primero FROM dec WHERE ano = 1995
UNION ALL SELECT 'sala', count(*), min(link_directo) FROM dec WHERE sala_key = 'plena'
UNION ALL SELECT 'general', count(*), min(link_directo) FROM dec
UNION ALL SELECT 'semilla', {len(SEED_DECISIONS)}, '{min(r["link_directo"] for r in SEED_DECISIONS)}'""")
def fallback_each_leg(spark, sf):
    """Each source answers once, when all before it hold nothing."""
    dec = decisions(spark, sf).select("link_directo", "sala_key", "ano")
    seed = spark.createDataFrame(SEED_DECISIONS).select("link_directo")
    legs = {"vivo": dec.where("ano = 1995"), "sala": dec.where("sala_key = 'plena'"), "general": dec, "semilla": seed}
    found = []
    for n, caso in enumerate(legs):
        empty = [leg.where(F.length("link_directo") < 0) for leg in list(legs.values())[:n]]
        answer = first_non_empty([leg.select("link_directo") for leg in (*empty, *list(legs.values())[n:])])
        found.append(answer.agg(F.lit(caso).alias("caso"), F.count("*").alias("n"), F.min("link_directo").alias("primero")))
    return reduce(DataFrame.unionByName, found)


# --- pages ---------------------------------------------------------------------------------

_SHOWN = r"""
regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', chr(10), 'gs'),
  '<script.*?</script>|<style.*?</style>', chr(10), 'gsi'), '<[^>]*>', chr(10), 'g')"""
_ENTITIES = [("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")]
for _name, _char in _ENTITIES:
    # Some pages are cut off inside a reference; these names also count without their ';'.
    _SHOWN = f"regexp_replace({_SHOWN}, '{_name}?', {_char}, 'g')"
_PAGE_TEXT = f"""
texts AS (SELECT page_id, url, list_aggregate(list_filter(list_transform(
  string_split_regex({_SHOWN}, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e]'), lambda x: trim(x, chr(9) || chr(32) || chr(160))),
  lambda x: x <> ''), 'string_agg', chr(10) || chr(10)) AS t FROM pages)"""


@query("page_text", f"WITH {_PAGE_TEXT} SELECT page_id, url, t AS texto_completo FROM texts")
def text_of_pages(spark, sf):
    return page_text(table(spark, sf, "pages"))


_PATTERNS = {
    "numero_sentencia": (r"(?i)(?:sentencia|Nº|N°|Nro\.?|Número)\s*[:\.]?\s*(\d+[-–]\d+|\d+)", "S/N"),
    "expediente": (r"(?i)(?:expediente|exp\.?|Nº?\s*de?\s*exp\.?)\s*[:\.]?\s*([A-Z0-9\-\.]{4,})", "S/E"),
    "fecha": (r"(?i)(\d{1,2}\s+de\s+[a-z]+?\s+de\s+\d{4})", "01 de enero de 2026"),
    "ponente": (r"(?i)(?:magistrad[ao]\s+ponente|ponente)\s*[:\.]?\s*((?:Dr[a]?\.\s*)?[A-ZÁÉÍÓÚÑa-záéíóúñ''\s]+)",
                "No especificado"),
    "materia": (r"(?i)(?:materia)\s*[:\.]?\s*([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+?)(?:\n|asunto|tema|$)",
                "Derecho Constitucional / Penal"),
    "tema": (r"(?i)(?:tema)\s*[:\.]?\s*([A-ZÁÉÍÓÚÑa-záéíóúñ\s]+?)(?:\n|asunto|materia|$)",
             "Garantías Procesales y Evidencia Digital"),
}
_METADATA = ", ".join(
    f"coalesce(nullif(regexp_extract(t, '{p}', 1), ''), '{default}') AS {name}"
    for name, (p, default) in _PATTERNS.items()
)


@query("page_decisions", f"""
WITH {_PAGE_TEXT} SELECT page_id, url, {_METADATA},
CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '...' ELSE t END AS resumen, t AS texto_completo FROM texts""")
def decisions_of_pages(spark, sf):
    return page_decisions(table(spark, sf, "pages"), as_of="01 de enero de 2026")


@query("page_subjects", f"""
WITH {_PAGE_TEXT} SELECT page_id, url, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '...' ELSE t END AS resumen,
  substr(t, 1, 100) AS asunto FROM texts""")
def subjects_of_pages(spark, sf):
    """The start of a page's summary stands for its subject."""
    found = with_subject(page_decisions(table(spark, sf, "pages"), as_of="01 de enero de 2026"))
    return found.select("page_id", "url", "resumen", "asunto")


_LINKS = """
WITH clean AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gsi') AS h FROM pages),
listed AS (SELECT page_id, url, regexp_extract_all(h, '<a href="([^"]+)"', 1) AS l FROM clean),
links AS (SELECT page_id, url, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS href FROM listed)"""


@query("page_links", _LINKS + "SELECT page_id, url, pos, href FROM links")
def links_of_pages(spark, sf):
    # No link of these pages ends in '.html'; the suffix is used by topic_scan.
    return page_links(table(spark, sf, "pages"), suffix=None)


@query("page_links_resolved", _LINKS + """
SELECT page_id, url, pos, href, CASE WHEN starts_with(href, 'http') THEN href
  ELSE 'https://historico.example.org/decisiones/scp/' || ltrim(href, '/') END AS link FROM links""")
def resolved_links(spark, sf):
    links = page_links(table(spark, sf, "pages"), suffix=None)
    return resolve_links(links, "https://historico.example.org/decisiones/scp/")


@query("first_links", _LINKS + "SELECT page_id, url, pos, href FROM links WHERE pos < 3")
def first_of_page(spark, sf):
    return first_links(table(spark, sf, "pages"), 3, suffix=None)


_GROUP = "regexp_extract(url, '/(\\w+)/\\d+', 1)"


@query("first_links_by_group", _LINKS + f"""
, placed AS (SELECT {_GROUP} AS grupo, page_id, pos, href,
  CAST(row_number() OVER (PARTITION BY {_GROUP} ORDER BY page_id, pos) AS INT) AS puesto FROM links)
SELECT grupo, page_id, pos, href, puesto FROM placed WHERE puesto <= 3""")
def first_of_group(spark, sf):
    group = F.regexp_extract("url", r"/(\w+)/\d+", 1)
    placed = first_links_by(table(spark, sf, "pages"), group, "page_id", 3, suffix=None)
    return placed.select("grupo", "page_id", "pos", "href", "puesto")


@query("first_links_limit", _LINKS + "SELECT page_id, url, pos, href FROM links ORDER BY page_id, pos LIMIT 10")
def first_of_all(spark, sf):
    return limit_links(table(spark, sf, "pages"), "page_id", 10, suffix=None)
