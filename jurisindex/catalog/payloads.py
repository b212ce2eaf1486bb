"""Queries of the extraction jobs: payloads are made of the decisions and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jurisindex.catalog.fixture import (
    DEC, HOSTS, PAGED, PORTAL_URL, anchor_responses, decision_pages, decisions, json_pages,
    referring, row_responses, single_responses, grouped, table, whole_pages, with_texts,
)
from jurisindex.catalog.registry import query
from jurisindex.functions.constants import TECH_KEYWORDS
from jurisindex.operators.anchors import anchor_context
from jurisindex.operators.fallback import union_captures
from jurisindex.operators.html_items import decode_links, html_decisions
from jurisindex.operators.json_items import json_decisions, json_items
from jurisindex.operators.pages import decision_sections, page_decisions
from jurisindex.plans.sync import captured_decisions
from jurisindex.plans.topic_scan import topic_scan
from jurisindex.sources.captures import routed, usable_responses

_CANONICAL = ("arrival, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, materia, asunto, extracto, "
              "ponente, link_directo")
_ARRIVAL = "resp_id * 4294967296 + 2 * pos AS arrival"
_LINK_DATE = "upper(substr(split_part(link_directo, '/', 6), 1, 1)) || substr(split_part(link_directo, '/', 6), 2)"
_LINK_YEAR = "split_part(split_part(link_directo, '/', 7), '-', 4)"
_CLEAN = r"trim(regexp_replace({c}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}]+', ' ', 'g'))"


@query("responses_usable", DEC + """
SELECT arrival AS resp_id, sala_key, ano FROM dec
WHERE tema NOT IN ('Amparo', 'Nulidad', 'Casación') AND NOT contains(materia, 'NATION_7')""")
def responses_usable(spark, sf):
    """Amparo came from another service, Nulidad and Casación are empty, and one subject area failed."""
    raw = decisions(spark, sf).select(
        F.col("arrival").alias("resp_id"), "sala_key", "ano",
        F.when(F.col("tema") == "Amparo", "https://portal.example.org/inicio")
        .otherwise(F.concat(F.lit(PORTAL_URL), "sala_key")).alias("url"),
        F.when(F.col("materia").contains("NATION_7"), 500).otherwise(200).alias("status"),
        F.when(F.col("tema") == "Nulidad", " {} ").when(F.col("tema") == "Casación", " \n")
        .otherwise(F.col("extracto")).alias("body"),
    )
    return usable_responses(raw).select("resp_id", "sala_key", "ano")


@query("response_routing", DEC + """
SELECT arrival AS resp_id, CASE WHEN tema IN ('Amparo', 'Casación') OR sala_key = 'electoral' THEN 'html'
  ELSE 'json' END AS ruta FROM dec""")
def response_routing(spark, sf):
    """Table rows are HTML, and so is JSON that is cut off or followed by something."""
    tema = decisions(spark, sf).select("arrival", "tema")
    # Joined before the rows have their texts, so that no body is shuffled.
    dec = referring(spark, sf).drop("tema").join(tema, "arrival")
    raw = single_responses(with_texts(dec, table(spark, sf, "documents")), "tema")
    body = (
        F.when(F.col("tema") == "Amparo", F.concat("body", F.lit(" <html>")))
        .when(F.col("tema") == "Casación", F.substr("body", F.lit(2)))
        .otherwise(F.col("body"))
    )
    return routed(raw.withColumn("body", body)).select("resp_id", "ruta")


@query("json_items", PAGED + "SELECT resp_id, sala_key, ano, pos, link_directo AS link FROM paged")
def items(spark, sf):
    found = json_items(json_pages(whole_pages(spark, sf)))
    link = F.coalesce(
        F.get_json_object("item", "$.SLINKDIRECTO"), F.get_json_object("item", "$.link_directo")
    )
    return found.select("resp_id", "sala_key", "ano", F.col("pos").cast("bigint").alias("pos"), link.alias("link"))


@query("json_decisions", PAGED + f"""
SELECT {_ARRIVAL}, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, materia,
  {_CLEAN.format(c='asunto')} AS asunto, {_CLEAN.format(c='extracto')} AS extracto, ponente, link_directo FROM paged""")
def json_rows(spark, sf):
    return json_decisions(json_pages(whole_pages(spark, sf)))


@query("html_row_decisions", PAGED + f"""
SELECT {_ARRIVAL}, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, 'Derecho' AS materia,
  'ver' AS asunto, 'ver' AS extracto, '' AS ponente, link_directo, 'fila' AS patron FROM paged""")
def html_rows(spark, sf):
    return html_decisions(row_responses(decisions(spark, sf)), HOSTS, HOSTS)


@query("html_nested_rows", PAGED + """
SELECT resp_id * 4294967296 + 2 * (pos + 1) AS arrival, sala_key, numero_sentencia, expediente, fecha, tema, 'ver' AS asunto,
  link_directo FROM paged
UNION ALL SELECT resp_id * 4294967296, sala_key, 'Listado', 'Nro' || string_agg(numero_sentencia || expediente || fecha || tema
  || 'ver', '' ORDER BY pos), 'Nro', arg_min(numero_sentencia, pos), arg_min(expediente, pos) || ' ' || arg_min(fecha, pos) || ' '
  || arg_min(tema, pos) || ' ver' || coalesce(' ' || string_agg(CASE WHEN pos > 0 THEN numero_sentencia || ' ' || expediente || ' '
  || fecha || ' ' || tema || ' ver' END, ' ' ORDER BY pos), ''), arg_min(link_directo, pos)
FROM paged GROUP BY resp_id, sala_key""")
def html_nested_rows(spark, sf):
    """Each response's table stands in a cell of another one: its rows are rows, and the outer row holds all their cells."""
    pages = row_responses(decisions(spark, sf))
    body = F.concat(F.lit("<table class='x'><tr><td>Listado <td>"), "body", F.lit("</td></tr></table>"))
    found = html_decisions(pages.withColumn("body", body), HOSTS, HOSTS, nested=True)
    return found.select("arrival", "sala_key", "numero_sentencia", "expediente", "fecha", "tema", "asunto", "link_directo")


@query("html_anchor_decisions", PAGED + f"""
SELECT {_ARRIVAL}, sala_key, sala, numero_sentencia, replace(expediente, '-', '/') AS expediente,
  {_LINK_DATE} || ' ' || {_LINK_YEAR} AS fecha, CAST({_LINK_YEAR} AS INT) AS ano, tema, 'Derecho' AS materia,
  tema AS asunto, tema AS extracto, '' AS ponente, link_directo, 'enlace' AS patron FROM paged""")
def html_anchors(spark, sf):
    return html_decisions(anchor_responses(decisions(spark, sf)), HOSTS, HOSTS)


@query("url_decode", DEC + f"""
SELECT arrival, link_directo, split_part(link_directo, '/', 5) AS url_code, numero_sentencia AS url_numero,
  replace(expediente, '-', '/') AS url_expediente, {_LINK_DATE} || ' ' || {_LINK_YEAR} AS url_fecha,
  CAST({_LINK_YEAR} AS INT) AS url_ano FROM dec""")
def url_decode(spark, sf):
    return decode_links(decisions(spark, sf).select("arrival", "link_directo"))


@query("anchor_context", PAGED + f"""
SELECT resp_id * 4294967296 + 2 * (pos + 1) + 1 AS arrival, sala_key, sala, numero_sentencia,
  replace(expediente, '-', '/') AS expediente, {_LINK_DATE} || ' de ' || {_LINK_YEAR} AS fecha,
  CAST({_LINK_YEAR} AS INT) AS ano, 'Sala:' || tema || fecha AS tema, 'Derecho' AS materia,
  'Sala:' || tema || fecha AS asunto, 'Sala:' || tema || fecha AS extracto, '' AS ponente, link_directo
FROM paged""")
def blocks(spark, sf):
    # Positions count every anchor; the first one of each page leads elsewhere.
    return anchor_context(anchor_responses(decisions(spark, sf)), HOSTS)


@query("page_decisions_court", DEC + """
SELECT arrival, sala_key, sala, link_directo AS url, numero_sentencia, expediente, fecha,
  'Juez Principal Fecha' AS ponente, 'Derecho Constitucional / Penal' AS materia,
  'Garantías Procesales y Evidencia Digital' AS tema,
  'Decisión

TRIBUNAL

Sentencia Nº ' || numero_sentencia || '

Expediente: ' || expediente || '

Magistrado Ponente: Juez' || chr(160) || 'Principal

Fecha: ' || fecha || '

Asunto & ' || tema AS texto_completo, texto_completo AS resumen FROM dec""")
def court_pages(spark, sf):
    """Metadata of generated decision pages; the judge's name runs into the next line."""
    return page_decisions(decision_pages(decisions(spark, sf)), as_of="01 de enero de 2026")


@query("decision_sections", DEC + r"""
, texts AS (SELECT arrival, '  antecedentes' || chr(10) || chr(10) || extracto || chr(10) || chr(10) || 'II' ||
  chr(10) || chr(10) || 'Se DECLARA CON LUGAR <' || tema || '>, ANULADA' || chr(10) || chr(10) || 'Decisión' ||
  chr(10) || 'fin' AS t FROM dec),
parts AS (SELECT arrival, list_filter(list_transform(string_split(t, chr(10) || chr(10)),
  lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ' || chr(160))), lambda x: x <> '') AS l FROM texts),
rows AS (SELECT arrival, CAST(generate_subscripts(l, 1) - 1 AS INT) AS parrafo, unnest(l) AS p FROM parts),
marked AS (SELECT arrival, parrafo, p, regexp_matches(lower(p),
  '^(i+|ii+|iii+|iv+|v+|de la competencia|motivación|consideraciones|antecedentes|decisión|del recurso interpuesto)$')
  AS es_titulo FROM rows)
SELECT arrival, parrafo, es_titulo,
  CAST(sum(CAST(es_titulo AS INT)) OVER (PARTITION BY arrival ORDER BY parrafo) AS INT) AS seccion,
  CASE WHEN es_titulo THEN upper(p) ELSE replace(replace(replace(replace(p, '<', '&lt;'), '>', '&gt;'),
    'DECLARA', '<b>DECLARA</b>'), 'CON LUGAR', '<b>CON LUGAR</b>') END AS texto FROM marked""")
def sections(spark, sf):
    body = F.concat(
        F.lit("  antecedentes\n\n"), "extracto", F.lit("\n\nII\n\nSe DECLARA CON LUGAR <"), "tema",
        F.lit(">, ANULADA\n\nDecisión\nfin"),
    )
    return decision_sections(decisions(spark, sf).select("arrival", body.alias("texto_completo")))


_KEYWORD_TEMA = " OR ".join(f"contains(lower(tema), '{k}')" for k in TECH_KEYWORDS)


_TOPICS = f"""
newest AS (SELECT link_directo, arg_max(tema, arrival) AS tema FROM dec GROUP BY link_directo)
SELECT l.resp_id, l.sala_key, l.link_directo AS url, n.tema AS asunto, 'Tecnología & Pruebas Digitales' AS categoria
FROM listed l JOIN newest n ON n.link_directo = l.link_directo WHERE {_KEYWORD_TEMA.replace('tema', 'n.tema')}"""


@query("topic_scan", PAGED + ", listed AS (SELECT * FROM paged WHERE pos < 3)," + _TOPICS)
def topics(spark, sf):
    """Listings name up to three decisions each; their pages are opened and filtered by topic."""
    return _topics(spark, sf)


@query("topic_scan_by_sala", PAGED + ", listed AS (SELECT * FROM paged "
       "QUALIFY row_number() OVER (PARTITION BY sala_key ORDER BY resp_id, pos) <= 12)," + _TOPICS)
def topics_by_sala(spark, sf):
    """The same for the first links of every chamber, over all its listings."""
    return _topics(spark, sf, per_sala=12)


def _topics(spark, sf, **limits):
    dec = decisions(spark, sf)
    item = lambda r: F.concat(F.lit('<p><a href="'), r["link_directo"], F.lit('">x</a></p>'))
    listings = grouped(dec, ("link_directo",)).select(
        "resp_id", "sala_key", F.array_join(F.transform("rows", item), "").alias("html")
    ).withColumn("sala", F.col("resp_id").cast("string"))
    newest = dec.groupBy("link_directo").agg(
        *[F.max_by(c, "arrival").alias(c)
          for c in ("arrival", "sala_key", "sala", "numero_sentencia", "expediente", "fecha", "tema")]
    )
    found = topic_scan(listings, decision_pages(newest).select("url", "html"),
                       "https://historico.example.org/decisiones/", "01 de enero de 2026", **limits)
    asunto = F.regexp_extract("texto_completo", "Asunto & (.*)$", 1)
    return found.select(
        F.col("sala").cast("bigint").alias("resp_id"), "sala_key", "url", asunto.alias("asunto"), "categoria"
    )


# --- unions and fallbacks ------------------------------------------------------------------

_BY_ANCHOR = f"""
SELECT {_ARRIVAL}, sala_key, sala, numero_sentencia, replace(expediente, '-', '/') AS expediente,
  {_LINK_DATE} || ' ' || {_LINK_YEAR} AS fecha, CAST({_LINK_YEAR} AS INT) AS ano, tema, 'Derecho' AS materia,
  tema AS asunto, tema AS extracto, '' AS ponente, link_directo FROM paged"""
_BY_ROW = f"""
SELECT {_ARRIVAL}, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, 'Derecho' AS materia,
  'ver' AS asunto, 'ver' AS extracto, '' AS ponente, link_directo FROM paged"""


@query("union_captures", PAGED + _BY_ROW + " UNION ALL " + _BY_ANCHOR)
def captures(spark, sf):
    dec = decisions(spark, sf)
    rows = html_decisions(row_responses(dec), HOSTS, HOSTS)
    anchors = html_decisions(anchor_responses(dec), HOSTS, HOSTS)
    return union_captures([rows, anchors]).drop("patron")


@query("fallback_dom", PAGED + f"""
SELECT {_CANONICAL} FROM ({_BY_ROW} WHERE ano % 2 = 0)
UNION ALL SELECT resp_id * 4294967296 + 2 * (pos + 1) + 1 AS arrival, sala_key, sala, numero_sentencia,
  replace(expediente, '-', '/') AS expediente, {_LINK_DATE} || ' de ' || {_LINK_YEAR} AS fecha,
  CAST({_LINK_YEAR} AS INT) AS ano, 'Sala:' || tema || fecha AS tema, 'Derecho' AS materia,
  'Sala:' || tema || fecha AS asunto, 'Sala:' || tema || fecha AS extracto, '' AS ponente, link_directo
FROM paged WHERE ano % 2 = 1""")
def fallback_dom(spark, sf):
    """The responses of odd years hold nothing; the rendered pages of all years answer for them."""
    dec = decisions(spark, sf)
    empty = F.when(F.col("ano") % 2 == 0, F.col("body")).otherwise('{"coleccion": {}}')
    responses = row_responses(dec).withColumn("body", empty)
    return captured_decisions(responses, anchor_responses(dec), row_hosts=HOSTS, anchor_hosts=HOSTS)
