"""Queries of the column expressions and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.catalog.fixture import DEC, STORE, decisions, store, table
from jurisindex.catalog.registry import query
from jurisindex.functions import predicates as P
from jurisindex.functions import text as T
from jurisindex.functions.constants import MES_CHOICES, SALA_CHOICES, TECH_KEYWORDS
from jurisindex.operators import search
from jurisindex.operators.export import export_matrix, summary_catalog
from jurisindex.operators.upsert import write_defaults
from jurisindex.sources.dimensions import choice_row, resolve_sala, store_name

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SEARCHED = "link_directo, tema, materia, asunto, extracto, expediente, numero_sentencia, fecha, sala, ano"


def _fold(c: str) -> str:
    return f"trim(strip_accents(lower(coalesce({c}, ''))))"


def _any(fields, test: str) -> str:
    return "(" + " OR ".join(test.format(c=c) for c in fields) + ")"


_LIKE_ASCII = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE "


# --- scalar expressions --------------------------------------------------------------------


@query("clean_text", DEC + rf"""
SELECT arrival, trim(regexp_replace('  ' || tema || chr(13) || chr(10) || chr(9) || extracto || chr(160),
       '{_WS}+', ' ', 'g')) AS limpio FROM dec""")
def clean_text(spark, sf):
    messy = F.concat(F.lit("  "), "tema", F.lit("\r\n\t"), "extracto", F.lit(" "))
    return decisions(spark, sf).select("arrival", T.clean_text(messy).alias("limpio"))


@query("normalize_text", f"SELECT doc_id, {_fold('text')} AS plegado FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold("text").alias("plegado"))


@query("slug", DEC + """
SELECT arrival,
  'Busqueda_' || trim(regexp_replace(strip_accents(tema || ' (' || ano || ')'), '[^a-zA-Z0-9]+', '_', 'g'), '_')
    AS nombre,
  CASE WHEN tema = 'FIRMA ELECTRÓNICA' THEN 'FIRMA_ELECTRONICA'
       ELSE 'firma_' || trim(regexp_replace(strip_accents(tema), '[^a-zA-Z0-9]+', '_', 'g'), '_') END AS firma,
  'Busqueda_General' AS vacio
FROM dec""")
def slug(spark, sf):
    return decisions(spark, sf).select(
        "arrival",
        T.slug(F.concat("tema", F.lit(" ("), "ano", F.lit(")"))).alias("nombre"),
        T.slug("tema", prefix="firma").alias("firma"),
        T.slug(F.regexp_replace("tema", ".", "-")).alias("vacio"),
    )


@query("resolve_sala", DEC + """
SELECT arrival, 'constitucional' AS por_nombre, sala_key AS por_clave,
  CASE split_part(link_directo, '/', 5) WHEN 'scon' THEN 'constitucional' WHEN 'spa' THEN 'politico_administrativa'
    WHEN 'scc' THEN 'casacion_civil' WHEN 'scp' THEN 'casacion_penal' WHEN 'scs' THEN 'casacion_social'
    WHEN 'se' THEN 'electoral' ELSE 'plena' END AS por_codigo
FROM dec""")
def resolve(spark, sf):
    # A full name has a space, which becomes '_' and matches no alias.
    return decisions(spark, sf).select(
        "arrival",
        resolve_sala("sala").alias("por_nombre"),
        resolve_sala(F.upper("sala_key")).alias("por_clave"),
        resolve_sala(F.concat(F.lit(" "), F.split("link_directo", "/")[4])).alias("por_codigo"),
    )


@query("lookup_choice", DEC + """
, salas(key, nombre, code) AS (SELECT * FROM (VALUES """ + ", ".join(map(str, SALA_CHOICES)) + """) AS t(a, b, c)),
meses(key, nombre) AS (SELECT * FROM (VALUES """ + ", ".join(str(m[:2]) for m in MES_CHOICES) + """) AS t(a, b))
SELECT d.arrival, coalesce(s.key, 'todas') AS sala_opcion,
  coalesce(s.nombre, 'Todas las Salas / Juzgados') AS sala_nombre,
  coalesce(m.nombre, 'Todo el Año en curso (Enero - Diciembre)') AS mes_nombre
FROM dec d LEFT JOIN salas s ON s.code = split_part(d.link_directo, '/', 5)
LEFT JOIN meses m ON m.key = CASE WHEN d.tema = 'Amparo' THEN '?' ELSE lower(split_part(d.fecha, ' de ', 2)) END""")
def lookup_choice(spark, sf):
    code = F.split("link_directo", "/")[4]
    mes = F.when(F.col("tema") == "Amparo", "?").otherwise(F.lower(F.split("fecha", " de ")[1]))
    return decisions(spark, sf).select(
        "arrival", choice_row(code, SALA_CHOICES).alias("s"), choice_row(mes, MES_CHOICES).alias("m")
    ).select(
        "arrival", F.col("s.key").alias("sala_opcion"), F.col("s.nombre").alias("sala_nombre"),
        F.col("m.nombre").alias("mes_nombre"),
    )


@query("preview", DEC + """
SELECT arrival, substr(extracto, 1, 130) || '...' AS vista,
  CASE WHEN length(tema) > 12 THEN substr(tema, 1, 12) || '...' ELSE tema END AS corta
FROM dec""")
def preview(spark, sf):
    return decisions(spark, sf).select(
        "arrival",
        T.preview("extracto", "asunto").alias("vista"),
        T.preview(F.lit(""), "tema", 12, always=False).alias("corta"),
    )


@query("document_name", DEC + r"""
SELECT arrival, replace(sala, ' ', '_') || '_Sentencia_' || numero_sentencia || '_' || expediente AS documento,
  regexp_replace(link_directo, '[\\/*?:"<>|]', '_', 'g') AS desde_enlace FROM dec""")
def document_name(spark, sf):
    return decisions(spark, sf).select(
        "arrival",
        T.document_name(F.replace("sala", F.lit(" "), F.lit("_")), F.lit("Sentencia"), "numero_sentencia",
                        "expediente").alias("documento"),
        T.document_name("link_directo").alias("desde_enlace"),
    )


@query("store_name", DEC + """
SELECT CASE WHEN tema = 'Amparo' THEN 'tsj_todas_las_salas' ELSE 'sala_' || sala_key END AS almacen,
  count(*) AS n FROM dec GROUP BY 1""")
def store_names(spark, sf):
    key = F.when(F.col("tema") == "Amparo", "otra").otherwise(F.col("sala_key"))
    return decisions(spark, sf).groupBy(store_name(key).alias("almacen")).agg(F.count("*").alias("n"))


@query("write_defaults", DEC + """
SELECT arrival, sala, CASE WHEN tema = 'Amparo' THEN 'S/N' ELSE numero_sentencia END AS numero_sentencia,
  CASE WHEN tema = 'Nulidad' THEN 'S/E' ELSE expediente END AS expediente,
  CASE WHEN tema = 'Amparo' THEN 'N/A' ELSE fecha END AS fecha, 2024 AS ano,
  CASE WHEN tema = 'Casación' THEN 'Sentencia' ELSE tema END AS tema, 'Derecho Procesal' AS materia, asunto,
  CASE WHEN tema = 'Nulidad' THEN asunto ELSE extracto END AS extracto,
  CASE WHEN tema = 'Amparo' THEN 'https://historico.tsj.gob.ve' ELSE link_directo END AS link_directo FROM dec""")
def defaults(spark, sf):
    unless = lambda tema, c: F.when(F.col("tema") != tema, F.col(c)).alias(c)
    raw = decisions(spark, sf).select(
        "arrival", "sala", unless("Amparo", "numero_sentencia"), unless("Nulidad", "expediente"),
        unless("Amparo", "fecha"), unless("Casación", "tema"), "asunto", unless("Nulidad", "extracto"),
        unless("Amparo", "link_directo"),
    )
    return write_defaults(raw)


@query("export_matrix", STORE + """
SELECT 'Sala ' || replace(replace(sala, 'Sala de ', ''), 'Sala ', '') AS sala, numero_sentencia, expediente,
  fecha, tema, materia, asunto, extracto, link_directo FROM store""")
def matrix(spark, sf):
    return export_matrix(store(spark, sf))


@query("summary_catalog", DEC + """
SELECT replace(replace(sala, 'Sala de ', ''), 'Sala ', '') AS sala, numero_sentencia, expediente, fecha,
  ponente, substr(asunto, 1, 75) AS asunto FROM dec""")
def catalog(spark, sf):
    return summary_catalog(decisions(spark, sf))


@query("decision_cards", STORE + """
SELECT sala, fecha, numero_sentencia, expediente, 'No especificado' AS ponente, tema, materia,
  CASE WHEN length(extracto) > 130 THEN substr(extracto, 1, 130) || '...' ELSE extracto END AS vista,
  link_directo FROM store""")
def cards(spark, sf):
    return search.decision_cards(store(spark, sf), cut_always=False)


@query("decision_detail", STORE + """
SELECT sala, expediente, numero_sentencia, fecha, 'No especificado' AS ponente, tema, materia, extracto,
  link_directo AS url FROM store
WHERE link_directo = 'https://historico.example.org/decisiones/se/diciembre/300047-47-10124-2026-C17-47.HTML'""")
def detail(spark, sf):
    link = "https://historico.example.org/decisiones/se/diciembre/300047-47-10124-2026-C17-47.HTML"
    return search.decision_detail(store(spark, sf), link)


def _gaps(df):
    """The store with fields missing here and there: null in one row of five, empty in another."""
    gone = lambda c, k: F.when(F.col("first_seen") % 5 == k, None).when(F.col("first_seen") % 7 == k, "").otherwise(F.col(c))
    return df.withColumns({c: gone(c, k % 5) for k, c in enumerate(_GAPPED)})


_GAPPED = ("numero_sentencia", "expediente", "fecha", "tema", "materia", "asunto", "extracto", "link_directo")
_GAPS = STORE + ", gaps AS (SELECT sala, ano, " + ", ".join(
    f"CASE WHEN first_seen % 5 = {k % 5} THEN NULL WHEN first_seen % 7 = {k % 5} THEN '' ELSE {c} END AS {c}"
    for k, c in enumerate(_GAPPED)) + " FROM store)"
_GAP_DATE = "coalesce(nullif(fecha, ''), CAST(ano AS STRING))"
_GAP_BODY = "coalesce(nullif(extracto, ''), nullif(asunto, ''), '')"


@query("export_matrix_gaps", _GAPS + """
SELECT 'Sala ' || replace(replace(sala, 'Sala de ', ''), 'Sala ', '') AS sala,
  coalesce(numero_sentencia, 'S/N') AS numero_sentencia, coalesce(expediente, 'S/E') AS expediente,
  coalesce(fecha, 'N/A') AS fecha, coalesce(tema, 'Sentencia') AS tema, coalesce(materia, 'Derecho Procesal') AS materia,
  coalesce(asunto, '') AS asunto, coalesce(extracto, asunto, '') AS extracto,
  coalesce(link_directo, 'https://historico.tsj.gob.ve') AS link_directo FROM gaps""")
def matrix_gaps(spark, sf):
    return export_matrix(_gaps(store(spark, sf)))


@query("decision_cards_gaps", _GAPS + f"""
SELECT sala, {_GAP_DATE} AS fecha, numero_sentencia, expediente, 'No especificado' AS ponente,
  coalesce(nullif(tema, ''), 'Jurisprudencia') AS tema, coalesce(nullif(materia, ''), 'Derecho Procesal') AS materia,
  substr({_GAP_BODY}, 1, 130) || '...' AS vista, link_directo FROM gaps""")
def cards_gaps(spark, sf):
    return search.decision_cards(_gaps(store(spark, sf)))


@query("decision_detail_gaps", _GAPS + f"""
SELECT sala, expediente, numero_sentencia, coalesce({_GAP_DATE}, '') AS fecha, 'No especificado' AS ponente,
  coalesce(nullif(tema, ''), 'General') AS tema, coalesce(nullif(materia, ''), 'General') AS materia,
  {_GAP_BODY} AS extracto, coalesce(nullif(link_directo, ''), '#') AS url FROM gaps""")
def detail_gaps(spark, sf):
    return search.detail_view(_gaps(store(spark, sf)))


@query("decision_at", STORE + """
SELECT sala, expediente, numero_sentencia, fecha, 'No especificado' AS ponente, tema, materia, extracto,
  link_directo AS url FROM store ORDER BY ano DESC, first_seen DESC LIMIT 1 OFFSET 5""")
def detail_at(spark, sf):
    return search.decision_at(search.newest_first(store(spark, sf)), 5)


# --- filters -------------------------------------------------------------------------------


@query("tech_filter", DEC + """
SELECT arrival, link_directo, tema, 'Tecnología & Pruebas Digitales' AS categoria FROM dec
WHERE """ + " OR ".join(f"contains(lower(tema || ' ' || extracto), '{k}')" for k in TECH_KEYWORDS))
def tech(spark, sf):
    dec = decisions(spark, sf).withColumn("texto_completo", F.concat_ws(" ", "tema", "extracto"))
    return search.tech_filter(dec).select("arrival", "link_directo", "tema", "categoria")


@query("filter_month", DEC + "SELECT arrival, fecha FROM dec WHERE contains(lower(fecha), 'marzo')")
def month(spark, sf):
    return P.keep(decisions(spark, sf), P.month_plain("marzo")).select("arrival", "fecha")


@query("filter_month_folded", DEC + f"SELECT arrival, fecha FROM dec WHERE contains({_fold('fecha')}, 'julio')")
def month_folded(spark, sf):
    return P.keep(decisions(spark, sf), P.month_folded("julio")).select("arrival", "fecha")


@query("search4", STORE + f"""
SELECT {_SEARCHED} FROM store WHERE {_any(P.FIELDS4, "contains(lower({c}), 'electrónica')")}""")
def search4(spark, sf):
    return search.search4(store(spark, sf), "Electrónica").select(*_SEARCHED.split(", "))


@query("search6", STORE + f"""
SELECT {_SEARCHED} FROM store WHERE {_any(P.FIELDS6, "contains(lower({c}), 'derecho nation_7')")}""")
def search6(spark, sf):
    return search.search6(store(spark, sf), "Derecho NATION_7").select(*_SEARCHED.split(", "))


@query("search6_folded", STORE + f"""
SELECT {_SEARCHED} FROM store WHERE
{" OR ".join(f"contains({_fold(c)}, 'informatico')" for c in P.FIELDS6)}""")
def search6_folded(spark, sf):
    return search.search6_folded(store(spark, sf), " Informático ").select(*_SEARCHED.split(", "))


@query("search6_folded_prepared", STORE + f"""
SELECT {_SEARCHED} FROM store WHERE
{" OR ".join(f"contains({_fold(c)}, 'casacion')" for c in P.FIELDS6)}""")
def search6_prepared(spark, sf):
    prepared = store(spark, sf).withColumn(P.FOLDED_COLUMN, P.folded_fields())
    return search.search6_folded(prepared, "CASACIÓN").select(*_SEARCHED.split(", "))


@query("store_search", STORE + f"""
SELECT {_SEARCHED}, first_seen FROM store WHERE ano = 1996
AND {_LIKE_ASCII.format(c='sala')} '%penal%'
AND ({" OR ".join(_LIKE_ASCII.format(c=c) + "'%d_recho%n_1%'" for c in P.FIELDS6)})""")
def store_search(spark, sf):
    return search.store_search(store(spark, sf), " D_recho%N_1 ", "Penal", 1996).select(*_SEARCHED.split(", "), "first_seen")


@query("filter_sala_alias", DEC + f"""
SELECT arrival, sala FROM dec WHERE contains({_fold('sala')}, 'penal') OR contains({_fold('sala')}, 'scp')
OR contains({_fold('sala')}, 'casacion_penal')""")
def sala_alias(spark, sf):
    return P.keep(decisions(spark, sf), P.sala_by_alias("casacion_penal")).select("arrival", "sala")


@query("filter_sala_plain", DEC + """
SELECT arrival, sala FROM dec WHERE contains(lower(sala), 'sala político-administrativa')""")
def sala_plain(spark, sf):
    return P.keep(decisions(spark, sf), P.sala_plain("spa")).select("arrival", "sala")


_FACETS = STORE + f"""
SELECT {_SEARCHED} FROM store WHERE contains(lower(sala), 'sala de casación civil')
AND contains(lower(fecha), 'agosto') AND {_any(P.FIELDS6, "contains(lower({c}), 'nation_1')")}"""


@query("faceted_search", _FACETS)
def faceted(spark, sf):
    found = search.faceted_search(store(spark, sf), "scc", "agosto", "nation_1")
    return found.select(*_SEARCHED.split(", "))


@query("faceted_count", f"SELECT count(*) AS total FROM ({_FACETS})")
def faceted_count(spark, sf):
    return search.faceted_count(store(spark, sf), sala="casacion_civil", mes="agosto", q="NATION_1")


_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio")
_FOLDED_FACETS = f"""
WHERE (contains({_fold('sala')}, 'penal') OR contains({_fold('sala')}, 'scp'))
AND ({" OR ".join(f"contains({_fold(c)}, '{{q}}')" for c in P.FIELDS6)})"""


@query("faceted_search_folded", DEC + f"""
SELECT {_SEARCHED} FROM dec {_FOLDED_FACETS.format(q='cion')} AND ({" OR ".join(f"contains(lower(fecha), '{m}')" for m in _MONTHS)})""")
def faceted_folded(spark, sf):
    """The keyword is found in letters with and without marks, in each of half a year's months."""
    dec = decisions(spark, sf)
    parts = [search.faceted_search(dec, "casacion_penal", mes, "CIÓN", folded=True) for mes in _MONTHS]
    return reduce(DataFrame.unionByName, parts).select(*_SEARCHED.split(", "))


@query("flagship", STORE + f"""
SELECT 'Sala ' || replace(replace(sala, 'Sala de ', ''), 'Sala ', '') AS sala, numero_sentencia, expediente,
  fecha, tema, materia, asunto, extracto, link_directo FROM store {_FOLDED_FACETS.format(q='ea')}""")
def flagship(spark, sf):
    """Upsert, folded faceted search, and the decision matrix of what it finds."""
    found = search.faceted_search(store(spark, sf), "casacion_penal", q="ÉA", folded=True)
    return export_matrix(found)


@query("decision_far_down", STORE + f"""
SELECT {_SEARCHED}, first_seen FROM store ORDER BY ano DESC, first_seen DESC LIMIT 1 OFFSET (SELECT count(*) * 9 // 10 FROM store)""")
def decision_far_down(spark, sf):
    """The row nine tenths down the newest ones; only its range is sorted, and only its texts are read."""
    current = store(spark, sf, late=False)
    return search.newest_at(current, current.count() * 9 // 10, key="link_directo").select(*_SEARCHED.split(", "), "first_seen")


@query("refine", STORE + f"""
SELECT {_SEARCHED} FROM store WHERE {_any(P.FIELDS6, "contains(lower({c}), 'digital')")}
AND {_any(P.FIELDS6, "contains(lower({c}), 'nation_7')")}""")
def refine(spark, sf):
    first = search.faceted_search(store(spark, sf), q="digital")
    return search.refine(first, " NATION_7 ").select(*_SEARCHED.split(", "))
