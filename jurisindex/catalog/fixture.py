"""Court decisions derived from the given tables, and payloads that carry them.

`dec` has one row per order: a version of the decision its customer stands for.  Its SQL is the
same text for Spark and for the oracles.  Payloads are grouped into pages by ranges of the arrival
number, so that no group is larger than its page, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisindex.functions.packing import common_words, pack, unpack
from jurisindex.operators.upsert import upsert

HOST = "historico.example.org"
HOSTS = (HOST,)
SITE_ROOT = "https://" + HOST
PAGE_SIZE = 500

_DIMENSIONS = """
sala(i, sala_key, code, sala) AS (
  SELECT * FROM (VALUES
   (0,'constitucional','scon','Sala Constitucional'),
   (1,'politico_administrativa','spa','Sala Político-Administrativa'),
   (2,'casacion_civil','scc','Sala de Casación Civil'),
   (3,'casacion_penal','scp','Sala de Casación Penal'),
   (4,'casacion_social','scs','Sala de Casación Social'),
   (5,'electoral','se','Sala Electoral'),
   (6,'plena','plena','Sala Plena')) AS t(i, sala_key, code, sala)),
mes(m, mes) AS (
  SELECT * FROM (VALUES (1,'Enero'),(2,'Febrero'),(3,'Marzo'),(4,'Abril'),(5,'Mayo'),(6,'Junio'),
   (7,'Julio'),(8,'Agosto'),(9,'Septiembre'),(10,'Octubre'),(11,'Noviembre'),(12,'Diciembre')) AS t(m, mes)),
tema(k, tema) AS (
  SELECT * FROM (VALUES (0,'Evidencia Digital'),(1,'Delitos Informáticos'),(2,'Peritaje Informático'),
   (3,'FIRMA ELECTRÓNICA'),(4,'Cadena de custodia digital'),(5,'Jurisprudencia'),(6,'Amparo'),
   (7,'Casación'),(8,'Nulidad'),(9,'Competencia')) AS t(k, tema)),
base AS (
  SELECT o.o_orderkey AS arrival, o.o_custkey AS ck, o.o_orderdate AS od,
         CAST(o.o_custkey % 7 AS INT) AS si, CAST(o.o_custkey % 12 AS INT) + 1 AS um,
         CAST(o.o_orderkey % 10 AS INT) AS tk,
         o.o_orderkey % (SELECT count(*) FROM {documents}) AS did
  FROM {orders} o)"""

_DECISIONS = """
SELECT b.arrival, s.sala_key, s.sala,
  CAST(b.ck AS STRING) AS numero_sentencia,
  'C' || CAST(b.ck % 30 AS STRING) || '-' || CAST(b.ck AS STRING) AS expediente,
  CAST(day(b.od) AS STRING) || ' de ' || m.mes || ' de ' || CAST(year(b.od) AS STRING) AS fecha,
  CAST(year(b.od) AS INT) AS ano,
  t.tema, 'Derecho ' || n.n_name AS materia,
  substr(d.text, 1, 200) AS asunto, d.text AS extracto, c.c_name AS ponente,
  'https://historico.example.org/decisiones/' || s.code || '/' || lower(u.mes) || '/'
   || CAST(300000 + b.ck AS STRING) || '-' || CAST(b.ck AS STRING) || '-10124-'
   || CAST(2019 + b.ck % 8 AS STRING) || '-C' || CAST(b.ck % 30 AS STRING) || '-'
   || CAST(b.ck AS STRING) || '.HTML' AS link_directo
FROM base b
JOIN sala s ON s.i = b.si
JOIN mes m ON m.m = month(b.od)
JOIN mes u ON u.m = b.um
JOIN tema t ON t.k = b.tk
JOIN {customer} c ON c.c_custkey = b.ck
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {documents} d ON d.doc_id = b.did"""

# The same rows before they are joined with their document: its number, `did`, stands for the two texts.
_TEXTS = "substr(d.text, 1, 200) AS asunto, d.text AS extracto"
_REFERRING = _DECISIONS.replace(_TEXTS, "b.did").replace("\nJOIN {documents} d ON d.doc_id = b.did", "")

_TABLES = ("orders", "documents", "customer", "nation")
_NAMES = {t: t for t in _TABLES}

# Prefixes of oracles: the decisions, and the store they make.
DEC = "WITH " + _DIMENSIONS.format(**_NAMES) + ", dec AS (" + _DECISIONS.format(**_NAMES) + ")"
_LAST = ", ".join(
    f"arg_max({c}, arrival) AS {c}"
    for c in ("sala_key", "sala", "numero_sentencia", "expediente", "fecha", "ano", "tema", "materia",
              "asunto", "extracto")
)
STORE = (
    DEC + f", store AS (SELECT link_directo, {_LAST}, min(arrival) AS first_seen, "
    "max(arrival) AS last_seen FROM dec GROUP BY link_directo)"
)
# Decisions placed in the payload pages of `grouped`.
PAGED = (
    DEC + f""", paged AS (
  SELECT *, min(arrival) OVER w AS resp_id,
         CAST(row_number() OVER (w ORDER BY arrival) - 1 AS BIGINT) AS pos
  FROM dec WINDOW w AS (PARTITION BY sala_key, ano, arrival // {PAGE_SIZE}))"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders of a task where their whole texts are worked on: about 50 MB of texts.
TASK_ROWS = 20_000


def decisions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """`dec`: many versions per link.

    `dealt` spreads the orders, without their texts, for work on each row's whole text: a file of a few MB of orders is
    one task otherwise, and stays one where the texts are broadcast to it.
    """
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    if not dealt:
        return spark.sql("WITH " + _DIMENSIONS.format(**files) + _DECISIONS.format(**files))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    tasks = max(1, -(-orders.count() // TASK_ROWS))
    named = files | {"orders": "{orders}"}
    return spark.sql("WITH " + _DIMENSIONS.format(**named) + _DECISIONS.format(**named), orders=orders.repartition(tasks, "o_orderkey"))


def referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dec` with the numbers of its documents, for work that comes before its texts; see `with_texts`."""
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    return spark.sql("WITH " + _DIMENSIONS.format(**files) + _REFERRING.format(**files))


def with_texts(dec: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of `referring` with the texts of their documents; rows without a document are left out, as in `dec`."""
    texts = documents.select(F.col("doc_id").alias("did"), F.substring("text", 1, 200).alias("asunto"), F.col("text").alias("extracto"))
    return dec.join(texts, "did").drop("did")


def store(spark: SparkSession, sf_dir: str, late: bool = True) -> DataFrame:
    """`dec` after upsert: one row per link; not `late` for counts, which read no texts."""
    return upsert(None, decisions(spark, sf_dir).drop("ponente"), late=late)


# --- payloads ------------------------------------------------------------------------------

PORTAL_URL = "https://portal.example.org/web?p_p_lifecycle=2&sala="
_RAW_NAMES = {
    "SLINKDIRECTO": "link_directo", "SNUMEROSENTENCIA": "numero_sentencia",
    "SNUMEROEXPEDIENTE": "expediente", "SFECHA": "fecha", "STEMA": "tema", "SMATERIA": "materia",
    "SASUNTO": "asunto", "SEXTRACTO": "extracto", "SPONENTE": "ponente",
}


def _raw_item(row: Column) -> Column:
    return F.struct(*[row[c].alias(raw) for raw, c in _RAW_NAMES.items()])


def _plain_item(row: Column) -> Column:
    return F.struct(*[row[c].alias(c) for c in _RAW_NAMES.values()])


def json_body(rows: Column, sala_key: Column) -> Column:
    """A JSON response with the rows; chambers differ in envelope and in spelling."""
    raw = F.transform(rows, _raw_item)
    plain = F.transform(rows, _plain_item)
    noted = F.struct(F.lit("ok").alias("nota"), F.lit(1).alias("n"), raw.alias("J"))
    return (
        F.when(sala_key == "constitucional", F.to_json(F.struct(F.struct(raw.alias("J")).alias("coleccion"))))
        .when(sala_key == "politico_administrativa", F.to_json(F.struct(raw.alias("JURISPRUDENCIA"))))
        .when(sala_key == "casacion_civil", F.to_json(F.struct(plain.alias("decisiones"))))
        .when(sala_key == "casacion_penal", F.to_json(raw))
        .when(sala_key == "casacion_social", F.to_json(F.struct(noted.alias("data"))))
        .when(sala_key == "electoral", F.to_json(F.struct(F.lit("x").alias("otro"), plain.alias("items"))))
        .otherwise(F.to_json(plain))
    )


def rows_body(rows: Column) -> Column:
    """An HTML response: one table row per decision."""
    row = lambda r: F.concat(
        F.lit("<tr><td>"), r["numero_sentencia"], F.lit("</td><td> "), r["expediente"],
        F.lit("</td><td>"), r["fecha"], F.lit(" </td><td><b>"), r["tema"],
        F.lit("</b></td><td><a class='ver' href=\""), r["link_directo"], F.lit("\">ver</a></td></tr>"),
    )
    return F.concat(
        F.lit("<table><!-- <tr><td>x</td></tr> --><tr><th>Nro</th></tr>"),
        F.array_join(F.transform(rows, row), "\n"), F.lit("</table>"),
    )


def anchors_body(rows: Column) -> Column:
    """An HTML response: one list item with an anchor per decision."""
    item = lambda r: F.concat(
        F.lit("<li>Sala: <a href='"), r["link_directo"], F.lit("'> "), r["tema"],
        F.lit(" </a><span> "), r["fecha"], F.lit("</span>"),
    )
    return F.concat(
        F.lit("<ul><li><a href='/inicio.html'>Inicio</a>"),
        F.array_join(F.transform(rows, item), "\n"), F.lit("</ul>"),
    )


# What the short HTML payloads show; Spark drops no fields from rows that it has gathered.
_SHOWN = ("numero_sentencia", "expediente", "fecha", "tema", "link_directo")


def grouped(dec: DataFrame, fields: tuple[str, ...] = tuple(_RAW_NAMES.values())) -> DataFrame:
    """One row per payload page: `resp_id`, `sala_key`, `ano` and the fields of its decisions, `rows` by arrival."""
    page = F.expr(f"arrival div {PAGE_SIZE}").alias("page")
    kept = ["arrival", *fields]
    return (
        dec.groupBy("sala_key", "ano", page)
        .agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("rows"))
        .select(F.col("rows")[0]["arrival"].alias("resp_id"), "sala_key", "ano", "rows")
    )


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of `grouped` with all fields, for payloads that carry whole texts.

    A text belongs to many decisions and has to reach the page of each.  It is packed once, in its document, and
    unpacked in the pages, so the one shuffle of rows moves packed bytes; rows are gathered after it, none before.
    """
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = common_words(documents, "text")
    sql = "WITH " + _DIMENSIONS.format(**files) + _DECISIONS.format(**files | {"documents": "{packed}"})
    dec = spark.sql(sql, packed=documents.withColumn("text", pack(F.col("text"), words))).withColumnRenamed("extracto", "texto")
    carried = [c for c in _RAW_NAMES.values() if c not in ("asunto", "extracto")]
    pages = (
        dec.select("sala_key", "ano", F.expr(f"arrival div {PAGE_SIZE}").alias("page"), "arrival", *carried, "texto")
        .repartition("sala_key", "ano", "page").groupBy("sala_key", "ano", "page")
        .agg(F.collect_list(F.struct("arrival", *carried, "texto")).alias("carried"))
        .withColumn("texts", unpack(F.col("carried")["texto"], words))
    )

    def row(r: Column, i: Column) -> Column:
        text = F.get("texts", i)
        fields = {"asunto": F.substring(text, 1, 200), "extracto": text}
        return F.struct(*[fields.get(c, r[c]).alias(c) for c in ("arrival", *_RAW_NAMES.values())])

    rows = F.sort_array(F.transform("carried", row))
    return pages.select("sala_key", "ano", rows.alias("rows")).select(F.col("rows")[0]["arrival"].alias("resp_id"), "sala_key", "ano", "rows")


def responses(pages: DataFrame, body: Column, *kept: str) -> DataFrame:
    return pages.select(
        "resp_id", "sala_key", "ano",
        F.concat(F.lit(PORTAL_URL), "sala_key").alias("url"),
        F.lit(200).alias("status"),
        body.alias("body"),
        *kept,
    )


def json_responses(dec: DataFrame) -> DataFrame:
    return json_pages(grouped(dec))


def json_pages(pages: DataFrame) -> DataFrame:
    return responses(pages, json_body(F.col("rows"), F.col("sala_key")))


def row_responses(dec: DataFrame) -> DataFrame:
    return responses(grouped(dec, _SHOWN), rows_body(F.col("rows")))


def anchor_responses(dec: DataFrame) -> DataFrame:
    return responses(grouped(dec, _SHOWN), anchors_body(F.col("rows")))


def single_responses(dec: DataFrame, *kept: str) -> DataFrame:
    """One response per decision, as JSON, for the electoral chamber as a table row; `kept` columns stay beside it."""
    rows = dec.select(
        F.col("arrival").alias("resp_id"), "sala_key", "ano",
        F.array(F.struct(*_RAW_NAMES.values())).alias("rows"), *kept,
    )
    body = F.when(F.col("sala_key") == "electoral", rows_body(F.col("rows"))).otherwise(
        json_body(F.col("rows"), F.col("sala_key"))
    )
    return responses(rows, body, *kept)


def decision_pages(dec: DataFrame) -> DataFrame:
    """One decision page per row."""
    html = F.concat(
        F.lit("<html><head><title>Decisi&oacute;n</title><script>var x = '<p>no</p>';</script></head><body>"),
        F.lit("<h1>TRIBUNAL</h1><p>Sentencia Nº "), "numero_sentencia",
        F.lit("</p><p>Expediente: "), "expediente",
        F.lit("</p><p>Magistrado Ponente: Juez&nbsp;Principal</p><p>Fecha: "), "fecha",
        F.lit("</p><p>Asunto &amp; "), "tema", F.lit("</p></body></html>"),
    )
    return dec.select("arrival", "sala_key", "sala", F.col("link_directo").alias("url"), html.alias("html"))
