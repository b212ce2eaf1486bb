"""Queries of upserts, exports and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisindex.catalog.fixture import DEC, STORE, decisions, single_responses, store
from jurisindex.catalog.fixture import HOSTS
from jurisindex.catalog.registry import query
from jurisindex.functions.constants import MATRIX_HEADERS, TECH_KEYWORDS
from jurisindex.operators.export import (
    FORMATS, catalog_total, export, export_matrix, made_once, summary_catalog, write_csv, write_json, write_matrix,
)
from jurisindex.operators.search import tech_filter
from jurisindex.operators.stats import stats_all
from jurisindex.operators.health import stores_with_errors
from jurisindex.operators.saved_store import committed, compact, merged_by_link, read_store, run_counts, save_batch
from jurisindex.operators.upsert import save_counts, split_rejects, upsert, write_defaults
from jurisindex.plans.sync import captured_decisions, save_checked, sync_batch
from jurisindex.sources.captures import stream_responses
from jurisindex.sources.storage import new_folder
from jurisindex.streaming.counts import follow_store, followed_counts
from jurisindex.streaming.stream import stream_counts, sync_stream

_COLUMNS = ("link_directo, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, materia, asunto, extracto, "
            "first_seen, last_seen")


@query("upsert", STORE + f"SELECT {_COLUMNS} FROM store")
def upsert_all(spark, sf):
    return store(spark, sf).select(*_COLUMNS.split(", "))


@query("upsert_batches", STORE + f"SELECT {_COLUMNS} FROM store")
def upsert_batches(spark, sf):
    """Two batches by topic, the later-arrived rows spread over both."""
    dec = decisions(spark, sf).drop("ponente")
    digital = F.lower("tema").contains("digital")
    first = upsert(None, dec.where(digital), late=True)
    return upsert(first, dec.where(~digital), late=True).select(*_COLUMNS.split(", "))


def _flawed(spark, sf):
    """Decisions of which some have no chamber, no number as year, or no link."""
    return decisions(spark, sf).withColumns({
        "sala": F.when(F.col("tema") != "Nulidad", F.col("sala")),
        "ano": F.when(F.col("tema") == "Competencia", F.lit("x")).otherwise(F.concat(F.lit(" "), "ano")),
        "link_directo": F.when(F.col("tema") != "Amparo", F.col("link_directo")),
    }).drop("ponente")


@query("save_rejects", DEC + "SELECT arrival, tema FROM dec WHERE tema IN ('Nulidad', 'Competencia')")
def save_rejects(spark, sf):
    return split_rejects(write_defaults(_flawed(spark, sf)))[1].select("arrival", "tema")


@query("save_rejects_linkless", DEC + """
SELECT arrival, tema FROM dec WHERE tema IN ('Nulidad', 'Competencia', 'Amparo')""")
def save_rejects_linkless(spark, sf):
    written = write_defaults(_flawed(spark, sf), on_missing_link="reject")
    return split_rejects(written)[1].select("arrival", "tema")


@query("save_counts", DEC + """
SELECT count(*) FILTER (tema NOT IN ('Nulidad', 'Competencia')) AS aceptadas,
  count(*) FILTER (tema IN ('Nulidad', 'Competencia')) AS rechazadas FROM dec""")
def counts_of_save(spark, sf):
    return save_counts(write_defaults(_flawed(spark, sf)))


@query("upsert_linkless", DEC + """
, written AS (SELECT * REPLACE (CASE WHEN tema = 'Amparo' THEN 'https://historico.tsj.gob.ve' ELSE link_directo END
  AS link_directo) FROM dec WHERE tema NOT IN ('Nulidad', 'Competencia'))
SELECT link_directo, arg_max(numero_sentencia, arrival) AS numero_sentencia, arg_max(fecha, arrival) AS fecha,
  arg_max(ano, arrival) AS ano, min(arrival) AS first_seen, max(arrival) AS last_seen
FROM written GROUP BY link_directo""")
def upsert_linkless(spark, sf):
    """All rows without a link share the site's root address and collapse into one."""
    accepted, _ = split_rejects(write_defaults(_flawed(spark, sf)))
    return upsert(None, accepted).select(
        "link_directo", "numero_sentencia", "fecha", "ano", "first_seen", "last_seen"
    )


@query("saved_store", DEC + f"""
, stamped AS (SELECT * REPLACE (arrival + CASE WHEN tema = 'Nulidad' THEN 1000000000 ELSE 0 END AS arrival) FROM dec
  WHERE NOT (tema = 'Competencia' AND sala_key = 'plena'))
SELECT link_directo, sala_key, {", ".join(f"arg_max({c}, arrival) AS {c}" for c in (
    "sala", "numero_sentencia", "expediente", "fecha", "ano", "tema", "materia", "asunto", "extracto"))},
  min(arrival) AS first_seen, max(arrival) AS last_seen FROM stamped GROUP BY link_directo, sala_key""")
def saved_store(spark, sf):
    """Three saves in another order than the rows arrived, one again, rows without a chamber, a compaction and a save."""
    path = new_folder(spark, "saved-store")
    late = F.when(F.col("tema") == "Nulidad", F.col("arrival") + 1_000_000_000).otherwise(F.col("arrival"))
    chamber = F.when((F.col("tema") != "Competencia") | (F.col("sala_key") != "plena"), F.col("sala_key"))
    dec = decisions(spark, sf).withColumns({"arrival": late, "sala_key": chamber})
    accepted, _ = split_rejects(write_defaults(dec))
    parts = [accepted.where(F.pmod(F.hash("arrival"), F.lit(3)) == k) for k in (2, 0, 1)]
    for part in (parts[0], parts[1], parts[0]):
        save_batch(part, path, "2026-01-01 00:00:00", late=True)
    compact(spark, path)
    save_batch(parts[2], path, "2026-01-02 00:00:00", late=True)
    return read_store(spark, path).select(*_COLUMNS.split(", "))


@query("merged_batches", STORE + f"SELECT {_COLUMNS} FROM store")
def merged_batches(spark, sf):
    """Five batches in buckets of the link, two of them compacted, merged to one row a link without a shuffle."""
    path = new_folder(spark, "merged-batches")
    accepted, _ = split_rejects(write_defaults(decisions(spark, sf).drop("ponente")))
    for k in (4, 2, 0, 1, 3):
        save_batch(accepted.where(F.pmod(F.hash("arrival"), F.lit(5)) == k), path, "2026-01-01 00:00:00", buckets=8, late=True)
        if k == 2:
            compact(spark, path, files_per_chamber=8)
    return merged_by_link(read_store(spark, path)).select(*_COLUMNS.split(", "))


def broken_store(spark, sf):
    """The path of a saved store of two batches; one chamber has a file that is cut off, one a year that is text."""
    path = new_folder(spark, "broken-store")
    accepted, _ = split_rejects(write_defaults(decisions(spark, sf)))
    for part in (0, 1):
        save_batch(accepted.where(F.pmod(F.hash("arrival"), F.lit(2)) == part), path, "2026-01-01 00:00:00", late=True)
    lote = f"{path}/data/lote={committed(spark, path)[0][0]}"
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{lote}/sala_key=plena")
    start = whole.select(F.substring("content", 1, 1000).alias("start")).first().start
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{lote}/sala_key=plena/part-cut.parquet")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(start)
    out.close()
    electoral = spark.read.parquet(f"{lote}/sala_key=electoral")
    electoral.withColumn("ano", F.col("ano").cast("string")).write.mode("append").parquet(f"{lote}/sala_key=electoral")
    return path


@query("stores_with_errors", DEC + """
, stores AS (SELECT 'sala_' || sala_key AS almacen, count(DISTINCT link_directo) AS n FROM dec GROUP BY sala_key)
SELECT almacen, CASE WHEN almacen IN ('sala_plena', 'sala_electoral') THEN 0 ELSE n END AS total_registros,
  CASE almacen WHEN 'sala_plena' THEN 'ilegible' WHEN 'sala_electoral' THEN 'ano es string' END AS error FROM stores""")
def errors_of_stores(spark, sf):
    """Counts of the chambers' stores; a broken store gives a row with its error, the others are counted."""
    return stores_with_errors(spark, broken_store(spark, sf))


# --- exports -------------------------------------------------------------------------------

_PLAIN = "arrival, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema, materia, asunto, extracto, ponente"
_READ = ("arrival bigint, sala_key string, sala string, numero_sentencia string, expediente string, fecha string, "
         "ano int, tema string, materia string, asunto string, extracto string, ponente string")


@query("export_json", DEC + f"SELECT {_PLAIN} FROM dec")
def export_json(spark, sf):
    path = new_folder(spark, "export-json")
    write_json(decisions(spark, sf).select(*_PLAIN.split(", ")), path, "gzip")
    return spark.read.schema(_READ).json(path)


@query("export_csv", DEC + f"SELECT {_PLAIN} FROM dec")
def export_csv(spark, sf):
    path = new_folder(spark, "export-csv")
    write_csv(decisions(spark, sf).select(*_PLAIN.split(", ")), path, "gzip")
    return spark.read.schema(_READ).csv(path, header=True, escape='"', multiLine=True)


_MATRIX = """SELECT 'Sala ' || replace(replace(sala, 'Sala de ', ''), 'Sala ', '') AS sala, numero_sentencia,
  expediente, fecha, tema, materia, asunto, extracto, link_directo FROM """


@query("export_matrix_file", STORE + _MATRIX + "store")
def export_matrix_file(spark, sf):
    path = new_folder(spark, "export-matrix")
    write_matrix(store(spark, sf), path, "gzip")
    schema = ", ".join(f"`{header}` string" for header in MATRIX_HEADERS.values())
    read = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    return read.withColumnsRenamed({header: name for name, header in MATRIX_HEADERS.items()})


@query("tech_report", DEC + _MATRIX + "dec WHERE " + " OR ".join(
    f"contains(lower(tema || ' ' || extracto), '{k}')" for k in TECH_KEYWORDS))
def tech_report(spark, sf):
    """The matrix of all decisions on digital evidence."""
    dec = decisions(spark, sf).withColumn("texto_completo", F.concat_ws(" ", "tema", "extracto"))
    return export_matrix(tech_filter(dec))


_REPORT = DEC + ", hits AS (SELECT * FROM dec WHERE " + " OR ".join(
    f"contains(lower(tema || ' ' || extracto), '{k}')" for k in TECH_KEYWORDS) + ")"
_SHORT = "replace(replace(sala, 'Sala de ', ''), 'Sala ', '')"


def _report(spark, sf):
    dec = decisions(spark, sf, dealt=True).withColumn("texto_completo", F.concat_ws(" ", "tema", "extracto"))
    return tech_filter(dec).drop("texto_completo", "arrival")


def _read_export(spark, formato, path):
    if formato == "json":
        return spark.read.schema(_READ).json(path)
    read = spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False)
    return read.withColumnsRenamed({header: name for name, header in MATRIX_HEADERS.items()}) if formato == "matriz" else read


@query("tech_report_formats", _REPORT + f"""
SELECT 'json' AS formato, sala, numero_sentencia, expediente, fecha, asunto FROM hits
UNION ALL SELECT 'csv', sala, numero_sentencia, expediente, fecha, asunto FROM hits
UNION ALL SELECT 'matriz', 'Sala ' || {_SHORT}, numero_sentencia, expediente, fecha, asunto FROM hits
UNION ALL SELECT 'catalogo', {_SHORT}, numero_sentencia, expediente, fecha, substr(asunto, 1, 75) FROM hits""")
def tech_report_formats(spark, sf):
    """The consolidated report on digital evidence in all its formats, as they are read again."""
    found = made_once(_report(spark, sf), new_folder(spark, "report-rows"))
    written = export(found, new_folder(spark, "report"), "all", "gzip")
    columns = ["sala", "numero_sentencia", "expediente", "fecha", "asunto"]
    parts = [_read_export(spark, formato, path).select(F.lit(formato).alias("formato"), *columns) for formato, path in written.items()]
    return reduce(DataFrame.unionByName, parts)


@query("catalog_total", _REPORT + "SELECT count(*) AS total FROM hits")
def total_of_catalog(spark, sf):
    return catalog_total(summary_catalog(_report(spark, sf)))


@query("export_formats", _REPORT + """
, asked(formato, escrito) AS (VALUES ('json', 'json'), ('excel', 'matriz'), ('xlsx', 'matriz'), ('csv', 'csv'), ('pdf', 'catalogo'),
  ('all', 'json'), ('all', 'matriz'), ('all', 'csv'), ('all', 'catalogo'))
SELECT formato, escrito, count(*) AS n FROM asked, hits GROUP BY ALL""")
def export_formats(spark, sf):
    """What each choice of a format writes, with the number of rows that are read again."""
    found = made_once(_report(spark, sf), new_folder(spark, "report-rows"))
    counted = []
    for formato in FORMATS:
        written = export(found, new_folder(spark, "formats"), formato.upper(), "gzip")
        counted += [_read_export(spark, name, path).agg(F.lit(formato).alias("formato"), F.lit(name).alias("escrito"),
                                                        F.count("*").alias("n")) for name, path in written.items()]
    return reduce(DataFrame.unionByName, counted)


# --- sync and streams ----------------------------------------------------------------------

# Responses of one decision each: arrivals are shifted by the position, table rows tell less.
_SYNCED = STORE.replace("dec AS (", "given AS (", 1).replace(", store AS (", r""",
dec AS (SELECT arrival * 4294967296 AS arrival, sala_key, sala, numero_sentencia, expediente, fecha, ano, tema,
  CASE WHEN sala_key = 'electoral' THEN 'Derecho' ELSE materia END AS materia,
  CASE WHEN sala_key = 'electoral' THEN 'ver' ELSE
    trim(regexp_replace(asunto, '[\t-\r\x1c-\x20\x{85}\x{a0}]+', ' ', 'g')) END AS asunto,
  CASE WHEN sala_key = 'electoral' THEN 'ver' ELSE
    trim(regexp_replace(extracto, '[\t-\r\x1c-\x20\x{85}\x{a0}]+', ' ', 'g')) END AS extracto, link_directo
  FROM given), store AS (""", 1)


def _sync_extract(batch):
    return captured_decisions(batch, row_hosts=HOSTS, anchor_hosts=HOSTS)


@query("sync_store", _SYNCED + f"SELECT {_COLUMNS} FROM store")
def sync_store(spark, sf):
    """A whole sync as one batch: usable responses, routing, extraction, defaults, upsert."""
    captured = _sync_extract(single_responses(decisions(spark, sf, dealt=True)))
    accepted, _ = split_rejects(sync_batch(captured))
    return upsert(None, accepted.drop("ponente"), staging=new_folder(spark, "sync-rows")).select(*_COLUMNS.split(", "))


@query("sync_filtered", _SYNCED + f"""
, matching AS (SELECT * FROM dec WHERE contains(lower(fecha), 'marzo') AND (contains(lower(tema), 'digital')
  OR contains(lower(asunto), 'digital') OR contains(lower(extracto), 'digital')
  OR contains(lower(expediente), 'digital')))
SELECT link_directo, arg_max(tema, arrival) AS tema, arg_max(fecha, arrival) AS fecha, min(arrival) AS first_seen
FROM matching GROUP BY link_directo""")
def sync_filtered(spark, sf):
    """A sync for a month and a keyword stores the matches only."""
    captured = _sync_extract(single_responses(decisions(spark, sf)))
    accepted, _ = split_rejects(sync_batch(captured, mes="marzo", palabra_clave="Digital"))
    return upsert(None, accepted).select("link_directo", "tema", "fecha", "first_seen")


def _write_files(df, path):
    """Write a stream's input as files of at most 5,000 rows; returns a third of their number."""
    df.write.option("maxRecordsPerFile", 5_000).option("compression", "zstd").parquet(path)
    return -(-len(df.sparkSession.read.parquet(path).inputFiles()) // 3)


def _streamed_store(spark, sf):
    written = new_folder(spark, "responses")
    third = _write_files(single_responses(decisions(spark, sf, dealt=True)), written)
    source = stream_responses(spark, written, files_per_trigger=third)
    path = new_folder(spark, "store")
    stream = sync_stream(
        source, path, new_folder(spark, "progress"), every=None,
        scanned_at="2026-01-01 00:00:00", extract=_sync_extract,
    )
    stream.awaitTermination()
    return read_store(spark, path)


@query("stream_upsert", _SYNCED + f"SELECT {_COLUMNS} FROM store")
def stream_upsert(spark, sf):
    """The same sync as a stream over files of responses, three micro-batches long."""
    return _streamed_store(spark, sf).select(*_COLUMNS.split(", "))


@query("stream_stats", STORE + """
SELECT 'total' AS dim, NULL AS clave, count(*) AS n FROM store
UNION ALL SELECT 'sala', sala, count(*) FROM store GROUP BY sala
UNION ALL SELECT 'ano', CAST(ano AS STRING), count(*) FROM store GROUP BY ano""")
def stream_stats(spark, sf):
    """Counts of the store that the stream has written."""
    return stats_all(_streamed_store(spark, sf))


_FOLLOWED = DEC + """
, store AS (SELECT sala_key, arg_max(sala, arrival) AS sala, arg_max(ano, arrival) AS ano FROM dec
  GROUP BY sala_key, link_directo)
"""


@query("stream_store_counts", _FOLLOWED + "SELECT sala_key, sala, ano, count(*) AS n FROM store GROUP BY ALL")
def counts_that_follow(spark, sf):
    """Counts of the store after three micro-batches; later versions of a link take its earlier year back."""
    written = new_folder(spark, "decisions")
    dec = decisions(spark, sf).select("arrival", "sala_key", "sala", "ano", "link_directo")
    # Versions of a link are dealt over all files, so that no batch has them in order.
    third = _write_files(dec.repartition(12, F.hash("arrival")), written)
    source = spark.readStream.schema(dec.schema).option("maxFilesPerTrigger", third).parquet(written)
    path = new_folder(spark, "counts")
    follow_store(source, path, new_folder(spark, "progress")).awaitTermination()
    return followed_counts(spark, path)


@query("saved_run_counts", DEC + """
, runs AS (SELECT CASE WHEN tema LIKE '%igital%' THEN '2026-01-01' ELSE '2026-01-02' END AS dia, * FROM dec),
counted AS (SELECT dia, count(*) AS capturadas, count(*) FILTER (tema NOT IN ('Nulidad', 'Competencia')) AS aceptadas,
  count(*) FILTER (tema IN ('Nulidad', 'Competencia')) AS rechazadas,
  count(DISTINCT CASE WHEN tema NOT IN ('Nulidad', 'Competencia') THEN sala_key || CASE WHEN tema = 'Amparo'
    THEN 'https://historico.tsj.gob.ve' ELSE link_directo END END) AS filas FROM runs GROUP BY dia),
chambers AS (SELECT dia, sala_key, count(*) AS n FROM runs WHERE tema NOT IN ('Nulidad', 'Competencia') GROUP BY ALL)
SELECT dia, sala_key, n, capturadas, aceptadas, rechazadas, filas FROM counted JOIN chambers USING (dia)""")
def saved_run_counts(spark, sf):
    """What two runs saw and saved, as their commits say; the rows are read once, by the job that writes them."""
    path, flawed = new_folder(spark, "saved-runs"), write_defaults(_flawed(spark, sf))
    digital = F.col("tema").contains("igital")
    save_checked(flawed.where(digital), path, "2026-01-01 00:00:00", late=True)
    save_checked(flawed.where(~digital), path, "2026-01-02 00:00:00", late=True)
    runs = run_counts(spark, path).withColumn("dia", F.date_format("fecha_escaneo", "yyyy-MM-dd"))
    return runs.select("dia", F.explode("por_sala").alias("sala_key", "n"), "capturadas", "aceptadas", "rechazadas", "filas")


@query("stream_counts", DEC + "SELECT sala, count(*) AS n FROM dec GROUP BY sala")
def counts_of_stream(spark, sf):
    written = new_folder(spark, "decisions")
    dec = decisions(spark, sf).select("arrival", "sala")
    third = _write_files(dec, written)
    source = spark.readStream.schema(dec.schema).option("maxFilesPerTrigger", third).parquet(written)
    path = new_folder(spark, "counts")
    stream_counts(source, path, new_folder(spark, "progress"), every=None).awaitTermination()
    return spark.read.schema("sala string, n bigint").parquet(path)
