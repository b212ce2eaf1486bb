"""The four searches, filters, fallbacks, counts and exports on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jurisindex.functions import predicates as P
from jurisindex.operators import search, stats
from jurisindex.operators.export import catalog_total, export, export_matrix, summary_catalog
from jurisindex.operators.fallback import first_non_empty
from jurisindex.operators.pages import first_links_by, limit_links
from jurisindex.operators.scan_plan import missing_scans, scan_plan
from jurisindex.sources.dimensions import dim_sala, resolve_sala, sala_keys, store_name

SCHEMA = ("link_directo string, sala string, fecha string, ano int, tema string, materia string, asunto string, "
          "extracto string, expediente string, numero_sentencia string, first_seen bigint")
ROWS = [
    ("l1", "Sala de Casación Penal", "3 de Marzo de 2024", 2024, "FIRMA ELECTRÓNICA", "Derecho 100%", "as", "ex", "C-1", "7", 1),
    ("l2", "Sala Electoral", "2024", 2024, "Firma electronica", "Civil", None, "á_b", "C-2", "8", 2),
    ("l3", "Sala Plena", "9 de marzo de 2023", 2023, "otro", "electrónica", "", None, "X-3", "9", 3),
    ("l4", None, None, 2022, None, None, None, None, None, None, 4),
]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def links(df):
    return sorted(r.link_directo for r in df.collect())


def test_searches_differ(store):
    assert links(search.search4(store, "electrónica")) == ["l1"]
    assert links(search.search6(store, "ELECTRÓNICA")) == ["l1", "l3"]
    assert links(search.search6_folded(store, " Electrónica ")) == ["l1", "l2", "l3"]
    assert links(search.store_search(store, "electrónica")) == ["l3"]
    # The wildcard stands for the accented capital too.
    assert links(search.store_search(store, "electr%nica")) == ["l1", "l2", "l3"]


def test_prepared_column_gives_the_same(store):
    prepared = store.withColumn(P.FOLDED_COLUMN, P.folded_fields())
    for kw in ("electronica", "Á_B", "firma", "civil á", "1", "ex\u0001", "no hay"):
        assert links(search.search6_folded(prepared, kw)) == links(search.search6_folded(store, kw)), kw


def test_keywords_are_taken_as_they_are(store):
    assert links(search.search4(store, " electrónica")) == ["l1"]
    assert links(search.search4(store, "  firma")) == []
    assert links(search.refine(store, "  firma ")) == ["l1", "l2"]
    assert links(search.search6(store, "100%")) == ["l1"]
    assert links(search.store_search(store, "á_b")) == ["l2"]
    assert links(search.store_search(store, "_")) == ["l1", "l2", "l3"]
    assert links(search.store_search(store, "a\\b")) == []


@pytest.mark.parametrize("blank", ["", "   "])
def test_blank_keywords_filter_nothing(store, blank):
    for found in (search.search4, search.search6, search.search6_folded, search.store_search, search.refine):
        assert found(store, blank).count() == 4


def test_store_search_by_chamber_and_year(store):
    assert links(search.store_search(store, sala=" PENAL ")) == ["l1"]
    assert links(search.store_search(store, sala="casaciÓn")) == []
    assert links(search.store_search(store, ano=2024)) == ["l1", "l2"]
    assert links(search.store_search(store, ano=0)) == ["l1", "l2", "l3", "l4"]
    assert [r.link_directo for r in search.store_search(store).collect()] == ["l2", "l1", "l3", "l4"]


def test_facets(store):
    plain = lambda **f: links(search.faceted_search(store, **f))
    folded = lambda **f: links(search.faceted_search(store, folded=True, **f))
    assert plain(sala="scp") == ["l1"] and folded(sala="casacion_penal") == ["l1"]
    assert folded(sala="scp") == plain(sala="nadie") == folded(sala="nadie") == ["l1", "l2", "l3", "l4"]
    assert plain(mes="marzo") == folded(mes="marzo") == ["l1", "l3"]
    assert plain(mes="marzo", q="electrónica", sala="plena") == ["l3"]
    assert folded(mes="marzo", q="electronica") == ["l1", "l3"]
    assert search.faceted_count(store, mes="marzo").first().total == 2


def test_alias_filter_of_an_unknown_key():
    assert P.sala_by_alias("nadie") is None and P.sala_by_alias("todas") is None and P.sala_by_alias("") is None


def test_keyword_classifier(spark):
    texts = ["sobre FIRMA ELECTRÓNICA", "sobre firma electronica", "WhatsApp", "", None, "hardware"]
    df = spark.createDataFrame([(t,) for t in texts], "texto_completo string")
    assert [r.texto_completo for r in search.tech_filter(df).collect()] == [texts[0], texts[2]]


def test_cards_and_detail(store):
    cards = {r.link_directo: r for r in search.decision_cards(store).collect()}
    assert cards["l4"].asDict() == {
        "sala": None, "fecha": "2022", "numero_sentencia": None, "expediente": None, "ponente": "No especificado",
        "tema": "Jurisprudencia", "materia": "Derecho Procesal", "vista": "...", "link_directo": "l4",
    }
    assert cards["l1"].vista == "ex..."
    detail = search.decision_detail(store, "l4").first()
    assert (detail.tema, detail.materia, detail.extracto, detail.fecha) == ("General", "General", "", "2022")
    ordered = search.newest_first(store)
    assert [search.decision_at(ordered, i).first().url for i in range(4)] == ["l2", "l1", "l3", "l4"]


def test_resolving_chambers(spark):
    cases = {"scp": "casacion_penal", " Penal ": "casacion_penal", "Sala Plena": "constitucional", "plena": "plena",
             "CASACION CIVIL": "casacion_civil", "": "constitucional", "politico administrativa": "politico_administrativa"}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select(resolve_sala("c").alias("k"))
    assert [r.k for r in df.collect()] == list(cases.values())


def test_store_names(spark):
    df = spark.createDataFrame([("casacion_civil",), ("todas",), (None,)], "k string").select(store_name("k").alias("n"))
    assert [r.n for r in df.collect()] == ["sala_casacion_civil", "tsj_todas_las_salas", "tsj_todas_las_salas"]


def test_scan_plan(spark):
    assert dim_sala(spark).count() == 7 and len(sala_keys("todas")) == 7
    assert scan_plan(spark, "todas", 2019, 2026).count() == 56
    assert scan_plan(spark, "plena", 2026, 2019).count() == 0
    captured = spark.createDataFrame([("plena", 2020), ("plena", 2020)], "sala_key string, ano int")
    left = missing_scans(scan_plan(spark, "plena", 2019, 2021), captured)
    assert sorted(r.ano for r in left.collect()) == [2019, 2021]


# --- fallbacks -----------------------------------------------------------------------------


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_first_non_empty(spark):
    empty, a, b = numbers(spark), numbers(spark, 1, 2), numbers(spark, 3)
    taken = lambda *s: sorted(r.v for r in first_non_empty(list(s)).collect())
    assert taken(a, b) == [1, 2]
    assert taken(empty, b, a) == [3]
    assert taken(empty, empty) == []


def test_a_source_that_did_not_win_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    source = spark.read.parquet(path)
    found = first_non_empty([source.where("id < 0"), source.where("id < 10"), source])
    assert len(found.collect()) == 10
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1


# --- counts, links, exports ----------------------------------------------------------------


def test_counts_agree(store):
    total = stats.stats_total(store).first().total
    assert total == sum(r.n for r in stats.stats_by_sala(store).collect())
    assert total == sum(r.n for r in stats.stats_by_year(store).collect())
    assert [r.ano for r in stats.stats_by_year(store).collect()] == [2024, 2023, 2022]
    maps = stats.stats_maps(store.where("sala IS NOT NULL")).first()
    assert maps.total_registros == 3 and maps.por_ano == {"2024": 2, "2023": 1} and maps.por_sala["Sala Plena"] == 1


def test_first_links_of_a_large_group(spark):
    html = "".join(f"<a href='{i}.html'>x</a>" for i in range(9))
    pages = spark.range(300).select("id", F.lit(html).alias("html"))
    found = first_links_by(pages, F.lit("g"), "id", 4).select("id", "pos", "puesto").orderBy("puesto").collect()
    assert [tuple(r) for r in found] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4)]
    assert [r.pos for r in limit_links(pages, "id", 11).orderBy("id", "pos").collect()] == [*range(9), 0, 1]


def test_export(spark, store, tmp_path):
    paths = export(store, str(tmp_path), "all")
    assert set(paths) == {"json", "matriz", "csv", "catalogo"}
    matrix = spark.read.csv(paths["matriz"], header=True, escape='"', multiLine=True)
    assert matrix.columns[0] == "Sala TSJ" and matrix.columns[-1] == "Link Directo TSJ" and len(matrix.columns) == 9
    found = {r["Link Directo TSJ"]: r for r in matrix.collect()}
    assert found["l1"]["Sala TSJ"] == "Sala Casación Penal" and found["l4"]["Tema"] == "Sentencia"
    lines = [json.loads(r.value) for r in spark.read.text(paths["json"]).collect()]
    assert {line["link_directo"] for line in lines} == {"l1", "l2", "l3", "l4"} and "asunto" in lines[0]
    assert spark.read.csv(paths["catalogo"], header=True).count() == 4
    assert set(export(store, str(tmp_path / "x"), "XLSX")) == {"matriz"}
    with pytest.raises(ValueError):
        export(store, str(tmp_path), "doc")


def test_compressed_export(spark, tmp_path):
    rows = [("l1", 'x "y"\nz, ' * 2000, None), ("l2", "", "a")]
    df = spark.createDataFrame(rows, "link_directo string, extracto string, asunto string").coalesce(1)
    sizes = {}
    for codec in (None, "gzip"):
        written = export(df, str(tmp_path / str(codec)), "all", codec)
        assert spark.read.schema(df.schema).json(written["json"]).sort("link_directo").collect() == df.sort("link_directo").collect()
        again = spark.read.csv(written["matriz"], header=True, escape='"', multiLine=True)
        assert again.count() == 2 and rows[0][1] in {v for r in again.collect() for v in r}
        files = [f for path in written.values() for f in (tmp_path / str(codec)).glob(f"{path.rsplit('/', 1)[1]}/part-*")]
        assert len(files) == 4 and all(f.name.endswith(".gz") == (codec == "gzip") for f in files)
        sizes[codec] = sum(f.stat().st_size for f in files)
    assert 5 * sizes["gzip"] < sizes[None]


def test_matrix_and_catalog(store):
    row = export_matrix(store.where("link_directo = 'l2'")).first()
    assert (row.sala, row.asunto, row.extracto) == ("Sala Electoral", "", "á_b")
    catalog = summary_catalog(store.where("link_directo = 'l1'")).first()
    assert (catalog.sala, catalog.ponente) == ("Casación Penal", "")
    assert catalog_total(store).first().total == 4
