"""Payloads and pages: golden values, variants and broken input."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from jurisindex.catalog.fixture import anchor_responses, row_responses
from jurisindex.functions.citation import citation
from jurisindex.operators.anchors import anchor_blocks, anchor_context
from jurisindex.operators.html_items import html_decisions
from jurisindex.operators.json_items import json_decisions, json_items
from jurisindex.operators.pages import decision_sections, page_decisions, page_links, resolve_links
from jurisindex.plans.sync import captured_decisions
from jurisindex.sources.captures import RESPONSE_SCHEMA, routed, usable_responses

LINK = "https://historico.tsj.gob.ve/decisiones/scp/marzo/354195-161-23326-2026-C25-664.HTML"


def responses(spark, bodies, url="https://x/?p_p_lifecycle=2", status=200):
    rows = [(i, "casacion_penal", 2024, url, status, body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, RESPONSE_SCHEMA)


def items_of(spark, bodies):
    found = [[] for _ in bodies]
    for row in json_items(responses(spark, bodies)).orderBy("resp_id", "pos").collect():
        found[row.resp_id].append(json.loads(row.item) if row.item and row.item[0] in "{[" else row.item)
    return found


def test_envelopes(spark):
    a, b = {"SLINK": "1"}, {"SLINK": "2"}
    cases = [
        ([a, b], [a, b]),
        ({"coleccion": {"J": [a, b]}}, [a, b]),
        ({"coleccion": {"n": 1, "z": a, "J": [b]}}, [a]),
        ({"items": [b], "JURISPRUDENCIA": [a]}, [a]),
        ({"coleccion": 5, "items": [a]}, []),
        ({"coleccion": None, "items": [a]}, []),
        ({"data": {"x": 1}}, []),
        ({"otra": [a]}, []),
        ({"decisiones": []}, []),
        (7, []),
        ("texto", []),
    ]
    assert items_of(spark, [json.dumps(body) for body, _ in cases]) == [wanted for _, wanted in cases]


def test_items_take_the_first_spelling_with_a_value(spark):
    items = [
        {"SLINKDIRECTO": "", "link_directo": None, "SLINK": "l1", "STEMA": " un \n tema ", "SASUNTO": "as", "SFECHA": ""},
        {"url": "l2", "sentencia": 12, "fecha": "5 de mayo", "extracto": "ex", "asunto": "as"},
        {"numero_sentencia": "sin enlace"}, "no", 3, None, ["x"],
    ]
    rows = json_decisions(responses(spark, [json.dumps(items)])).orderBy("arrival").collect()
    assert [(r.link_directo, r.numero_sentencia, r.fecha, r.tema, r.extracto, r.ano, r.materia) for r in rows] == [
        ("l1", "S/N", "2024", "un tema", "as", 2024, "Derecho"),
        ("l2", "12", "5 de mayo", "Jurisprudencia", "ex", 2024, "Derecho"),
    ]
    assert rows[0].sala == "Sala de Casación Penal"
    assert rows[0].arrival < rows[1].arrival


def test_routing(spark):
    bodies = ['{"a": 1}', "[1]", "5", "null", '{"a": 1} x', '{"a": 1}]', '[{"a": 1}', "<tr>", "{'a': 1}", '{"a":1},{"b":2}']
    found = [r.ruta for r in routed(responses(spark, bodies)).orderBy("resp_id").collect()]
    assert found == ["json"] * 4 + ["html"] * 6


def test_usable_responses(spark):
    good = responses(spark, ["{ }", "[]", "x"])
    bad = responses(spark, ["", "  ", "{}", " {}\n", None])
    assert usable_responses(good).count() == 3
    assert usable_responses(bad).count() == 0
    assert usable_responses(responses(spark, ["x"], status=500)).count() == 0
    assert usable_responses(responses(spark, ["x"], url="https://x/inicio")).count() == 0


def test_table_rows(spark):
    body = (
        "<table><tr><th>Nro</th></tr>"
        f"<tr><td> 161 </td><td></td><td>23 de marzo</td><td>Tema</td><td>a <i>b</i></td><td><a href='{LINK}'> ver </a></td></tr>"
        f"<tr><td><a href='{LINK}x'>solo</a></td></tr>"
        "<tr><td>9</td><td><a href='https://otra.example/1'>otra</a></td></tr></table>"
    )
    rows = html_decisions(responses(spark, [body])).orderBy("arrival").collect()
    assert [(r.numero_sentencia, r.expediente, r.fecha, r.tema, r.asunto, r.extracto, r.patron) for r in rows] == [
        ("161", "", "23 de marzo", "Tema", "ab ver", "ver", "fila"),
        ("solo", "S/E", "2024", "Jurisprudencia", "", "solo", "fila"),
    ]


def test_anchors_only_without_table_rows(spark):
    anchor = f'<li><a href="{LINK}">Un tema</a></li><li><a href="{LINK.lower()}"></a></li>'
    rows = html_decisions(responses(spark, [anchor, anchor + f"<table><tr><td><a href='{LINK}'>f</a></td></tr>"]))
    found = {}
    for r in rows.orderBy("arrival").collect():
        found.setdefault(int(r.arrival) >> 32, []).append((r.patron, r.numero_sentencia, r.expediente, r.fecha, r.ano, r.tema))
    assert found[0] == [
        ("enlace", "161", "C25/664", "Marzo 2026", 2026, "Un tema"),
        ("enlace", "161", "c25/664", "Marzo 2026", 2026, "Jurisprudencia"),
    ]
    assert [r[0] for r in found[1]] == ["fila"]


def test_pages_of_short_fields_gather_no_texts(spark):
    names = ("numero_sentencia", "expediente", "fecha", "tema", "link_directo", "materia", "asunto", "extracto", "ponente")
    dec = spark.range(1000).select(F.col("id").alias("arrival"), F.lit("plena").alias("sala_key"), F.lit(2024).alias("ano"),
                                   *[F.concat(F.lit(n), "id").alias(n) for n in names])
    for made in (row_responses(dec), anchor_responses(dec)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "link_directo" in plan and "extracto" not in plan and "asunto" not in plan
        assert made.where("body LIKE '%link_directo499%' AND body LIKE '%tema0%'").count() == 1


def test_short_html_holds_nothing(spark):
    assert html_decisions(responses(spark, ["<tr><td><a href='tsj.gob.ve'>x</a>"])).count() == 0


def test_citations(spark):
    cases = {
        LINK: ("scp", "161", "C25/664", "Marzo", 2026),
        LINK.replace(".HTML", ".HTM"): ("scp", "161", "C25/664", "Marzo", 2026),
        "https://historico.tsj.gob.ve/decisiones/scc/febrero/05-170200-99609.HTM": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select(citation("u").alias("c")).collect()
    assert [r.c and (r.c.code, r.c.numero, r.c.expediente, r.c.mes, r.c.ano) for r in rows] == list(cases.values())
    only_html = spark.createDataFrame([(u,) for u in cases], "u string").select(citation("u", html_only=True).alias("c"))
    assert [r.c is not None for r in only_html.collect()] == [True, False, False]


def test_anchor_blocks(spark):
    html = (
        "<table><tr><td> Uno <a href='a'>dos</a> <b>tres</b><script>no</script><td><a href='b'>cuatro</a></table>"
        "<ul><li>x<ul><li><a href='c'>y</a></ul> z<li><a href='d'>w</a></ul>"
        "<p>p1 <a href='e'>q</a><p>p2<div>d1 <a href='f'>r</a></div><span><a href='g'>s</a></span>"
        f"<div>{'l' * 300}<a href='h'>t</a></div>"
    )
    rows = anchor_blocks(responses(spark, [html])).orderBy("pos").collect()
    assert {r.href: r.bloque for r in rows} == {
        "a": "Unodostres", "b": "cuatro", "c": "y", "d": "w", "e": "p1q", "f": "d1r", "g": "", "h": "l" * 200,
    }


def test_anchor_context(spark):
    html = f"<div>Sobre <a href='{LINK}'>la prueba</a></div><a href='{LINK}'>suelto</a><div><a href='/x'>y</a></div>"
    rows = anchor_context(responses(spark, [html, None, "<p>nada</p>"])).orderBy("arrival").collect()
    assert [(r.tema, r.asunto, r.fecha, r.ano, r.expediente) for r in rows] == [
        ("Sobrela prueba", "Sobrela prueba", "Marzo de 2026", 2026, "C25/664"),
        ("Jurisprudencia", "", "Marzo de 2026", 2026, "C25/664"),
    ]


def test_rendered_pages_answer_where_responses_gave_nothing(spark, tmp_path):
    rows = [
        (1, "plena", 2023, "https://x/?p_p_lifecycle=2", 200, json.dumps([{"url": "de respuesta"}])),
        (2, "plena", 2024, "https://x/?p_p_lifecycle=2", 200, json.dumps({"nada": 1})),
    ]
    pages = [(i, "plena", ano, "p", 200, f"<p>t <a href='{LINK}'>x</a></p>") for i, ano in ((5, 2023), (6, 2024))]
    responses, pages = (spark.createDataFrame(t, RESPONSE_SCHEMA) for t in (rows, pages))
    for staging in (None, str(tmp_path / "staging")):
        captured = captured_decisions(responses, pages, staging=staging)
        # The scan of 2023 is answered; the year of the other row is that of its address.
        assert sorted((r.ano, r.link_directo) for r in captured.collect()) == [(2023, "de respuesta"), (2026, LINK)]


# --- decision pages ------------------------------------------------------------------------

PAGE = """<html><body><h1>TRIBUNAL SUPREMO DE JUSTICIA</h1><p>Sentencia Nº 0890</p>
<p>Expediente: AA50-X-2024-000099</p><p>Magistrado Ponente: Dra. Tania D'Amelio</p>
<p>Fecha: 20 de mayo de 2024</p><p>Texto completo del fallo en materia de prueba digital.</p></body></html>"""


def page(spark, html, **options):
    return page_decisions(spark.createDataFrame([("u", html)], "url string, html string"), "hoy", **options).first()


def test_page_metadata(spark):
    row = page(spark, PAGE)
    assert (row.numero_sentencia, row.expediente, row.fecha) == ("0890", "AA50-X-2024-000099", "20 de mayo de 2024")
    assert row.ponente == "Dra. Tania D'Amelio Fecha"
    assert row.materia == "Derecho Constitucional / Penal"  # letters only, up to a line end
    strict = page(spark, PAGE, strict=True)
    assert strict.ponente == "Dra. Tania D'Amelio"


def test_page_defaults(spark):
    row = page(spark, "<p>" + "x" * 401)
    assert (row.numero_sentencia, row.expediente, row.fecha, row.ponente) == ("S/N", "S/E", "hoy", "No especificado")
    assert (row.materia, row.tema) == ("Derecho Constitucional / Penal", "Garantías Procesales y Evidencia Digital")
    assert row.resumen == "x" * 400 + "..." and row.texto_completo == "x" * 401


def test_strict_patterns_keep_to_words(spark):
    html = "<p>La norma expresa 12345 del sistema: nulo</p>"
    assert page(spark, html).expediente != "S/E"
    strict = page(spark, html, strict=True)
    assert (strict.expediente, strict.tema) == ("S/E", "Garantías Procesales y Evidencia Digital")


def test_links(spark):
    html = "<a href='/uno.html'>1</a><a href='dos.HTML'>2</a><!-- <a href='no.html'>x</a> --><a href='tres.pdf'>3</a><a href='http://h/4.html'>4</a>"
    links = resolve_links(page_links(spark.createDataFrame([(html,)], "html string")), "http://base/scp/")
    assert [(r.pos, r.link) for r in links.collect()] == [
        (0, "http://base/scp/uno.html"), (1, "http://base/scp/dos.HTML"), (2, "http://h/4.html"),
    ]


def test_sections(spark):
    body = "preámbulo\n\n antecedentes \n\nSe ANULA <x> y ANULARÁ\n\nIII\n\nDECISIÓN\ntexto\n\n\n\nDecisión"
    rows = decision_sections(spark.createDataFrame([(1, body)], "id int, texto_completo string")).orderBy("parrafo").collect()
    assert [(r.seccion, r.es_titulo, r.texto) for r in rows] == [
        (0, False, "preámbulo"), (1, True, "ANTECEDENTES"), (1, False, "Se <b>ANULA</b> &lt;x&gt; y ANULARÁ"),
        (2, True, "III"), (2, False, "DECISIÓN\ntexto"), (3, True, "DECISIÓN"),
    ]
