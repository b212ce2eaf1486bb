"""Rows of nested tables against a tree, and rows far down an order."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from jurisindex.functions.nested import has_nested_table, nested_rows, read_rows
from jurisindex.operators import search
from jurisindex.operators.html_items import html_decisions


def brute(html):
    out = []
    for row in ET.fromstring(html).iter("tr"):
        link = next((a for a in row.iter("a") if "href" in a.attrib), None)
        if link is not None:
            text = lambda e: "".join(t.strip() for t in e.itertext())
            out.append({"cells": [text(c) for c in row.iter() if c.tag in ("td", "th")], "href": link.get("href"), "label": text(link)})
    return out


def table(draw, depth):
    def inner():
        if depth and draw.random() < 0.4:
            return table(draw, depth - 1)
        if draw.random() < 0.4:
            return f'<p><a href="u{draw.randrange(99)}"> x <b>y{draw.randrange(9)}</b> </a> z </p>'
        return draw.choice(["t", " a b ", "<i>1</i><a>no</a>", ""])

    cells = lambda: "".join(f"<{t}>{inner()}{inner()}</{t}>" for t in draw.choices(["td", "th"], k=draw.randint(0, 4)))
    return "<table>" + "".join(f"<tr>{cells()}</tr>" for _ in range(draw.randint(0, 4))) + "</table>"


def test_rows_against_a_tree():
    draw = random.Random(9)
    for _ in range(400):
        html = f"<div>{table(draw, 3)}<a href='out'>o</a>{table(draw, 1)}</div>"
        assert read_rows(html) == brute(html)


def test_unclosed_cells_and_silent_elements():
    html = "<table><tr><td>1<td>2<table><tr><td>3<a href=u>l</a></table><script>no</script><tr><td>4<a href=v>m</table>"
    assert read_rows(html) == [
        {"cells": ["1", "23l", "3l"], "href": "u", "label": "l"}, {"cells": ["3l"], "href": "u", "label": "l"},
        {"cells": ["4m"], "href": "v", "label": "m"}]


@pytest.mark.parametrize("html, nested", [
    ("<table></table><table>", False), ("<TABLE a='b'><tr><table", True), ("", False), ("</table><table>", False),
    ("<tables><table></table>", False), ("<table>" + "x" * 200_000 + "</table>" + "<table><table>", True)])
def test_has_nested_table(spark, html, nested):
    df = spark.createDataFrame([(html,), (None,)], "body string")
    assert [r[0] for r in df.select(has_nested_table("body")).collect()] == [nested, None]


def test_only_nested_bodies_are_read_by_tree(spark):
    row = lambda n: f"<tr><td>{n}</td><td>e</td><td>f</td><td>t</td><td><a href='http://h.org/{n}'>ver</a></td></tr>"
    flat, outer = f"<table>{row(1)}{row(2)}</table>", f"<table><tr><td>{{}}</td></tr></table>"
    bodies = [(1, "plena", 2020, flat), (2, "plena", 2020, outer.format(flat)), (3, "plena", 2020, None),
              (4, "plena", 2020, outer.format("<table><tr><td>no link in here at all</table>"))]
    pages = spark.createDataFrame(bodies, "resp_id bigint, sala_key string, ano int, body string")
    assert [r[0] is None for r in pages.orderBy("resp_id").select(nested_rows("body")).collect()] == [True, False, True, False]
    found = html_decisions(pages, ("h.org",), ("h.org",), nested=True).orderBy("arrival").collect()
    assert [(r.numero_sentencia, r.link_directo[-1]) for r in found] == [
        ("1", "1"), ("2", "2"), ("1eftver2eftver", "1"), ("1", "1"), ("2", "2")]


def test_a_row_at_any_place(spark):
    draw = random.Random(2)
    rows = [(draw.choice([None, 2001, 2002, 2003]), n, f"l{n}") for n in range(300)]
    draw.shuffle(rows)
    store = spark.createDataFrame(rows, "ano int, first_seen bigint, link_directo string").cache()
    ordered = [r.link_directo for r in search.newest_first(store).collect()]
    for place in (0, 1, 74, 150, 271, 299):
        assert [r.link_directo for r in search.newest_at(store, place, ranges=8).collect()] == [ordered[place]]
    assert search.newest_at(store, 300).count() == 0 and search.newest_at(store.limit(0), 0).count() == 0
    assert search.newest_at(store.where(F.col("first_seen") == 7), 0).first().link_directo == "l7"


def test_a_row_at_any_place_is_read_by_its_key(spark):
    from jurisindex.operators.upsert import upsert

    draw = random.Random(3)
    texts = spark.range(40).select(F.col("id").alias("t"), F.concat(F.lit("texto "), F.col("id")).alias("extracto"))
    rows = [(n, draw.choice([None, *[f"l{k}" for k in range(90)]]), draw.choice([2001, 2002, 2003]), n % 40) for n in range(300)]
    batch = spark.createDataFrame(rows, "arrival bigint, link_directo string, ano int, t bigint").join(texts, "t").drop("t")
    store = upsert(None, batch)
    ordered = search.newest_first(store).collect()
    for place in (0, 17, 60, len(ordered) - 1, [r.link_directo for r in ordered].index(None)):
        found = search.newest_at(store, place, ranges=8, key="link_directo")
        assert found.collect() == [ordered[place]]
        # The other rows are ruled out below the upsert, before their texts are joined.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("Join") < plan.index("Filter")
    assert search.newest_at(store, len(ordered), key="link_directo").count() == 0
