"""Pages of whole texts: packed on the way, whole when they are there."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jurisindex.catalog.fixture import decisions, grouped, whole_pages
from jurisindex.functions.packing import common_words, pack, unpack


@pytest.fixture
def tables(spark, tmp_path):
    """Keys that repeat, texts that are missing, empty, long and of several alphabets."""
    texts = ["uno dos tres " * 700, None, "", "ñandú 😀 \u0000 fin", "corto"]
    rows = {
        "documents": (list(enumerate(texts)) + [(4, "corto"), (3, "otro")], "doc_id long, text string"),
        "orders": ([(i, i % 5, datetime(1995 + i % 3, 1 + i % 12, 1 + i % 28)) for i in range(1200)] + [(7, 2, datetime(1996, 8, 8))],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "customer": ([(i, f"C{i}" if i else None, i % 2) for i in range(5)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(0, "NATION_0"), (1, "NATION_1")], "n_nationkey int, n_name string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whole_pages_are_the_gathered_ones(spark, tables):
    order = lambda df: sorted(map(repr, df.collect()))
    pages = whole_pages(spark, tables)
    wanted = grouped(decisions(spark, tables))
    assert pages.schema["rows"].dataType.simpleString() == wanted.schema["rows"].dataType.simpleString()
    assert order(pages) == order(wanted) and wanted.count() > 20


def test_rows_of_whole_pages_are_gathered_after_one_shuffle_of_packed_texts(spark, tables):
    """No aggregate before the shuffle (it would sort and spill whole texts), no text unpacked before it."""
    plan = whole_pages(spark, tables)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("REPARTITION_BY_COL")
    assert plan.index("partial_collect_list") < shuffle and plan.index("[unpacked(") < shuffle < plan.index("[packed(")
    assert "hashpartitioning(sala_key" not in plan[:shuffle].rpartition("Exchange")[0]


def test_packed_texts_are_smaller_and_whole(spark):
    texts = ["la sala declara con lugar el recurso " * 3 + str(i) for i in range(50)] + ["", None, "퟿ é 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = common_words(df, "text")
    assert 0 < len(words) <= 32_768
    packed = df.select("text", pack(F.col("text"), words).alias("p"))
    rows = packed.select("text", F.octet_length("p").alias("n"), unpack(F.array("p"), words)[0].alias("back")).collect()
    assert all(r.back == r.text for r in rows)
    assert sum(r.n or 0 for r in rows) < 0.3 * sum(len((r.text or "").encode()) for r in rows)
