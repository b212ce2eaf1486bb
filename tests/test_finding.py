"""Keyword tables, held results and searches that skip files."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from jurisindex.catalog import ORACLES, QUERIES, fixture
from jurisindex.functions.predicates import FIELD_DIVIDER
from jurisindex.operators import keywords, search, trigrams
from jurisindex.operators.held import LOWERED_COLUMN, HeldResult
from jurisindex.operators.keywords import with_categories, with_keywords
from jurisindex.operators.saved_store import committed, compact, drop_covered, read_store, save_batch
from jurisindex.operators.upsert import KEY, VALUES
from tests.oracle import compare


def test_keywords_against_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "x", "Órgano ÓRGANO", *["".join(rng.choice("abcÁ \n") for _ in range(rng.randrange(300))) for _ in range(40)]]
    words = sorted({"".join(rng.choice("abcá") for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    rows = [(w.upper() if k % 3 else f" {w} ", "par" if k % 2 else None) for k, w in enumerate(words)]
    rows += [(None, "par"), ("  ", "par"), ("órgano", "par"), (" ab", "otro"), ("ab", "otro")]
    table = spark.createDataFrame(rows, "clave string, categoria string")
    known = {}
    for clave, categoria in rows:
        if clave and clave.strip():
            known.setdefault(clave.lower().strip(), set()).add(categoria)
    docs = spark.createDataFrame(list(enumerate(texts)), "claves int, texto string").repartition(3)
    docs = docs.withColumn("id", F.col("claves"))
    for block_bytes in (keywords.BLOCK_BYTES, 200):
        found = {r.id: r.claves for r in with_keywords(docs, "texto", table, block_bytes=block_bytes).collect()}
        grouped = {r.id: [tuple(c) for c in r.categorias] for r in with_categories(docs, "texto", table, block_bytes=block_bytes).collect()}
        for k, t in enumerate(texts):
            held = sorted(w for w in known if w in (t or "").lower())
            assert found[k] == held
            counts = {c: sum(c in known[w] for w in held) for c in ("par", "otro")}
            assert grouped[k] == sorted(((c, n) for c, n in counts.items() if n), key=lambda p: (-p[1], p[0]))
    assert with_keywords(docs, "texto", table.limit(0)).where(F.size("claves") > 0).count() == 0
    assert with_keywords(docs.limit(0), "texto", table).count() == 0


def test_too_many_keywords_are_refused(spark, monkeypatch):
    monkeypatch.setattr(keywords, "TABLE_BYTES", 10)
    table = spark.createDataFrame([("abcdef",), ("ghijkl",)], "clave string")
    with pytest.raises(ValueError, match="table of keywords"):
        with_keywords(table, "clave", table)


def decisions(spark, n=400):
    """Decisions of two chambers, one with a name that folders must escape; every hundredth has a rare word."""
    fields = {"sala": F.lit("Sala Penal"), "ano": F.lit(2024), KEY: F.concat(F.lit("http://e/"), "id")}
    words = F.concat(F.lit("Señal "), F.sha2(F.col("id").cast("string"), 256), F.lit(" fin "))
    rare = F.when(F.col("id") % 100 == 0, F.concat(F.lit("RÁRO_"), F.col("id"))).otherwise(words)
    rows = spark.range(n).select("id", *[fields.get(c, rare if c == "extracto" else F.lit("x")).alias(c) for c in (*VALUES, KEY)])
    return rows.withColumns({"arrival": F.col("id"), "sala_key": F.when(F.col("id") % 2 == 0, "a b%/ñ").otherwise("scp")}).drop("id")


def links(df):
    return sorted(r[0] for r in df.select(KEY).collect())


def test_held_result(spark):
    store = decisions(spark).withColumn(LOWERED_COLUMN, F.lit("other"))
    with HeldResult(search.faceted_search(store, q="x")) as held:
        assert held.rows.columns == [c for c in store.columns if c != LOWERED_COLUMN]
        assert held.total() == search.faceted_search(store, q="x").count() == held.counts().agg(F.sum("n")).first()[0]
        for kw in (" RÁRO_", "señal", "fin\n", "", FIELD_DIVIDER, "x" + FIELD_DIVIDER):
            found = held.refine(kw)
            assert links(found) == links(search.refine(held.rows, kw))
            assert "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
        assert links(held.refine("ráro", "_1")) == ["http://e/100"]
        assert held.refine("ráro", sala="scc").count() == 0
        level = held._held.storageLevel
        assert level.useMemory and level.useDisk
        last = held.refine("ráro")
    assert not held._held.storageLevel.useMemory and last.count() == 4


def test_stores_searched_get_texts_of_last_versions_only(spark, tmp_path):
    # Thirty versions of a link, some orders twice or without a customer; texts that differ from version to version.
    orders = spark.range(1_200).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 97 != 5, F.col("id") % 40).alias("o_custkey"),
        F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_interval(0, 0, 0, cast(id AS int))").alias("o_orderdate"))
    words = F.element_at(F.array(*map(F.lit, ("Digital", "custodia", "CASACIÓN", "otro"))), (F.col("id") % 4 + 1).cast("int"))
    tables = {
        "orders": orders.unionByName(orders.where("o_orderkey % 11 = 3")),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "cast(id % 9 AS int) AS c_nationkey"),
        "nation": spark.range(9).selectExpr("cast(id AS int) AS n_nationkey", "concat('NATION_', id) AS n_name"),
        "documents": spark.range(70).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" texto "), "id").alias("text")),
    }
    connection = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("refine_held", "search6_folded_prepared"):
        assert connection.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 5
        assert compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], connection) is None, name
    plan = fixture.store(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (doc_id#") < plan.index("Join LeftSemi")


def test_searches_read_only_files_with_the_needle(spark, tmp_path):
    path = str(tmp_path / "almacén 1")
    rows = decisions(spark)
    save_batch(rows.where("arrival < 200"), path, "2026-01-01 00:00:00")
    save_batch(rows.where("arrival >= 200"), path, "2026-01-01 00:00:00")
    trigrams.index_trigrams(spark, path)
    assert trigrams.files_with(spark, path, ["raro"]) is None, "a store of several batches is merged first"
    assert links(trigrams.folded_search(spark, path, "raro")) == [f"http://e/{k}" for k in (0, 100, 200, 300)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        compact(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert trigrams.files_with(spark, path, ["raro"]) is None, "not indexed yet"
    trigrams.index_trigrams(spark, path)
    trigrams.index_trigrams(spark, path)
    store, every = read_store(spark, path), len(read_store(spark, path).inputFiles())
    assert 0 < len(trigrams.files_with(spark, path, ["raro_"])) <= 4 < every
    assert len(trigrams.candidates(spark, path, ["raro_"]).inputFiles()) <= 4
    assert len(trigrams.files_with(spark, path, ["raro_300"])) == 1 and trigrams.files_with(spark, path, ["zzzzzz"]) == []
    for kw in ("raro", "RÁRO_3", "señal", "fin", "fin ", "no such", "ñ", "", "x" + FIELD_DIVIDER + "x"):
        assert links(trigrams.folded_search(spark, path, kw)) == links(search.search6_folded(store, kw)), kw
    for kw in ("R_RO%3", "%RO_300", "al %n", "fin ", "fin", "zzz%al", "__", "%", "", "RÁRO", "ráro"):
        assert links(trigrams.like_search(spark, path, kw)) == links(search.store_search(store, kw)), kw
    save_batch(rows.where("arrival = 1"), path, "2026-01-02 00:00:00")
    assert trigrams.folded_search(spark, path, "raro").count() == 4
    before = committed(spark, path)[1]
    drop_covered(spark, path)
    assert len(before) == 2 and not any((tmp_path / "almacén 1" / "trigrams" / f"lote={name}").exists() for name in before)


def test_trigrams_of_long_and_missing_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "CHUNK", 7)
    path = str(tmp_path / "s")
    rows = decisions(spark, 3).withColumn("extracto", F.when(F.col("arrival") == 1, F.concat(F.repeat(F.lit("abc é "), 999), F.lit("final"))))
    save_batch(rows, path, "2026-01-01 00:00:00")
    trigrams.index_trigrams(spark, path)
    for kw in ("c e a", "e final", "abc", "bca"):
        assert links(trigrams.folded_search(spark, path, kw)) == links(search.search6_folded(read_store(spark, path), kw)), kw
