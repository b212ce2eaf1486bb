"""Upsert laws, the saved store, rejects and streams."""

from __future__ import annotations

import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from jurisindex.catalog import finding, payloads, saving
from jurisindex.catalog.fixture import decisions, referring, single_responses, with_texts, HOSTS
from jurisindex.functions.constants import SITE_ROOT
from jurisindex.operators.export import export, made_once
from jurisindex.operators.stats import stats_total
from jurisindex.operators.saved_store import (
    committed, compact, drop_covered, merged_by_link, read_store, read_store_if_any, run_counts, save_batch,
)
from jurisindex.operators.upsert import (
    KEY, VALUES, checked, last_rows, last_versions, merge_versions, save_counts, split_rejects, upsert, write_defaults,
)
from jurisindex.plans.sync import captured_decisions, save_checked, sync, sync_batch
from jurisindex.sources.captures import stream_responses
from jurisindex.streaming.stream import sync_info, sync_stream

SF = "/root/testdata/sf0.001"
FIELDS = [*VALUES, KEY, "first_seen", "last_seen"]


def rows(df, columns=FIELDS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def dec(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dec"))
    decisions(spark, SF).drop("ponente").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def whole(dec):
    return rows(upsert(None, dec))


def brute_force(records):
    """One record at a time, as an insert-or-overwrite."""
    current = {}
    for r in sorted(records, key=lambda r: r["arrival"]):
        before = current.get(r[KEY])
        first = before[-2] if before else r["arrival"]
        current[r[KEY]] = (*[r[c] for c in VALUES], r[KEY], first, r["arrival"])
    return sorted(current.values())


def test_upsert_is_one_record_at_a_time(dec, whole):
    assert whole == brute_force([r.asDict() for r in dec.collect()])


def test_upsert_again_changes_nothing(dec, whole):
    assert rows(upsert(upsert(None, dec), dec)) == whole


def test_batches_in_any_order_give_the_same_store(dec, whole):
    late, early = dec.where("arrival % 3 = 0"), dec.where("arrival % 3 <> 0")
    assert rows(upsert(upsert(None, late), early)) == whole
    assert rows(upsert(upsert(None, early), late)) == whole


def test_hot_link(spark):
    """One link has a third of all rows."""
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 1000))
    base = spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("arrival"), hot.alias(KEY), F.lit(2024).alias("ano"),
        *[F.col("id").cast("string").alias(c) for c in VALUES if c != "ano"],
    )
    found = upsert(None, base).where(f"{KEY} = 'hot'").first()
    assert (found.first_seen, found.last_seen, found.tema) == (0, 59_997, "59997")
    plan = upsert(None, base)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning(link_directo")


def test_late_upsert(spark):
    """The same rows as read once, with null keys and arrivals, rows twice and long values joined after the last versions are known."""
    texts = spark.range(40).select(F.col("id").alias("t"), F.repeat(F.col("id").cast("string"), 50).alias("extracto"))
    base = spark.range(400).select(
        F.when(F.col("id") % 50 != 7, F.col("id")).alias("arrival"), (F.col("id") % 40).alias("t"), (F.col("id") % 3).cast("string").alias("sala_key"),
        F.when(F.col("id") % 9 != 4, F.concat(F.lit("l"), F.col("id") % 27)).alias(KEY), F.when(F.col("id") % 4 > 0, F.col("id")).alias("tema"))
    gone = base.where("arrival = 399").select(F.lit(None).cast("long").alias("arrival"), "t", "sala_key", F.lit("only").alias(KEY), "tema")
    batch = base.unionByName(base).unionByName(gone).join(texts.hint("merge"), "t").drop("t")
    for keys in ((KEY,), ("sala_key", KEY)):
        late, once = upsert(None, batch, keys, late=True), upsert(None, batch, keys)
        columns = [KEY, "sala_key", "tema", "extracto", "first_seen", "last_seen"]
        found = [sorted(map(str, df.select(columns).collect())) for df in (late, once)]
        assert found[0] == found[1] and len(found[0]) > 20
    # Only the last versions are joined with their texts.
    plan = upsert(None, batch, late=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")


def test_late_saves(spark, dec, whole, tmp_path):
    path = str(tmp_path / "store")
    for part in (1, 2, 0):
        save_batch(dec.where(f"pmod(hash(arrival), 3) = {part}"), path, "2026-01-01 00:00:00", buckets=4, late=True)
    found = read_store(spark, path)
    assert "Exchange" not in final_plan_of(found) and rows(found) == whole
    assert found.where("buscable IS NULL").count() == 0


def test_queries_that_save_shuffle_last_versions_only(spark, monkeypatch):
    """Upserts and saves of joined texts look for the last versions first."""
    from jurisindex.operators import saved_store

    plan = saving.upsert_batches(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    taken = []
    monkeypatch.setattr(saved_store, "last_versions", lambda *a, **k: taken.append(1) or last_versions(*a, **k))
    finding._indexed_store(spark, SF)
    saving.broken_store(spark, SF)
    assert len(taken) == 4


def test_staged_saves_move_last_versions_only(spark, tmp_path):
    # Twenty versions of each link, some rows twice; a link without arrivals and one without values.
    base = spark.range(4_000).select(
        F.col("id").alias("arrival"), F.concat(F.lit("l"), F.col("id") % 200).alias(KEY), F.lit("plena").alias("sala_key"),
        F.when(F.col("id") % 3 > 0, F.repeat(F.col("id").cast("string"), 5)).alias("extracto"))
    gone = base.limit(1).select(F.lit(None).cast("long").alias("arrival"), F.lit("gone").alias(KEY), "sala_key", "extracto")
    base.union(base.where("arrival % 7 = 0")).union(gone).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    for keys in ((KEY,), ("sala_key", KEY)):
        few, once = merge_versions(last_rows(batch, keys), keys), upsert(None, batch, keys)
        assert rows(few, [KEY, "first_seen", "last_seen"]) == rows(once, [KEY, "first_seen", "last_seen"])
        assert sorted(map(str, few.select(*once.columns).collect())) == sorted(map(str, once.collect()))
        # Earlier versions are dropped where they are read; a few may share a bit.
        assert last_rows(batch, keys).where("extracto IS NOT NULL").count() < 300


def test_staged_upsert(spark, tmp_path):
    """Rows are made once; earlier versions are dropped where they are read, before the shuffle."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(value):
        made.add(1)
        return None if value % 5 == 0 else f"t{value}"

    batch = spark.range(0, 2_000, 1, 4).select(
        F.col("id").alias("arrival"), F.when(F.col("id") % 100 > 0, F.concat(F.lit("l"), F.col("id") % 100)).alias(KEY), dear("id").alias("extracto"))
    staged = upsert(None, batch, staging=str(tmp_path / "staging"))
    assert made.value == 2_000 and staged.count() == 100
    assert sorted(map(str, staged.collect())) == sorted(map(str, upsert(None, batch).select(staged.columns).collect()))


def test_routing_joins_before_texts(spark):
    """No body is shuffled: the rows are joined while a number stands for their texts."""
    plan = payloads.response_routing(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "did#" in joins[0] and "did#" not in joins[1]
    whole = with_texts(referring(spark, SF), spark.read.parquet(f"{SF}/documents.parquet"))
    columns = sorted(whole.columns)
    assert rows(whole, columns) == rows(decisions(spark, SF), columns)


def test_staged_rows_are_deleted(spark, dec, whole, tmp_path):
    path, staging = str(tmp_path / "store"), tmp_path / "staging"
    for part in (1, 2, 0):
        save_checked(write_defaults(dec.where(f"pmod(hash(arrival), 3) = {part}")), path, f"2026-01-0{part + 1} 00:00:00", staging=str(staging))
        assert not staging.exists()
    assert rows(read_store(spark, path)) == whole
    seen = run_counts(spark, path).agg(F.sum("capturadas"), F.sum("aceptadas"), F.sum("rechazadas")).first()
    assert tuple(seen) == (dec.count(), dec.count(), 0)


def test_dealt_decisions_are_the_same(spark):
    # One small file of orders is one task, however long the texts that are joined to it.
    given, dealt = decisions(spark, "/root/testdata/sf0.1"), decisions(spark, "/root/testdata/sf0.1", dealt=True)
    assert given.select("arrival").rdd.getNumPartitions() < 8 <= dealt.select("arrival").rdd.getNumPartitions()
    small, spread = decisions(spark, SF), decisions(spark, SF, dealt=True)
    assert small.dtypes == spread.dtypes and rows(small, small.columns) == rows(spread, small.columns)


def test_exports_of_rows_made_once(spark, tmp_path):
    """A report's rows are made for the first file only, by several tasks; all files have them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(value):
        made.add(1)
        return None if value % 7 == 0 else f'{value}, "x"\n ñ '

    given = spark.range(0, 100, 1, 4).select(F.lit("Sala Plena").alias("sala"), dear("id").alias("asunto"), F.lit("").alias("fecha"))
    once = made_once(given, str(tmp_path / "rows"))
    written = export(once, str(tmp_path / "report"), "all", "gzip")
    assert made.value == 100 and once.rdd.getNumPartitions() > 1
    assert sorted(written) == ["catalogo", "csv", "json", "matriz"] and once.dtypes == given.dtypes
    assert {name: saving._read_export(spark, name, path).count() for name, path in written.items()} == dict.fromkeys(written, 100)
    back = spark.read.schema(given.schema).json(written["json"])
    assert rows(back.na.fill("-"), given.columns) == rows(once.na.fill("-"), given.columns)
    assert saving._report(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 8


def test_counts_do_not_move_texts(dec):
    plan = stats_total(upsert(None, dec))._jdf.queryExecution().executedPlan().toString()
    assert "extracto" not in plan and "max_by" not in plan


# --- writing -------------------------------------------------------------------------------


def test_defaults_of_absent_columns(spark):
    df = spark.createDataFrame([("l", None)], "url string, asunto string")
    row = write_defaults(df.withColumn("asunto", F.lit("as"))).first()
    assert row.asDict() == {
        "sala": "Sala Constitucional", "numero_sentencia": "S/N", "expediente": "S/E", "fecha": "N/A", "ano": 2024,
        "tema": "Sentencia", "materia": "Derecho Procesal", "asunto": "as", "extracto": "as", KEY: "l",
    }


def test_rejects(spark, tmp_path):
    data = [
        (1, "Sala Plena", "2024", "a"), (2, None, "2024", "b"), (3, "Sala Plena", "x", "c"), (4, "Sala Plena", " 7 ", "d"),
        (5, "Sala Plena", "2024.5", "e"), (6, "Sala Plena", None, "f"), (7, "Sala Plena", "2024", None), (8, "", "1", ""),
    ]
    written = write_defaults(spark.createDataFrame(data, f"arrival bigint, sala string, ano string, {KEY} string"))
    accepted, rejected = split_rejects(written)
    assert sorted(r.arrival for r in accepted.collect()) == [1, 4, 7, 8]
    assert sorted(r.arrival for r in rejected.collect()) == [2, 3, 5, 6]
    assert {r.arrival: r[KEY] for r in accepted.collect()}[7] == SITE_ROOT
    assert save_counts(written).first().asDict() == {"aceptadas": 4, "rechazadas": 4}
    for parts in ((accepted, rejected), checked(written, str(tmp_path / "checks"))):
        assert [sorted(r.arrival for r in part.collect()) for part in parts] == [[1, 4, 7, 8], [2, 3, 5, 6]]


def test_saved_store(spark, dec, whole, tmp_path):
    path = str(tmp_path / "store")
    parts = [dec.where(f"pmod(hash(arrival), 3) = {i}") for i in (2, 0, 1)]
    for part in parts:
        save_batch(part, path, "2026-01-01 00:00:00")
    assert rows(read_store(spark, path)) == whole
    save_batch(parts[1], path, "2026-01-02 00:00:00")
    assert rows(read_store(spark, path)) == whole


def test_saved_store_prunes(spark, dec, tmp_path):
    path = str(tmp_path / "store")
    save_batch(dec, path, "2026-01-01 00:00:00")
    found = read_store(spark, path).where("sala_key = 'plena' AND ano = 1996").select("tema")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sala_key" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(ano,1996)" in plan and "extracto" not in plan


def test_a_batch_rewrites_nothing(spark, dec, tmp_path):
    path = tmp_path / "store"
    save_batch(dec, str(path), "2026-01-01 00:00:00")
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*") if p.is_file()}
    save_batch(dec.limit(500), str(path), "2026-01-02 00:00:00")
    assert before == {p: p.stat().st_mtime_ns for p in before} and len(before) < len([p for p in path.rglob("*") if p.is_file()])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    df.collect()
    return plan_of(df)


def test_batches_are_merged_without_a_shuffle(spark, dec, whole, tmp_path):
    path = str(tmp_path / "it's a store")
    parts = [dec.where(f"pmod(hash(arrival), 5) = {i}") for i in (4, 2, 0, 1, 3)]
    for part in parts:
        save_batch(part, path, "2026-01-01 00:00:00", buckets=4)
    found = read_store(spark, path)
    assert "Exchange" not in final_plan_of(found) and rows(found) == whole
    chamber = found.where("sala_key = 'plena'")
    assert "Exchange" not in final_plan_of(chamber)
    assert rows(chamber) == [r for r in whole if r[0] == "plena"]
    assert "Exchange" not in final_plan_of(merged_by_link(found)) and rows(merged_by_link(found)) == whole
    assert "extracto" not in final_plan_of(stats_total(found))
    # A compaction into the same number, later batches on top of it, and what is covered gone.
    compact(spark, path, files_per_chamber=4)
    save_batch(parts[0], path, "2026-01-02 00:00:00", buckets=4)
    save_batch(dec.where("arrival < 0"), path, "2026-01-02 00:00:00", buckets=4)
    drop_covered(spark, path)
    again = read_store(spark, path)
    assert "Exchange" not in final_plan_of(again) and rows(again) == whole
    # A batch of another number is merged all the same.
    save_batch(parts[1], path, "2026-01-03 00:00:00", buckets=3)
    mixed = read_store(spark, path)
    assert "Exchange" in final_plan_of(mixed) and rows(mixed) == whole


def test_a_compaction_into_the_same_buckets_shuffles_nothing(spark, dec, whole, tmp_path):
    path = tmp_path / "store"
    for part in (0, 1):
        save_batch(dec.where(f"arrival % 2 = {part}"), str(path), "2026-01-01 00:00:00", buckets=4)
    compact(spark, str(path), files_per_chamber=4)
    name = committed(spark, str(path))[0][0]
    folders = list((path / "data" / f"lote={name}").glob("sala_key=*"))
    assert folders and all(len(list(f.glob("*.parquet"))) <= 4 for f in folders)
    assert rows(read_store(spark, str(path))) == whole


def test_a_copied_store_is_read_where_it_is(spark, dec, whole, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    for part in (0, 1):
        save_batch(dec.where(f"arrival % 2 = {part}"), str(first), "2026-01-01 00:00:00")
    before = read_store(spark, str(first)).count()
    shutil.copytree(first, second)
    save_batch(dec.limit(1).withColumn(KEY, F.lit("new")), str(second), "2026-01-02 00:00:00")
    assert (read_store(spark, str(first)).count(), read_store(spark, str(second)).count()) == (before, before + 1)
    assert rows(read_store(spark, str(first))) == whole


def test_compaction_changes_no_row(spark, dec, whole, tmp_path):
    path = str(tmp_path / "store")
    assert read_store_if_any(spark, path) is None
    compact(spark, path)
    for part in (0, 1):
        save_batch(dec.where(f"arrival % 2 = {part}"), path, "2026-01-01 00:00:00")
    during = read_store(spark, path)
    compact(spark, path, files_per_chamber=3)
    names, covered = committed(spark, path)
    assert (len(names), len(covered)) == (1, 2) and rows(during) == rows(read_store(spark, path)) == whole
    save_batch(dec.where("arrival % 2 = 0"), path, "2026-01-02 00:00:00")
    drop_covered(spark, path)
    assert rows(read_store(spark, path)) == whole


def test_a_batch_without_commit_is_not_seen(spark, dec, whole, tmp_path):
    path = str(tmp_path / "store")
    save_batch(dec, path, "2026-01-01 00:00:00")
    dec.limit(5).withColumn("sala_key", F.lit("plena")).write.partitionBy("sala_key").parquet(f"{path}/data/lote=broken")
    assert rows(read_store(spark, path)) == whole


def test_rows_without_a_chamber_are_rejected(spark, dec, tmp_path):
    path = str(tmp_path / "store")
    flawed = dec.withColumn("sala_key", F.when(F.col("arrival") % 3 == 0, None).when(F.col("arrival") % 3 == 1, "").otherwise("plena"))
    accepted, rejected = split_rejects(write_defaults(flawed))
    assert rejected.count() == dec.where("arrival % 3 <> 2").count()
    for _ in range(2):
        save_batch(accepted, path, "2026-01-01 00:00:00")
        assert read_store(spark, path).count() == accepted.select(KEY).distinct().count()


def test_one_link_under_two_chambers(spark, dec, tmp_path):
    path = str(tmp_path / "store")
    row = dec.limit(1)
    save_batch(row.withColumn("sala_key", F.lit("plena")), path, "2026-01-01 00:00:00")
    save_batch(row.withColumns({"sala_key": F.lit("penal"), "arrival": F.col("arrival") + 1}), path, "2026-01-01 00:00:00")
    assert read_store(spark, path).count() == 2
    assert merged_by_link(read_store(spark, path)).first().sala_key == "penal"


def test_arrivals_of_large_response_numbers(spark):
    """Numbers as those of a hundred partitions, and the last place of an array."""
    from jurisindex.operators.captured import arrival_of
    numbers = [(i << 33) + k for i in (0, 1, 64, 100, 2**29) for k in (0, 1, 2**33 - 1)]
    df = spark.createDataFrame([(n, p) for n in numbers for p in (0, 1, 2**31 - 1)], "resp_id bigint, pos int")
    for rendered in (False, True):
        both = df.withColumn("a", arrival_of("resp_id", "pos", rendered)).collect()
        assert len({r.a for r in both}) == len(both) and sorted(both, key=lambda r: r.a) == sorted(both, key=lambda r: (r.resp_id, r.pos))
    assert df.where(arrival_of("resp_id", "pos") == arrival_of("resp_id", "pos", True)).count() == 0


# --- sync and streams ----------------------------------------------------------------------


def extract(batch):
    return captured_decisions(batch, row_hosts=HOSTS, anchor_hosts=HOSTS)


def test_sync_uses_stored_rows_if_nothing_was_captured(spark, dec):
    local = upsert(None, dec)
    nothing = extract(single_responses(decisions(spark, SF)).where("false"))
    assert sync_batch(nothing, local).count() == local.count()
    captured = extract(single_responses(decisions(spark, SF).where("arrival < 5")))
    assert sync_batch(captured, local).count() == 5


def test_whole_sync(spark, dec, tmp_path):
    """Only matches are saved, a second sync adds to them, and the matrix has the whole store."""
    store, matrix = str(tmp_path / "store"), str(tmp_path / "matrix")
    captured = extract(single_responses(decisions(spark, SF)))
    run = lambda mes, kw: sync(
        captured, store, "2026-01-01 00:00:00", mes, kw, matrix, str(tmp_path / "checks")
    )
    march = captured.where("fecha LIKE '%Marzo%' AND lower(tema) LIKE '%firma%'").select(KEY).distinct().count()
    assert 0 < march == run("marzo", "Firma").where("lower(tema) LIKE '%firma%'").count()
    total = run("todo_el_ano", "").count()
    assert total == captured.select(KEY).distinct().count() > march
    written = spark.read.csv(matrix, header=True, escape='"', multiLine=True)
    assert written.count() == total
    nothing = captured.where("false")
    assert sync(nothing, store, "2026-01-02 00:00:00").count() == total


def test_stream_is_the_batch(spark, tmp_path):
    responses = single_responses(decisions(spark, SF))
    source, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    wanted = rows(upsert(None, sync_batch(extract(responses)).drop("ponente")))
    parts = list(range(4))
    random.Random(7).shuffle(parts)
    for part in parts:
        responses.where(f"pmod(hash(resp_id), 4) = {part}").coalesce(1).write.mode("append").parquet(source)

    def run():
        query = sync_stream(
            stream_responses(spark, source, files_per_trigger=1), store, progress, every=None,
            scanned_at="2026-01-01 00:00:00", extract=extract, checks=str(tmp_path / "checks"),
        )
        query.awaitTermination()
        return query

    first = run()
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 4
    assert rows(read_store(spark, store)) == wanted
    info = sync_info(first)
    assert info["activo"] is False and info["intervalo_horas"] == 24.0
    again = run()
    assert not [p for p in again.recentProgress if p["numInputRows"]]
    assert rows(read_store(spark, store)) == wanted


def test_folders_are_unique(spark):
    from jurisindex.sources.storage import new_folder

    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b and uuid.UUID(a[-32:])


def test_a_run_without_accepted_rows_is_counted(spark, dec, tmp_path):
    for name, batch, seen in (("none", dec.where("arrival < 0"), 0), ("rejected", dec.limit(7).withColumn("sala", F.lit(None).cast("string")), 7)):
        path = str(tmp_path / name)
        save_checked(write_defaults(batch), path, "2026-01-01 00:00:00")
        run = run_counts(spark, path).first()
        assert (run.capturadas, run.aceptadas, run.rechazadas, run.filas) == (seen, 0, seen, 0)
        assert read_store(spark, path).count() == 0
