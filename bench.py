"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The decisions and payloads that the queries read are derived from the given tables and written to
files once, outside the timings ("prepare").  Each query then runs over the whole of them, once
to warm up and $BENCH_RUNS times (3) for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisindex.catalog import fixture
from jurisindex.functions import predicates as P
from jurisindex.operators import search, stats
from jurisindex.operators.anchors import anchor_context
from jurisindex.operators.export import export_matrix
from jurisindex.operators.fallback import first_non_empty
from jurisindex.operators.html_items import html_decisions
from jurisindex.operators.json_items import json_decisions
from jurisindex.operators.pages import decision_sections, page_decisions, page_links
from jurisindex.operators.saved_store import read_store, save_batch
from jurisindex.operators.upsert import upsert, write_defaults, split_rejects
from jurisindex.plans.sync import captured_decisions, sync_batch
from jurisindex.sources.captures import stream_responses
from jurisindex.sources.storage import new_folder
from jurisindex.streaming.stream import sync_stream

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
STAMP = "2026-01-01 00:00:00"
HOSTS = fixture.HOSTS


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("jurisindex-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> dict[str, DataFrame]:
    """Written inputs of the queries, spread over all cores."""
    folder = new_folder(spark, "bench")
    parts = 2 * int(CPUS)

    def written(name: str, df: DataFrame) -> DataFrame:
        df.repartition(parts).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    dec = written("dec", fixture.decisions(spark, SF_DIR))
    save_batch(dec.drop("ponente"), f"{folder}/store", STAMP)
    return {
        "dec": dec,
        "store": read_store(spark, f"{folder}/store"),
        "json": written("json", fixture.json_responses(dec)),
        "rows": written("rows", fixture.row_responses(dec)),
        "anchors": written("anchors", fixture.anchor_responses(dec)),
        "singles": written("singles", fixture.single_responses(dec)),
        "court": written("court", fixture.decision_pages(dec)),
        "pages": written("pages", fixture.table(spark, SF_DIR, "pages")),
    }


def run_all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(spark: SparkSession, t: dict[str, DataFrame]) -> dict:
    dec, store = t["dec"], t["store"]
    versions = dec.drop("ponente")
    narrow = upsert(None, versions)
    extract = lambda batch: captured_decisions(batch, row_hosts=HOSTS, anchor_hosts=HOSTS)

    def saved() -> None:
        save_batch(versions, new_folder(spark, "bench-store"), STAMP)

    def streamed() -> None:
        files = len(t["singles"].inputFiles())
        sync_stream(
            stream_responses(spark, t["singles"].inputFiles()[0].rsplit("/", 1)[0], files_per_trigger=-(-files // 2)),
            new_folder(spark, "bench-store"), new_folder(spark, "bench-progress"), every=None,
            scanned_at=STAMP, extract=extract,
        ).awaitTermination()

    long_text = F.concat_ws(" ", "tema", "extracto")
    return {
        "upsert": lambda: run_all(narrow),
        "stats_of_upsert": lambda: run_all(stats.stats_all(narrow)),
        "save_batch": saved,
        "save_rejects": lambda: run_all(split_rejects(write_defaults(versions))[1]),
        "stats_all": lambda: run_all(stats.stats_all(store)),
        "store_stats": lambda: run_all(stats.store_stats(store)),
        "store_scan": lambda: run_all(search.newest_first(store)),
        "search4": lambda: run_all(search.search4(dec, "electrónica")),
        "search6": lambda: run_all(search.search6(dec, "electrónica")),
        "search6_folded": lambda: run_all(search.search6_folded(dec, "electronica")),
        "search6_prepared": lambda: run_all(search.search6_folded(store, "electronica")),
        "store_search": lambda: run_all(search.store_search(store, "firma", "penal", 1996)),
        "faceted_search_folded": lambda: run_all(
            search.faceted_search(dec, "casacion_penal", "marzo", "electronica", folded=True)
        ),
        "tech_filter": lambda: run_all(search.tech_filter(dec.withColumn("texto_completo", long_text))),
        "export_matrix": lambda: run_all(export_matrix(store)),
        "json_decisions": lambda: run_all(json_decisions(t["json"])),
        "html_row_decisions": lambda: run_all(html_decisions(t["rows"], HOSTS, HOSTS)),
        "html_anchor_decisions": lambda: run_all(html_decisions(t["anchors"], HOSTS, HOSTS)),
        "anchor_context": lambda: run_all(anchor_context(t["anchors"], HOSTS)),
        "page_decisions": lambda: run_all(page_decisions(t["pages"], "hoy")),
        "page_decisions_court": lambda: run_all(page_decisions(t["court"], "hoy")),
        "page_links": lambda: run_all(page_links(t["pages"], suffix=None)),
        "decision_sections": lambda: run_all(
            decision_sections(dec.select("arrival", F.col("extracto").alias("texto_completo")))
        ),
        "prepared_column": lambda: run_all(dec.select("arrival", P.folded_fields().alias("buscable"))),
        "fallback_chain": lambda: run_all(first_non_empty([dec.where("ano > 2050"), dec])),
        "sync": lambda: run_all(upsert(None, split_rejects(sync_batch(extract(t["singles"])))[0].drop("ponente"))),
        "stream_upsert": streamed,
    }


def main() -> None:
    spark = session()
    start = time.time()
    tables = prepare(spark)
    prepared = time.time() - start
    wanted = sys.argv[1:]
    seconds = {}
    for name, run in headline(spark, tables).items():
        if wanted and name not in wanted:
            continue
        run()
        times = []
        for _ in range(RUNS):
            start = time.time()
            run()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of the queries' median times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "prepare": round(prepared, 1),
        "sf": SF_DIR.rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "decisions": tables["dec"].count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
