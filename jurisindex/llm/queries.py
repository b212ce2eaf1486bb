"""The registered queries of this package: the operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from jurisindex.catalog.registry import Query
from jurisindex.llm import (
    alignment, circulant, containment, lines, mixing, ordinal, periodic, rules, sharding, simhash, substring, tokens, urls,
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its name; without an oracle its tests hold it against brute force."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf, "documents"), 40).drop("source")


@query()
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_report(table(spark, sf, "documents"))


@query(rules.ORACLE)
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_report(table(spark, sf, "documents"))


@query(urls.ORACLE)
def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.url_report(table(spark, sf, "pages"))


@query(lines.ORACLE)
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_report(table(spark, sf, "documents"))


@query()
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_report(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query()
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf, "documents"))


@query(substring.ORACLE)
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.substring_report(table(spark, sf, "documents"))


@query(containment.ORACLE)
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return containment.containment_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return ordinal.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.periodic_report(table(spark, sf, "documents"))


@query()
def op12_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return circulant.minhash_report(table(spark, sf, "documents"))


@query()
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignments(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
