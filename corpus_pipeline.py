"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All stages but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jurisindex.llm import containment, mixing, ordinal, sharding, simhash
from jurisindex.llm.durable import durable

SHARDS = 40


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the labels accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit(docs.select("doc_id", "text"), ordinal.graded(labels))
    return _like(docs, ordinal.scored(docs, model).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHashes (four words) link at four bits or fewer: that of the least doc_id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return containment.without_contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row and its place there."""
    return sharding.sharded_documents(docs, SHARDS).select(
        "doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: The classifier has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
