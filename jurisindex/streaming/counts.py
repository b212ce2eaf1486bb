"""Counts that follow the store while it grows, as a streaming query.

A micro-batch compares the last version of each of its links with the one that counted so far.  A later version takes
the count of the earlier one back, so the sums of all changes are at any time the counts of the store, which keeps one
row for each chamber and link; the store itself is never read.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jurisindex.operators.captured import ARRIVAL_TYPE

COUNTS = "sala_key string, sala string, ano int, n bigint"
VERSION = f"struct<arrival:{ARRIVAL_TYPE},sala:string,ano:int>"
# Spark leaves folders with an underscore out when it reads the changes.
VERSIONS = "_versiones"


def later_versions(accepted: DataFrame, counted: DataFrame | None) -> DataFrame:
    """(sala_key, link_directo, ahora, antes): links of `accepted` whose last version is later than that in `counted`.

    Rows come in any order and any number of times: the greatest arrival of a link is its current version, and earlier
    or equal ones change nothing.  `counted` are such rows of earlier batches.  Rows are combined in their tasks.
    """
    arrived = accepted.select(
        "sala_key", "link_directo", F.lit(None).cast(VERSION).alias("antes"),
        F.struct(F.col("arrival").cast(ARRIVAL_TYPE).alias("arrival"), "sala", "ano").cast(VERSION).alias("ahora"),
    )
    if counted is not None:
        arrived = arrived.unionByName(counted.select(
            "sala_key", "link_directo", F.col("ahora").alias("antes"), F.lit(None).cast(VERSION).alias("ahora")))
    versions = arrived.groupBy("sala_key", "link_directo").agg(F.max("ahora").alias("ahora"), F.max("antes").alias("antes"))
    return versions.where("ahora IS NOT NULL AND (antes IS NULL OR ahora.arrival > antes.arrival)")


def changes(versions: DataFrame) -> DataFrame:
    """(sala_key, sala, ano, n) of later versions: +1 for what a link counts for now, -1 for before."""
    signed = lambda version, n: F.struct(version["sala"].alias("sala"), version["ano"].alias("ano"), F.lit(n).alias("cambio"))
    ahora, antes = F.col("ahora"), F.col("antes")
    both = F.when(antes.isNull(), F.array(signed(ahora, 1))).otherwise(F.array(signed(ahora, 1), signed(antes, -1)))
    rows = versions.select("sala_key", F.explode(both).alias("c")).select("sala_key", "c.*")
    return rows.groupBy("sala_key", "sala", "ano").agg(F.sum("cambio").alias("n")).where("n <> 0")


def follow_store(accepted: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Keep the counts of the store that a stream of accepted rows makes, below `path`.

    A micro-batch adds the versions it brought, without texts, and one small folder, named by its number, with a row
    for each chamber and year it changes; a batch that is delivered again replaces its own.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/{VERSIONS}"
        schema = f"sala_key string, link_directo string, ahora {VERSION}, antes {VERSION}"
        earlier = [f"{folder}/tanda={i}" for i in range(batch_id)]
        counted = spark.read.schema(schema).parquet(*earlier) if earlier else None
        later_versions(batch, counted).write.mode("overwrite").parquet(f"{folder}/tanda={batch_id}")
        changed = changes(spark.read.schema(schema).parquet(f"{folder}/tanda={batch_id}"))
        changed.coalesce(1).write.mode("overwrite").parquet(f"{path}/tanda={batch_id}")

    writer = accepted.select("sala_key", "link_directo", "arrival", "sala", "ano").writeStream.foreachBatch(publish)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def followed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sala_key, sala, ano, n) of the store now; no rows before the first micro-batch."""
    try:
        changes = spark.read.schema(COUNTS).parquet(path).select("sala_key", "sala", "ano", "n")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTS)
    return changes.groupBy("sala_key", "sala", "ano").agg(F.sum("n").alias("n")).where("n <> 0")
