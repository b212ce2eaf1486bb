"""Which (chamber, year) pairs a scan covers, and which of them are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisindex.sources.dimensions import dim_sala, sala_keys


def scan_plan(spark: SparkSession, sala_key: str, ano_inicio: int, ano_fin: int) -> DataFrame:
    """Every chamber with every year from `ano_inicio` to `ano_fin`, both included."""
    years = F.sequence(F.lit(ano_inicio), F.lit(ano_fin)) if ano_inicio <= ano_fin else F.array().cast("array<int>")
    return (
        dim_sala(spark)
        .where(F.col("sala_key").isin(sala_keys(sala_key)))
        .select("sala_key", "code", "portal_id", "nombre", F.explode(years).alias("ano"))
    )


def missing_scans(plan: DataFrame, captured: DataFrame) -> DataFrame:
    """Planned pairs of which nothing was captured, by the year of the scan where the rows tell it."""
    ano = F.col("ano_escaneo" if "ano_escaneo" in captured.columns else "ano").alias("ano")
    present = captured.select("sala_key", ano).distinct()
    return plan.join(present, ["sala_key", "ano"], "left_anti")
