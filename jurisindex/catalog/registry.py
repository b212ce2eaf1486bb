"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisindex.operators.captured import ARRIVAL_TYPE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without an oracle only its rows are looked at."""

    def plain(df: DataFrame) -> DataFrame:
        # Arrivals in the given tables fit a long.
        return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == ARRIVAL_TYPE})

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
