"""Tables between the steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jurisindex.sources.storage import new_folder


def durable(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again.

    Later steps read files that outlive any executor, and no step is computed twice.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
