"""The column functions on streams: every one is a stateless map in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia import runtime
from marginalia.operators import explode_entries


def stream_entries(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Entries of files as they arrive in ``folder``, whole file by file."""
    runtime.ship(spark)
    texts = spark.readStream.format("text").option("wholetext", True).load(folder).withColumnRenamed("value", "bibtex")
    return explode_entries(texts, **options)
