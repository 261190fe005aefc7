"""Database files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import ese


def stream_headers(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of headers() of each file that arrives in the folder; each file once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return ese.headers(arriving.select("path", F.col("length").alias("size"), "content"))
