"""Streams of documents: standing queries, windowed counts, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.plans.compile import Model, query


def read_stream(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def standing_query(stream: DataFrame, text: str, syntax: str = "jexl", model: Model | None = None) -> DataFrame:
    """A query without group-by or unique, over a stream."""
    return query(stream, text, syntax, model)


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks want a timestamp with a zone: one without is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def ingest_rate(stream: DataFrame, time: str, kind: str, window: str, late: str) -> DataFrame:
    """Events of each kind in each window; those later than ``late`` are left out."""
    return timed(stream, time).withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("events"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    return timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
