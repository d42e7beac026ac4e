"""Structured Streaming over binary files: the same operators, since parsing keeps no state between objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.parse import parse

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """object_id, content, modificationTime of files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(StructType.fromDDL(FILES))
    for key, value in (("pathGlobFilter", pattern), ("maxFilesPerTrigger", per_trigger)):
        reader = reader.option(key, value) if value is not None else reader
    return reader.load(path).select(F.col("path").alias("object_id"), "content", "modificationTime")


def parse_stream(objects: DataFrame, schema_text: str, **options) -> DataFrame:
    """Outcomes of a stream of objects, as parse() gives them for a table."""
    return parse(objects, schema_text, **options)


def faults_by_window(events: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by tumbling window and kind of (ts, kind) rows, late ones up to the watermark: an extension for monitoring."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
