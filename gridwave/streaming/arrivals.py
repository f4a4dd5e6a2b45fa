"""Structured Streaming over a folder of codestream files; decoding keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import decode

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_arrivals(spark: SparkSession, path: str, pattern: str = "*.j2k", files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(path)


def decode_arrivals(spark: SparkSession, path: str, pattern: str = "*.j2k", files_a_batch: int = 1000) -> DataFrame:
    """A stream of images, one per arriving file."""
    return decode(read_arrivals(spark, path, pattern, files_a_batch), strategy="fused")
