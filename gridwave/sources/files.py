"""Codestream files, alone or next to their expected snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import read_snapshots


def read_codestreams(spark: SparkSession, path: str, pattern: str = "*.j2k") -> DataFrame:
    """path, modificationTime, length and content of matching files; content is not read unless used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a local master may do without that setting:
    on several machines each would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="gridwave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> None:
    """A few small files, through Spark's file system."""
    for name, data in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()


def stem(path: str = "path", suffix: str = r"\.j2k$"):
    """The file's name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), suffix, "")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """name, content and the snapshot of the same name, by name; a file without a readable one keeps a null."""
    files = read_codestreams(spark, path).select(stem().alias("name"), "content")
    return files.join(read_snapshots(spark, path), "name", "left").orderBy("name")
