"""JPEG 2000 codestreams inside GRIB2 files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, message_index int, content binary, error string"


def split_messages(data: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of the GRIB edition 2 messages; other bytes between them are passed over."""
    at = data.find(b"GRIB")
    while at >= 0:
        size = int.from_bytes(data[at + 8 : at + 16])
        if at + 16 <= len(data) and data[at + 7] == 2 and 16 <= size <= len(data) - at:
            yield at, at + size
            at = data.find(b"GRIB", at + size)
        else:
            at = data.find(b"GRIB", at + 4)


def data_section(message: bytes) -> bytes:
    """The body of section 7, which must be a codestream from SOC to EOC; ValueError otherwise."""
    at = 16
    while at + 5 <= len(message) and message[at : at + 4] != b"7777":
        size = int.from_bytes(message[at : at + 4])
        if size < 5 or at + size > len(message):
            raise ValueError("section length")
        if message[at + 4] == 7:
            body = message[at + 5 : at + size]
            if body[:2] != b"\xff\x4f" or body[-2:] != b"\xff\xd9":
                raise ValueError("section 7 is not a JPEG 2000 codestream")
            return body
        at += size
    raise ValueError("no section 7")


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    for i, (a, b) in enumerate(split_messages(data)):
        try:
            yield path, i, data_section(data[a:b]), None
        except ValueError as e:
            yield path, i, None, str(e)


def grib2_codestreams(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """A row per message of files in a binary column: path, message_index, content, error."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(_rows(name, data or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.string()))], names=["path", "message_index", "content", "error"])

    return files.select(path, content).mapInArrow(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from _rows(partition.path, f.read())


class Grib2Codestreams(DataSource):
    """spark.read.format("grib2_jpeg").load(path): files on a path that every executor mounts.

    Elsewhere use grib2_codestreams over Spark's binaryFile.
    """

    @classmethod
    def name(cls) -> str:
        return "grib2_jpeg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"].removeprefix("file:")
        return _Reader(sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Grib2Codestreams)
