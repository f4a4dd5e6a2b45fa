"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage: when an executor is lost, later stages reread files
and do not depend on its memory or disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}
_open: ContextVar[list | None] = ContextVar("_open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may do without it (tests on one
    machine): it gets a temporary folder, where a cluster's machines would each see their own."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="gridwave-")
        atexit.register(_quiet_drop, spark, _own[key])
    return _own[key]


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended and its file systems with it
        return
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables of one operator call. They go when the program ends, when release() is called, or
    with the block of released() in which the call stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridwave/{name}-{uuid.uuid4().hex}"
        if _open.get() is not None:
            _open.get().append(self)
        atexit.register(_quiet_drop, spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Tables that nothing reads any more."""
        for name in names:
            _drop(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        _drop(self.spark, self.root)


@contextmanager
def released():
    """Operators called inside have lost their tables afterwards: write out their results before."""
    outer, own = _open.get(), []
    token = _open.set(own)
    try:
        yield
    finally:
        _open.reset(token)
        for store in own:
            store.release()
        if outer is not None:
            outer.extend(own)


def _quiet_drop(spark: SparkSession, path: str) -> None:
    try:
        _drop(spark, path)
    except Exception:  # at exit the JVM may be gone already
        return
