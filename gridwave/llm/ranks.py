"""Gapless ranks within groups that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a window ranks at once, and the most buckets besides one a group.
BUCKET_ROWS, BUCKETS = 2048, 20_000


def with_rank(df: DataFrame, total: int, group: str, order: list[str], spread: Column, name: str) -> DataFrame:
    """df with a rank from 0 within each value of group, without one task per group.

    Each group is dealt by `spread` to buckets in proportion to its rows; a window ranks
    the rows of a bucket, and the rows of the buckets before it are added. spread and the last
    of order should differ from row to row, such as a row number kept in the table; rows that
    are alike in spread share a bucket. The counts that
    are broadcast have BUCKETS rows and one a group at most; groups must come from a fixed
    set. total: the rows of df, which should be a written table.
    """
    rows = max(BUCKET_ROWS, total // BUCKETS)
    shares = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_k"))
    dealt = df.join(F.broadcast(shares), group).withColumn("_bucket", F.pmod(F.xxhash64(spread), F.col("_k")).cast("int")).drop("_k")
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(base), [group, "_bucket"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_bucket", "_in", "_base")
