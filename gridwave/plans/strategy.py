"""Fused or exploded decoding, by what the headers declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import siz_fields

#: Samples of a grid from which its code-blocks are worth a shuffle.
LARGE_GRID = 1 << 20


def choose(df: DataFrame, content: str = "content") -> str:
    """"exploded" if grids are large and fewer than four for each core, else "fused".

    One aggregate over fixed header bytes; no Python runs.
    """
    s = siz_fields(content)
    large = F.coalesce(s["x_size"] * s["y_size"], F.lit(0)) >= LARGE_GRID
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(large.cast("long")), F.lit(0)).alias("large")).first()
    return "exploded" if row.large and row.n < 4 * df.sparkSession.sparkContext.defaultParallelism else "fused"
