"""Subbands and code-block grids from image sizes, by explode alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import band_size, ceil_div


def subbands(df: DataFrame, width: str, height: str, levels: int | str) -> DataFrame:
    """df with a row per subband of a tile at the origin: band_idx, res, kind, gain, band_w, band_h.

    band_idx counts LL, then HL, LH, HH of each level, coarsest first.
    """
    n = F.lit(levels) if isinstance(levels, int) else F.col(levels)
    res = df.withColumn("_nl", n.cast("int")).withColumn("res", F.explode(F.sequence(F.lit(0), F.col("_nl"))))
    kinds = F.when(F.col("res") == 0, F.array(F.lit("LL"))).otherwise(F.array(F.lit("HL"), F.lit("LH"), F.lit("HH")))
    out = res.select("*", F.posexplode(kinds).alias("_k", "kind"))
    nb = F.when(F.col("res") == 0, F.col("_nl")).otherwise(F.col("_nl") - F.col("res") + 1)
    xo, yo = F.col("kind").isin("HL", "HH").cast("int"), F.col("kind").isin("LH", "HH").cast("int")
    return (
        out.withColumn("band_idx", F.when(F.col("res") == 0, 0).otherwise(3 * F.col("res") - 2 + F.col("_k")))
        .withColumn("gain", xo + yo).withColumn("band_w", band_size(width, nb, xo)).withColumn("band_h", band_size(height, nb, yo)).drop("_k", "_nl")
    )


def block_grid(bands: DataFrame, block_w: int, block_h: int) -> DataFrame:
    """A row per code-block of each subband: block_idx, bx, by, bw, bh. Empty bands have none."""
    cols, rows = ceil_div("band_w", block_w), ceil_div("band_h", block_h)
    some = bands.where("band_w > 0 AND band_h > 0").withColumn("_cols", cols)
    some = some.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1)))
    bx, by = F.col("_c") * block_w, F.col("_r") * block_h
    return (
        some.withColumn("block_idx", F.col("_r") * F.col("_cols") + F.col("_c")).withColumn("bx", bx).withColumn("by", by)
        .withColumn("bw", F.least(F.lit(block_w).cast("long"), F.col("band_w") - bx)).withColumn("bh", F.least(F.lit(block_h).cast("long"), F.col("band_h") - by)).drop("_cols", "_r", "_c")
    )
