"""Lifting as window functions over tables of samples.

A signal is a partition; its samples have consecutive positions from 0. One shuffle by
the signal serves all steps of a transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codec import wavelet


def _around(value: str, by: list[str], at: str) -> tuple[Column, Column]:
    """Left and right neighbours, mirrored at the ends."""
    w = Window.partitionBy(*by).orderBy(at)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce(left, right), F.coalesce(right, left)


def _step(df: DataFrame, by: list[str], at: str, value: str, odd: bool, change) -> DataFrame:
    """value += change(left, right) at positions of one parity; a single sample stays."""
    left, right = _around(value, by, at)
    own = (F.col(at) % 2 == int(odd)) & left.isNotNull()
    return df.withColumn(value, F.when(own, F.col(value) + change(left, right)).otherwise(F.col(value)))


def inverse_53(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Undoes reversible lifting along `at`; value must be a whole number and comes back as long."""
    df = df.withColumn(value, F.col(value).cast("long"))
    df = _step(df, by, at, value, False, lambda a, b: -F.shiftright(a + b + 2, 2))
    return _step(df, by, at, value, True, lambda a, b: F.shiftright(a + b, 1))


def forward_53(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    df = df.withColumn(value, F.col(value).cast("long"))
    df = _step(df, by, at, value, True, lambda a, b: -F.shiftright(a + b, 1))
    return _step(df, by, at, value, False, lambda a, b: F.shiftright(a + b + 2, 2))


def _f32(x) -> Column:
    return F.lit(float(x)).cast("float")


def inverse_97(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Undoes irreversible lifting along `at` in single precision."""
    df = df.withColumn(value, F.col(value).cast("float"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*by)) <= 1
    k = F.when(F.col(at) % 2 == 0, _f32(wavelet.K)).otherwise(_f32(1 / wavelet.K))
    df = df.withColumn(value, F.when(alone, F.col(value)).otherwise((F.col(value) * k).cast("float")))
    for odd, c in ((False, wavelet.DELTA), (True, wavelet.GAMMA), (False, wavelet.BETA), (True, wavelet.ALPHA)):
        df = _step(df, by, at, value, odd, lambda a, b, c=c: (_f32(-c) * (a + b).cast("float")).cast("float"))
        df = df.withColumn(value, F.col(value).cast("float"))
    return df


def merge_level(bands: DataFrame, by: list[str], x: str = "x", y: str = "y", kind: str = "kind", value: str = "value") -> DataFrame:
    """One 5/3 level up: coefficients (kind, x, y) of LL, HL, LH, HH interleaved, then rows, then columns."""
    xo, yo = F.col(kind).isin("HL", "HH").cast("long"), F.col(kind).isin("LH", "HH").cast("long")
    grid = bands.select(*by, (2 * F.col(x) + xo).alias(x), (2 * F.col(y) + yo).alias(y), value)
    return inverse_53(inverse_53(grid, [*by, y], x, value), [*by, x], y, value)
