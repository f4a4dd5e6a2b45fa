"""Comparing decoded grids with expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(actual: Column, expected: Column, bound: Column | float = 0.0) -> Column:
    """The first element that differs by more than the bound: struct<at, actual, expected>, null if none does.

    Arrays of different lengths differ at the end of the shorter one.
    """
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    pairs = F.transform(F.arrays_zip(actual.alias("a"), expected.alias("e")), lambda p, i: F.struct(i.alias("at"), p["a"].alias("actual"), p["e"].alias("expected")))
    off = F.filter(pairs, lambda p: F.coalesce(F.abs(p["actual"].cast("long") - p["expected"].cast("long")) > bound, F.lit(True)))
    return F.try_element_at(off, F.lit(1))


def classify(df: DataFrame, images: str = "actual", expected: str = "expected", bound: str = "max_abs_error") -> DataFrame:
    """df with `status` and `reason`: Passed, Failed or LoadError.

    images: a struct of width, height, bit_depth, signed, samples, error; expected: a struct
    of geometry and samples, null if the snapshot couldn't be read. An exception in decoding
    is a Failed row.
    """
    a, e = F.col(images), F.col(expected)
    geometry = F.concat_ws(", ", *(F.when(~a[n].eqNullSafe(e["geometry"][n]), F.lit(n)) for n in ("width", "height", "bit_depth", "signed")))
    first = compare(a["samples"], e["samples"], F.coalesce(F.col(bound).cast("double"), F.lit(0.0)))
    status = F.when(e.isNull(), "LoadError").when(a["error"].isNotNull() | (geometry != "") | first.isNotNull(), "Failed").otherwise("Passed")
    reason = F.when(e.isNull(), "no snapshot").when(a["error"].isNotNull(), F.concat(F.lit("decode: "), a["error"]["kind"])).when(geometry != "", F.concat(F.lit("geometry: "), geometry)).when(first.isNotNull(), F.concat(F.lit("sample "), first["at"].cast("string")))
    return df.withColumn("status", status).withColumn("reason", reason)


def errors(df: DataFrame, by: list[str], actual: str, expected: str) -> DataFrame:
    """Peak absolute and mean squared error per group of sample rows."""
    d = F.col(actual).cast("double") - F.col(expected).cast("double")
    return df.groupBy(*by).agg(F.max(F.abs(d)).alias("pae"), F.avg(d * d).alias("mse"), F.count(F.lit(1)).alias("samples"))


def summarize(graded: DataFrame) -> DataFrame:
    return graded.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
