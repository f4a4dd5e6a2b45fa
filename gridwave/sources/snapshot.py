"""Snapshots of expected grids as JSON: geometry, tolerance, samples, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = (
    "geometry struct<width:bigint,height:bigint,bit_depth:int,signed:boolean>, tolerance struct<mode:string,max_abs_error:double>, "
    "samples array<int>, provenance struct<source:string,oracle_command:string,notes:string>"
)
_KEYS = {
    "$": ["geometry", "provenance", "samples", "tolerance"],
    "$.geometry": ["bit_depth", "height", "signed", "width"],
    "$.tolerance": ["max_abs_error", "mode"],
    "$.provenance": ["notes", "oracle_command", "source"],
}


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """name, expected and max_abs_error of each *.expected.json file.

    expected is null where the file is not strict: unknown keys, missing parts, or a number
    of samples other than width times height.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.expected.json").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "UTF-8")
    rows = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.expected\.json$", "").alias("name"), text.alias("_t"), F.from_json(text, SNAPSHOT).alias("e"))
    strict = F.lit(True)
    for at, known in _KEYS.items():
        part = F.get_json_object("_t", at)
        strict &= F.size(F.array_except(F.coalesce(F.json_object_keys(part), F.array()), F.array(*map(F.lit, known)))) == 0
    e = F.col("e")
    whole = e["geometry"].isNotNull() & e["tolerance"]["mode"].isin("exact", "absolute") & e["provenance"].isNotNull() & (F.size(e["samples"]) == e["geometry"]["width"] * e["geometry"]["height"])
    ok = F.coalesce(strict & whole, F.lit(False))
    bound = F.when(e["tolerance"]["mode"] == "absolute", e["tolerance"]["max_abs_error"]).otherwise(F.lit(0.0))
    return rows.select("name", F.when(ok, e).alias("expected"), F.when(ok, bound).alias("max_abs_error"))


def to_snapshots(images: DataFrame, source: str, command: str) -> DataFrame:
    """name and json of decoded images, one exact snapshot each."""
    geometry = F.struct(*(F.col(c) for c in ("width", "height", "bit_depth", "signed")))
    body = F.struct(
        geometry.alias("geometry"), F.struct(F.lit("exact").alias("mode")).alias("tolerance"), F.col("samples"),
        F.struct(F.lit(source).alias("source"), F.lit(command).alias("oracle_command")).alias("provenance"),
    )
    return images.where("error IS NULL").select("name", F.to_json(body).alias("json"))
