"""A graded corpus: bounds per file and component, a manifest of it, and checks of both.

The corpus has 16 streams of profile 0 and 7 of profile 1. Class 1 grades several
components of a stream, class 0 the first one at some resolutions. The files themselves
are not part of this repository; the manifest is built for those that are given.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec.features import read_features

# fixed values: peak absolute and mean squared error allowed, by class, profile and measure; a
# cell for each stream from 1 on, with a number for each graded component
BOUNDS = {
    (1, 0, "pae"): "0;0;0;5:4:6;2:2:2:0;635:403:378:0;0:0:0;0:0:0;0;0:0:0;0;0;0:0:0:0;0:0:0;0;0",
    (1, 0, "mse"): "0;0;0;0.776:0.626:1.070;0.302:0.307:0.269:0;11287:6124:3968:0;0:0:0;0:0:0;0;0:0:0;0;0;0:0:0:0;0:0:0;0;0",
    (1, 1, "pae"): "0;5:4:6;2:2:1:0;624;40:40:40;2:2:2;0:0",
    (1, 1, "mse"): "0;0.765:0.616:1.051;0.3:0.210:0.200:0;3080;8.458:9.816:10.154;0.6:0.6:0.6;0:0",
    (0, 0, "pae"): "0;0;0;33;54;109;10;7;4;10;0;0;0;0;0;0",
    (0, 0, "mse"): "0;0;0;55.8;68;743;0.34;6.72;1.47;2.84;0;0;0;0;0;0",
    (0, 1, "pae"): "0;35;28;2;128;128;0",
    (0, 1, "mse"): "0;74;18.8;0.550;16384;16384;0",
}
#: fixed values: streams (profile, number) whose class-0 references are at these resolutions
RESOLUTIONS = {(0, 3): ["r0", "r1"], (0, 15): ["r0", "r1"], (1, 4): ["r0", "r3"]}
ENTRIES = 23

FEATURES = (
    "struct<width:bigint,height:bigint,components:int,subsampling:array<array<int>>,precision:array<int>,signed:array<boolean>,tiles:array<bigint>,"
    "progression:string,layers:int,mct:int,resolutions:int,code_block:array<int>,reversible:boolean>"
)


def conformance_bounds(spark: SparkSession) -> DataFrame:
    """(profile, index, class, measure, bounds): one row a cell, the bounds by component."""
    cells = spark.createDataFrame([(p, c, m, text) for (c, p, m), text in BOUNDS.items()], "profile int, class int, measure string, cells string")
    each = cells.select("profile", "class", "measure", F.posexplode(F.split("cells", ";")).alias("at", "cell"))
    return each.select("profile", (F.col("at") + 1).alias("index"), "class", "measure", F.split("cell", ":").cast("array<double>").alias("bounds"))


def stream_features(files: DataFrame, content: str = "content") -> DataFrame:
    """The other columns with `features`, null where the main header can't be read, and `unreadable`."""
    names = [c for c in files.columns if c not in (content, "features", "unreadable")]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema if f.name in names)
    # headers are short; the rest of a file never goes to Python
    heads = files.select(*names, F.substring(content, 1, 1 << 16).alias("_head"))
    kind = pa.struct([
        ("width", pa.int64()), ("height", pa.int64()), ("components", pa.int32()), ("subsampling", pa.list_(pa.list_(pa.int32()))), ("precision", pa.list_(pa.int32())), ("signed", pa.list_(pa.bool_())),
        ("tiles", pa.list_(pa.int64())), ("progression", pa.string()), ("layers", pa.int32()), ("mct", pa.int32()), ("resolutions", pa.int32()), ("code_block", pa.list_(pa.int32())), ("reversible", pa.bool_()),
    ])

    def run(batches):
        for b in batches:
            found, why = [], []
            for head in b.column(len(names)).to_pylist():
                try:
                    found.append(read_features(head or b""))
                    why.append(None)
                except ValueError as e:
                    found.append(None)
                    why.append(str(e))
            yield pa.RecordBatch.from_pydict({n: b.column(i) for i, n in enumerate(names)} | {"features": pa.array(found, kind), "unreadable": pa.array(why, pa.string())})

    return heads.mapInArrow(run, f"{kept}features {FEATURES}, unreadable string")


def conformance_manifest(files: DataFrame, bounds: DataFrame) -> DataFrame:
    """An entry for each stream that has bounds and a file.

    files: profile, index and content. graded_components is the number of class-1 bounds;
    bit_exact says that all of them are 0, whatever the wavelet. References follow the
    corpus' naming: one a graded component for class 1, the first component for class 0.
    """
    of = lambda c, m: F.max(F.when((F.col("class") == c) & (F.col("measure") == m), F.col("bounds")))
    wide = bounds.groupBy("profile", "index").agg(of(1, "pae").alias("pae1"), of(1, "mse").alias("mse1"), of(0, "pae").alias("pae0"), of(0, "mse").alias("mse0"))
    number = F.concat(F.lit("p"), F.col("profile").cast("string"), F.lit("_"), F.lpad(F.col("index").cast("string"), 2, "0"))
    class1 = F.transform(F.sequence(F.lit(0), F.size("pae1") - 1), lambda k: F.concat(F.lit("references/c1"), number, F.lit("_"), k.cast("string"), F.lit(".pgx")))
    at = F.array(F.lit(""))
    for (p, i), names in RESOLUTIONS.items():
        at = F.when((F.col("profile") == p) & (F.col("index") == i), F.array(*map(F.lit, names))).otherwise(at)
    class0 = F.transform(at, lambda r: F.concat(F.lit("references/c0"), number, r, F.lit(".pgx")))
    zero = lambda a: F.forall(a, lambda x: x == 0)
    return stream_features(files.select("profile", "index", "content")).join(wide, ["profile", "index"]).select(
        F.concat(F.lit("codestreams/"), number, F.lit(".j2k")).alias("codestream"), "profile", "index", F.size("pae1").alias("graded_components"), (zero("pae1") & zero("mse1")).alias("bit_exact"), "features",
        F.struct(class0.alias("class0"), class1.alias("class1")).alias("references"), F.struct(F.col("pae1").alias("pae"), F.col("mse1").alias("mse")).alias("bounds_class1"),
        F.struct(F.col("pae0").alias("pae"), F.col("mse0").alias("mse")).alias("bounds_class0_first_component"),
    )


def check_entries(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(codestream, faults): the names of the rules that an entry breaks, in this order.

    files: path, as the manifest names it, and content. codestream: no file that begins with
    SOC. features: the header couldn't be read. graded: no graded component, or more than
    there are. class1: not one reference a graded component. class0: no reference.
    reference: one without a file that begins as PGX. pae, mse: not one bound a graded
    component. bit_exact: says something else than the bounds.
    """
    heads = files.select("path", F.hex(F.substring("content", 1, 2)).alias("head"))
    named = manifest.select("codestream", F.explode(F.concat("references.class1", "references.class0")).alias("path"))
    bad = named.join(heads, "path", "left").groupBy("codestream").agg(F.max(F.coalesce(F.col("head") != "5047", F.lit(True))).alias("_bad"))
    own = heads.select(F.col("path").alias("codestream"), (F.col("head") == "FF4F").alias("_soc"))
    n, b = F.col("graded_components"), F.col("bounds_class1")
    size = lambda a: F.coalesce(F.size(a), F.lit(-1))
    whole = F.concat(b["pae"], b["mse"])
    rules = {
        "codestream": ~F.coalesce(F.col("_soc"), F.lit(False)), "features": F.col("features").isNull(), "graded": F.coalesce((n < 1) | (n > F.col("features.components")), F.lit(True)) & F.col("features").isNotNull(),
        "class1": size("references.class1") != n, "class0": size("references.class0") < 1, "reference": F.coalesce(F.col("_bad"), F.lit(False)), "pae": size(b["pae"]) != n, "mse": size(b["mse"]) != n,
        "bit_exact": ~F.col("bit_exact").eqNullSafe(F.forall(whole, lambda x: x == 0)),
    }
    found = F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())
    return manifest.join(own, "codestream", "left").join(bad, "codestream", "left").select("codestream", found.alias("faults"))


def corpus_consistent(manifest: DataFrame, files: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """One row: entries, those with faults, and whether there are as many as asked for and none has any."""
    c = check_entries(manifest, files).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum((F.size("faults") > 0).cast("long")), F.lit(0)).alias("faulty"))
    return c.withColumn("consistent", (F.col("entries") == entries) & (F.col("faulty") == 0))
