"""Registered queries of the codec: (spark, sf_dir) -> DataFrame, with DuckDB SQL.

Three kinds of SQL stand beside them: the same arithmetic over the same table columns;
published vectors written out; and, for lossless round trips, the source table itself.
Queries over published vectors do not read sf_dir.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import blocks, grid, mq, vectors
from .codec.bits import BitReader, TagTree, read_passes
from .functions import bit_planes, ceil_div, component_size, dequantized, geometry_fault, level_shift, mirror, sample_at, siz_fields, subband_step, unpack_step
from .operators import block_grid, code_blocks, compare, decode, errors, forward_53, images_to_samples, inverse_53, inverse_97, merge_level, subbands, with_headers
from .operators.grading import classify
from .sources.conformance import BOUNDS, check_entries, conformance_bounds, conformance_manifest
from .sources.files import read_fixtures, shared_folder, write_files
from .sources.pgx import pgm_images, to_pgm
from .sources.snapshot import read_snapshots, to_snapshots

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows, names: str) -> str:
    """Rows written out as SQL."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


# geometry and steps over table columns


@_query("""
SELECT l_orderkey, l_linenumber, CAST(ceil((l_partkey - 1000) / CAST(l_linenumber + 1 AS DOUBLE)) AS BIGINT) AS up,
  CAST(greatest(ceil(l_partkey / CAST(l_linenumber AS DOUBLE)) - ceil(l_suppkey / CAST(l_linenumber AS DOUBLE)), 0) AS BIGINT) AS size
FROM lineitem""")
def ceil_div_geometry(spark, sf_dir):
    """Rounded-up division and component sizes, negative numerators too."""
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", ceil_div(F.col("l_partkey") - 1000, F.col("l_linenumber") + 1).alias("up"), component_size("l_partkey", "l_suppkey", "l_linenumber").alias("size"))


def _sized(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7 + 3).alias("w"), (F.col("p_partkey") % 97 + 1).alias("h"))


_BANDS = """
WITH p AS (SELECT p_partkey, p_size * 7 + 3 AS w, p_partkey % 97 + 1 AS h FROM part),
k AS (SELECT r AS res, kind, xo, yo, CASE WHEN r = 0 THEN 3 ELSE 4 - r END AS nb, CASE WHEN r = 0 THEN 0 ELSE 3 * r - 2 + n END AS band_idx
      FROM range(0, 4) AS t(r), (VALUES ('LL', 0, 0, 0), ('HL', 1, 0, 0), ('LH', 0, 1, 1), ('HH', 1, 1, 2)) AS b(kind, xo, yo, n) WHERE (r = 0) = (kind = 'LL')),
b AS (SELECT p_partkey, band_idx, res, kind, xo + yo AS gain,
  CAST(greatest(ceil((w - CASE WHEN xo = 1 THEN pow(2, nb - 1) ELSE 0 END) / pow(2, nb)), 0) AS BIGINT) AS band_w,
  CAST(greatest(ceil((h - CASE WHEN yo = 1 THEN pow(2, nb - 1) ELSE 0 END) / pow(2, nb)), 0) AS BIGINT) AS band_h FROM p, k)
"""


@_query(_BANDS + "SELECT p_partkey, CAST(band_idx AS INTEGER) AS band_idx, CAST(res AS INTEGER) AS res, kind, gain, band_w, band_h FROM b")
def subband_geometry(spark, sf_dir):
    """All subbands of three levels for image sizes from `part`."""
    return subbands(_sized(spark, sf_dir), "w", "h", 3).select("p_partkey", "band_idx", "res", "kind", "gain", "band_w", "band_h")


@_query(_BANDS + """
SELECT p_partkey, CAST(band_idx AS INTEGER) AS band_idx, r * c_n + c AS block_idx, c * 16 AS bx, r * 16 AS by_, least(16, band_w - c * 16) AS bw, least(16, band_h - r * 16) AS bh
FROM (SELECT *, (band_w + 15) // 16 AS c_n, unnest(range(0, (band_w + 15) // 16)) AS c FROM b WHERE band_w > 0 AND band_h > 0) x, LATERAL (SELECT unnest(range(0, (x.band_h + 15) // 16)) AS r) y""")
def code_block_grid(spark, sf_dir):
    """All 16 x 16 code-blocks of those subbands."""
    g = block_grid(subbands(_sized(spark, sf_dir), "w", "h", 3), 16, 16)
    return g.select("p_partkey", "band_idx", "block_idx", "bx", F.col("by").alias("by_"), "bw", "bh")


def _siz_bytes(t: DataFrame) -> DataFrame:
    """A SIZ segment behind SOC from table columns."""
    u32 = lambda c: F.lpad(F.hex(c), 8, "0")
    body = F.concat(
        F.lit("ff4fff5100290000"), u32(F.col("l_partkey") % 5000), u32(F.col("l_suppkey") % 70), F.lit("0" * 14), F.lpad(F.hex(F.col("l_linenumber") % 2), 2, "0"),
        u32(F.col("l_orderkey") % 6000), u32(F.lit(64)), F.lit("0" * 16), F.lpad(F.hex((F.col("l_orderkey") % 3)), 4, "0"), F.lpad(F.hex(F.col("l_linenumber") + 127), 2, "0"), F.lit("0101"),
    )
    return t.select("l_orderkey", "l_linenumber", F.unhex(body).alias("content"))


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey % 5000 AS x_size, l_suppkey % 70 AS y_size, CAST(l_linenumber % 2 AS BIGINT) AS y_off, l_orderkey % 6000 AS tile_w,
  l_orderkey % 3 AS components, CAST((l_linenumber + 127) % 128 + 1 AS INTEGER) AS bit_depth, l_linenumber + 127 >= 128 AS signed FROM lineitem""")
def siz_native_parse(spark, sf_dir):
    """SIZ fields by fixed offsets out of bytes built from table columns."""
    t = _siz_bytes(_table(spark, sf_dir, "lineitem")).withColumn("s", siz_fields("content"))
    return t.select("l_orderkey", "l_linenumber", *(F.col(f"s.{n}").alias(n) for n in ("x_size", "y_size", "y_off", "tile_w", "components", "bit_depth", "signed")))


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'Marker' WHEN l_orderkey % 3 <> 1 THEN 'Unsupported' WHEN l_partkey % 5000 = 0 OR l_suppkey % 70 = 0 THEN 'Marker'
  WHEN l_linenumber % 2 <> 0 THEN 'Unsupported' WHEN l_orderkey % 6000 = 0 THEN 'Marker' WHEN l_orderkey % 6000 < l_partkey % 5000 OR 64 < l_suppkey % 70 THEN 'Unsupported' END AS fault FROM lineitem""")
def geometry_validation(spark, sf_dir):
    """The first rule of the SIZ checks that each row breaks."""
    t = _siz_bytes(_table(spark, sf_dir, "lineitem"))
    return t.select("l_orderkey", "l_linenumber", geometry_fault(siz_fields("content")).alias("fault"))


@_query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 256) >> 3 ELSE ((l_partkey * 37 % 65536) >> 11) & 31 END AS INTEGER) AS exp,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE (l_partkey * 37 % 65536) & 2047 END AS INTEGER) AS mant FROM lineitem""")
def qcd_unpack(spark, sf_dir):
    """Exponents and mantissas of QCD entries in both layouts."""
    even = F.col("l_linenumber") % 2 == 0
    v = F.when(even, F.col("l_partkey") % 256).otherwise(F.col("l_partkey") * 37 % 65536)
    s = unpack_step(v, F.when(even, "none").otherwise("expounded"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s["exp"].alias("exp"), s["mant"].alias("mant"))


def _qcd(t: DataFrame) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(((F.col("l_partkey") + i) % 32).cast("int").alias("exp"), ((F.col("l_suppkey") * 7 + i) % 2048).cast("int").alias("mant")))
    style = F.when(F.col("l_linenumber") % 2 == 0, "derived").otherwise("expounded")
    return t.withColumn("qcd", F.struct(style.alias("style"), (F.col("l_linenumber") % 8).cast("int").alias("guard_bits"), steps.alias("steps"))).withColumn("band", (F.col("l_orderkey") % 6).cast("int"))


@_query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN greatest(l_partkey % 32 - greatest(b - 1, 0) // 3, 0) WHEN b < 4 THEN (l_partkey + b) % 32 END AS INTEGER) AS exp,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey * 7 % 2048 WHEN b < 4 THEN (l_suppkey * 7 + b) % 2048 END AS INTEGER) AS mant
FROM (SELECT *, l_orderkey % 6 AS b FROM lineitem)""")
def subband_steps(spark, sf_dir):
    """The step that a QCD gives each band, derived or looked up; null past the table."""
    t = _qcd(_table(spark, sf_dir, "lineitem"))
    s = subband_step("qcd", "band")
    return t.select("l_orderkey", "l_linenumber", s["exp"].alias("exp"), s["mant"].alias("mant"))


@_query("SELECT l_orderkey, l_linenumber, CAST(greatest(l_linenumber % 8 + l_partkey % 32 - 1, 0) AS INTEGER) AS mb FROM lineitem")
def bitplane_count(spark, sf_dir):
    """Magnitude bit-planes from guard bits and exponent."""
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", bit_planes(F.col("l_linenumber") % 8, F.col("l_partkey") % 32).cast("int").alias("mb"))


@_query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN q = 0 THEN 0 ELSE sign(q) * (abs(q) + 0.5) * (1 + (l_partkey % 2048) / 2048.0::DOUBLE) * pow(2.0::DOUBLE, 13 + l_linenumber % 3 - l_suppkey % 16) END AS DOUBLE) AS v
FROM (SELECT *, CAST(l_quantity AS BIGINT) - 25 AS q FROM lineitem)""")
def dequantize_mid_point(spark, sf_dir):
    """Mid-point dequantization; the values are exact in single precision."""
    t = _table(spark, sf_dir, "lineitem")
    v = dequantized(F.col("l_quantity").cast("long") - 25, F.lit(13), F.col("l_linenumber") % 3, F.col("l_suppkey") % 16, F.col("l_partkey") % 2048)
    return t.select("l_orderkey", "l_linenumber", v.cast("double").alias("v"))


# lifting


def _signal(spark, sf_dir):
    w = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i"
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", w, "CAST(l_quantity AS BIGINT) AS v")


_SIGNAL = "s0 AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) AS v FROM lineitem)"


def _lift_sql(name: str, source: str, by: str, at: str, odd: int, change: str, value: str = "v", keep: str = "") -> str:
    """One lifting step; a and b are the mirrored neighbours."""
    w = f"OVER (PARTITION BY {by} ORDER BY {at})"
    inner = f"SELECT *, coalesce(lag({value}) {w}, lead({value}) {w}) AS a, coalesce(lead({value}) {w}, lag({value}) {w}) AS b FROM {source}"
    return f"{name} AS (SELECT {by}, {at}{keep}, CASE WHEN {at} % 2 = {odd} AND a IS NOT NULL THEN {value} + {change} ELSE {value} END AS {value} FROM ({inner}))"


@_query(f"WITH {_SIGNAL}, {_lift_sql('s1', 's0', 'l_orderkey', 'i', 0, '-((a + b + 2) >> 2)')}, {_lift_sql('s2', 's1', 'l_orderkey', 'i', 1, '((a + b) >> 1)')} SELECT l_orderkey, i, v FROM s2")
def idwt53_1d(spark, sf_dir):
    """Each order's quantities taken as coefficients and lifted back."""
    return inverse_53(_signal(spark, sf_dir), ["l_orderkey"], "i", "v").select("l_orderkey", F.col("i").cast("long").alias("i"), "v")


@_query(f"WITH {_SIGNAL}, {_lift_sql('s1', 's0', 'l_orderkey', 'i', 1, '-((a + b) >> 1)')}, {_lift_sql('s2', 's1', 'l_orderkey', 'i', 0, '((a + b + 2) >> 2)')} SELECT l_orderkey, i, v FROM s2")
def fdwt53_1d(spark, sf_dir):
    """Each order's quantities, forward."""
    return forward_53(_signal(spark, sf_dir), ["l_orderkey"], "i", "v").select("l_orderkey", F.col("i").cast("long").alias("i"), "v")


@_query(f"WITH {_SIGNAL} SELECT l_orderkey, i, v FROM s0")
def lifting_round_trip(spark, sf_dir):
    """Forward and back gives the table again."""
    there = forward_53(_signal(spark, sf_dir), ["l_orderkey"], "i", "v")
    return inverse_53(there, ["l_orderkey"], "i", "v").select("l_orderkey", F.col("i").cast("long").alias("i"), "v")


def _f97(name, source, odd, c):
    return _lift_sql(name, source, "l_orderkey", "i", odd, f"CAST(CAST({c} AS FLOAT) * CAST(a + b AS FLOAT) AS FLOAT)")


@_query(f"""
WITH {_SIGNAL},
k AS (SELECT l_orderkey, i, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) <= 1 THEN CAST(v AS FLOAT) ELSE CAST(CAST(v AS FLOAT) * CASE WHEN i % 2 = 0 THEN CAST(1.2301741 AS FLOAT) ELSE CAST(0.8128931 AS FLOAT) END AS FLOAT) END AS v FROM s0),
{_f97('a1', 'k', 0, '-0.44350685')}, {_f97('a2', 'a1', 1, '-0.8829111')}, {_f97('a3', 'a2', 0, '0.05298012')}, {_f97('a4', 'a3', 1, '1.5861343')}
SELECT l_orderkey, i, CAST(round(v) AS BIGINT) AS v FROM a4""")
def idwt97_1d(spark, sf_dir):
    """Irreversible lifting in single precision, rounded."""
    return inverse_97(_signal(spark, sf_dir), ["l_orderkey"], "i", "v").select("l_orderkey", F.col("i").cast("long").alias("i"), F.round("v").cast("long").alias("v"))


def _tiles(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 64
    return e.select(
        F.floor(F.col("event_id") / 64).alias("g"), F.element_at(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), (F.floor(k / 16) + 1).cast("int")).alias("kind"),
        (k % 4).alias("x"), F.floor(k / 4 % 4).cast("long").alias("y"), F.floor(F.col("value") * 10).cast("long").alias("value"),
    )


_TILE_BASE = """
t AS (SELECT event_id // 64 AS g, event_id % 64 // 16 AS k, event_id % 64 % 4 AS x0, event_id % 64 // 4 % 4 AS y0, CAST(floor(value * 10) AS BIGINT) AS v FROM events),
g0 AS (SELECT g, 2 * x0 + CASE WHEN k IN (1, 3) THEN 1 ELSE 0 END AS x, 2 * y0 + CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END AS y, v FROM t)"""


@_query(
    f"WITH {_TILE_BASE}, {_lift_sql('r1', 'g0', 'g, y', 'x', 0, '-((a + b + 2) >> 2)')}, {_lift_sql('r2', 'r1', 'g, y', 'x', 1, '((a + b) >> 1)')}, "
    f"{_lift_sql('c1', 'r2', 'g, x', 'y', 0, '-((a + b + 2) >> 2)')}, {_lift_sql('c2', 'c1', 'g, x', 'y', 1, '((a + b) >> 1)')} SELECT g, x, y, v AS value FROM c2"
)
def idwt53_2d_level(spark, sf_dir):
    """One level up over 8 x 8 tiles of `events`, rows before columns."""
    return merge_level(_tiles(spark, sf_dir), ["g"]).select("g", "x", "y", "value")


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN n <= 1 THEN 0 WHEN k < n THEN k ELSE 2 * (n - 1) - k END AS at
FROM (SELECT *, ((i % p) + p) % p AS k FROM (SELECT *, l_partkey % 60 - 30 AS i, l_suppkey % 7 + 1 AS n, greatest(2 * (l_suppkey % 7), 1) AS p FROM lineitem))""")
def mirror_extension(spark, sf_dir):
    """Whole-sample reflection of indices far outside."""
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", mirror(F.col("l_partkey") % 60 - 30, F.col("l_suppkey") % 7 + 1).alias("at"))


# samples and grades


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN s THEN least(greatest(v, -h), h - 1) ELSE least(greatest(v + h, 0), 2 * h - 1) END AS v
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) - 40000 AS v, l_returnflag = 'N' AS s, CAST(1 AS BIGINT) << (l_partkey % 32) AS h FROM lineitem)""")
def level_shift_clamp(spark, sf_dir):
    """Level shift and clamp at all depths."""
    v = level_shift(F.floor("l_extendedprice") - 40000, F.col("l_partkey") % 32 + 1, F.col("l_returnflag") == "N")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


@_query("""
SELECT vec_id, x, y, CASE WHEN x >= 0 AND x < 8 AND y >= 0 AND y < 4 THEN CAST(floor(embedding[y * 8 + x + 1] * 1000) AS BIGINT) END AS v
FROM (SELECT vec_id, embedding, vec_id % 10 - 1 AS x, vec_id // 10 % 6 - 1 AS y FROM embeddings)""")
def samples_at(spark, sf_dir):
    """Single samples of 8 x 4 grids, outside ones null."""
    t = _table(spark, sf_dir, "embeddings").withColumn("x", F.col("vec_id") % 10 - 1).withColumn("y", F.floor(F.col("vec_id") / 10) % 6 - 1)
    v = sample_at("embedding", F.lit(8), F.lit(4), F.col("x"), F.col("y"))
    return t.select("vec_id", "x", "y", F.floor(v * 1000).cast("long").alias("v"))


@_query("""
SELECT l_orderkey, CAST(min(CASE WHEN abs(a - e) > 10 THEN i END) AS INTEGER) AS first_at FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) AS a, CAST(l_tax * 300 AS BIGINT) + 10 AS e FROM lineitem)
GROUP BY l_orderkey""")
def compare_first_mismatch(spark, sf_dir):
    """The first sample of each order's line that is off by more than 10."""
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("a"), (F.round(F.col("l_tax") * 300).cast("long") + 10).alias("e")).alias("s"))
    g = t.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    first = compare(F.transform("s", lambda v: v["a"]), F.transform("s", lambda v: v["e"]), 10)
    return g.select("l_orderkey", first["at"].alias("first_at"))


@_query("""
SELECT l_returnflag, l_linestatus, max(abs(l_quantity - l_linenumber)) AS pae, round(avg((l_quantity - l_linenumber) * (l_quantity - l_linenumber)), 6) AS mse, count(*) AS samples
FROM lineitem GROUP BY ALL""")
def pae_mse(spark, sf_dir):
    """Peak and mean squared error per group."""
    out = errors(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_linenumber")
    return out.withColumn("mse", F.round("mse", 6))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'LoadError' WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 <> 1 OR o_custkey % 4 > 1 THEN 'Failed' ELSE 'Passed' END AS status FROM orders""")
def classify_outcome(spark, sf_dir):
    """Outcome of rows whose snapshot, decoding, geometry or samples are off."""
    o = _table(spark, sf_dir, "orders")
    num = lambda c: F.col(c).cast("int")
    fault = F.when(F.col("o_orderkey") % 7 == 0, F.struct(F.lit("Marker").alias("kind"), F.lit("m").alias("message")))
    samples = F.array(num("o_custkey") % 4, F.lit(0))
    actual = F.struct(F.lit(2).alias("width"), (num("o_orderkey") % 3).alias("height"), F.lit(8).alias("bit_depth"), F.lit(False).alias("signed"), samples.alias("samples"), fault.alias("error"))
    geometry = F.struct(F.lit(2).cast("long").alias("width"), F.lit(1).cast("long").alias("height"), F.lit(8).alias("bit_depth"), F.lit(False).alias("signed"))
    want = F.when(F.col("o_orderkey") % 5 != 0, F.struct(geometry.alias("geometry"), F.array(F.lit(0), F.lit(0)).alias("samples")))
    t = o.select("o_orderkey", actual.alias("actual"), want.alias("expected"), F.lit(1.0).alias("max_abs_error"))
    return classify(t, "actual", "expected", "max_abs_error").select("o_orderkey", "status")


# entropy coding against published vectors


def _in_tasks(spark: SparkSession, rows: list, schema: str, run, out: str) -> DataFrame:
    """rows mapped by a function of one row to many, on executors."""
    kinds = {n: {"int": pa.int32(), "string": pa.string()}[k] for n, k in (c.split() for c in out.split(", "))}

    def work(batches):
        for b in batches:
            made = [r for row in b.to_pylist() for r in run(row)]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), list(zip(*made)) or [()] * len(kinds))})

    return spark.createDataFrame(rows, schema).mapInArrow(work, out)


@_query(_values([(i, int(vectors.H2_DECODED[2 * i : 2 * i + 2], 16)) for i in range(32)], "i, decisions"))
def mq_h2_sequence(spark, sf_dir):
    """The 256 decisions of the worked MQ sequence, packed into bytes."""

    def run(row):
        decide = mq.decoder(bytes(row["data"]), [0])
        for i in range(32):
            yield i, int("".join(str(decide(0)) for _ in range(8)), 2)

    return _in_tasks(spark, [(bytes.fromhex(vectors.H2_CODED),)], "data binary", run, "i int, decisions int")


@_query(_values([(n, c, v) for n, (_, _, _, _, _, _, values) in enumerate(vectors.GOLDEN_BLOCKS) for c, v in enumerate(values)], "block, i, q"))
def tier1_golden_blocks(spark, sf_dir):
    """Coefficients of three code-blocks of a real encoder."""
    rows = [(i, bytes.fromhex(s), w, h, p, z) for i, (_, w, h, p, z, s, _) in enumerate(vectors.GOLDEN_BLOCKS)]

    def run(r):
        q = blocks.decode_block(bytes(r["segment"]), r["w"], r["h"], "LL", -(-r["passes"] // 3) + r["zero"], r["zero"], r["passes"])
        for i, v in enumerate(q.ravel().tolist()):
            yield r["block"], i, v

    return _in_tasks(spark, rows, "block int, segment binary, w int, h int, passes int, zero int", run, "block int, i int, q int")


# fixed values: Table D.1 by the sums (h, v, d), and Tables D.2 and D.3 by (h, v)
_ZC = [("LL", 2, 0, 0, 8), ("LL", 1, 1, 0, 7), ("LL", 1, 0, 1, 6), ("LL", 1, 0, 0, 5), ("LL", 0, 2, 0, 4), ("LL", 0, 1, 0, 3), ("LL", 0, 0, 2, 2), ("LL", 0, 0, 1, 1), ("LL", 0, 0, 0, 0), ("HL", 0, 2, 0, 8), ("HL", 2, 0, 0, 4), ("HL", 1, 0, 0, 3), ("HL", 0, 1, 0, 5), ("HH", 0, 0, 3, 8), ("HH", 1, 0, 2, 7), ("HH", 0, 0, 2, 6), ("HH", 1, 1, 1, 5), ("HH", 0, 1, 1, 4), ("HH", 0, 0, 1, 3), ("HH", 2, 0, 0, 2), ("HH", 0, 1, 0, 1), ("HH", 0, 0, 0, 0)]
_SC = [(1, 1, 13, 0), (1, 0, 12, 0), (1, -1, 11, 0), (0, 1, 10, 0), (0, 0, 9, 0), (0, -1, 10, 1), (-1, 1, 11, 1), (-1, 0, 12, 1), (-1, -1, 13, 1)]


@_query(_values(_ZC, "kind, h, v, d, label"))
def zc_context_table(spark, sf_dir):
    """Zero-coding contexts."""
    rows = [r[:4] for r in _ZC]
    return _in_tasks(spark, rows, "kind string, h int, v int, d int", lambda r: [(r["kind"], r["h"], r["v"], r["d"], blocks.zero_context(r["h"], r["v"], r["d"], r["kind"]))], "kind string, h int, v int, d int, label int")


@_query(_values(_SC, "h, v, context, flip"))
def sc_context_table(spark, sf_dir):
    """Sign contexts."""
    return _in_tasks(spark, [r[:2] for r in _SC], "h int, v int", lambda r: [(r["h"], r["v"], *blocks.sign_context(r["h"], r["v"]))], "h int, v int, context int, flip int")


# fixed values: the standard's table of states in decimal numbers
@_query("""
SELECT * FROM (VALUES
  (0, 22017, 1, 1, 1), (1, 13313, 2, 6, 0), (2, 6145, 3, 9, 0), (3, 2753, 4, 12, 0), (4, 1313, 5, 29, 0), (5, 545, 38, 33, 0),
  (6, 22017, 7, 6, 1), (7, 21505, 8, 14, 0), (8, 18433, 9, 14, 0), (9, 14337, 10, 14, 0), (10, 12289, 11, 17, 0), (11, 9217, 12, 18, 0),
  (12, 7169, 13, 20, 0), (13, 5633, 29, 21, 0), (14, 22017, 15, 14, 1), (15, 21505, 16, 14, 0), (16, 20737, 17, 15, 0), (17, 18433, 18, 16, 0),
  (18, 14337, 19, 17, 0), (19, 13313, 20, 18, 0), (20, 12289, 21, 19, 0), (21, 10241, 22, 19, 0), (22, 9217, 23, 20, 0), (23, 8705, 24, 21, 0),
  (24, 7169, 25, 22, 0), (25, 6145, 26, 23, 0), (26, 5633, 27, 24, 0), (27, 5121, 28, 25, 0), (28, 4609, 29, 26, 0), (29, 4353, 30, 27, 0),
  (30, 2753, 31, 28, 0), (31, 2497, 32, 29, 0), (32, 2209, 33, 30, 0), (33, 1313, 34, 31, 0), (34, 1089, 35, 32, 0), (35, 673, 36, 33, 0),
  (36, 545, 37, 34, 0), (37, 321, 38, 35, 0), (38, 273, 39, 36, 0), (39, 133, 40, 37, 0), (40, 73, 41, 38, 0), (41, 37, 42, 39, 0),
  (42, 21, 43, 40, 0), (43, 9, 44, 41, 0), (44, 5, 45, 42, 0), (45, 1, 45, 43, 0), (46, 22017, 46, 46, 0)
) AS t(state, qe, next_mps, next_lps, switch)""")
def mq_state_table(spark, sf_dir):
    """The 47 states, read back from the moves that the decoder makes."""
    moves = [(i, *mq._MOVES[2 * i], mq._MOVES[2 * i][2]) for i in range(len(mq._MOVES) // 2)]
    return spark.createDataFrame([(i, q, mps // 2, lps // 2, lps % 2) for i, q, mps, lps, _ in moves], "state int, qe int, next_mps int, next_lps int, switch int")


# fixed values: Table B.4, bits and passes
_PASSES = [("0", 1), ("10", 2), ("1100", 3), ("1101", 4), ("1110", 5), ("111100000", 6), ("111111110", 36), ("1111111110000000", 37), ("1111111111111111", 164)]


@_query(_values(_PASSES, "bits, passes"))
def num_passes_code(spark, sf_dir):
    """The prefix code of the number of passes."""

    def run(r):
        # one bit an entry, so that stuffing plays no part
        source = BitReader(b"")
        source.bit = iter(map(int, r["bits"])).__next__
        yield r["bits"], read_passes(source)

    return _in_tasks(spark, [(b,) for b, _ in _PASSES], "bits string", run, "bits string, passes int")


# fixed values: bytes, bits to read, their value, and the byte after alignment
_STUFFING = [("a5", 8, 0xA5, 1), ("ff7f", 15, 0x7FFF, 2), ("ff00", 9, 0x1FE, 2), ("", 3, 7, 0), ("80", 1, 1, 1), ("ffc0", 8, 255, 2)]


@_query(_values(_STUFFING, "data, n, value, pos"))
def bitreader_stuffing(spark, sf_dir):
    """Packet-header bits with stuffing, ones past the end, and alignment."""

    def run(r):
        b = BitReader(bytes.fromhex(r["data"]))
        yield r["data"], r["n"], b.bits(r["n"]), b.align()

    return _in_tasks(spark, [r[:2] for r in _STUFFING], "data string, n int", run, "data string, n int, value int, pos int")


# fixed values: the tag tree example of Annex B.10.2, 6 x 3 leaves
_LEAVES = (1, 3, 2, 3, 2, 3, 2, 2, 1, 4, 3, 2, 2, 2, 2, 2, 1, 2)


@_query(_values([(i % 6, i // 6, v) for i, v in enumerate(_LEAVES)], "x, y, value"))
def tagtree_reads(spark, sf_dir):
    """All leaves of the standard's example, from bits that a tag-tree writer made."""

    def run(r):
        from .codec.bits import BitWriter

        w, tree = BitWriter(), TagTree(6, 3, list(r["leaves"]))
        for i, v in enumerate(r["leaves"]):
            tree.write(i % 6, i // 6, v + 1, w)
        source, tree = BitReader(w.done()), TagTree(6, 3)
        for i in range(18):
            yield i % 6, i // 6, tree.read(i % 6, i // 6, 64, source)

    return _in_tasks(spark, [(list(_LEAVES),)], "leaves array<int>", run, "x int, y int, value int")


# whole streams


def golden_streams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b[0], vectors.wrapped(b[0])) for b in vectors.GOLDEN_BLOCKS], "name string, content binary")


_GOLDEN_SAMPLES = _values([(n, i % w, i // w, v + 128) for n, w, _, _, _, _, q in vectors.GOLDEN_BLOCKS for i, v in enumerate(q)], "name, x, y, value")


@_query(_GOLDEN_SAMPLES)
def decode_golden_codestreams(spark, sf_dir):
    """Samples of complete streams around blocks of a real encoder."""
    return images_to_samples(decode(golden_streams(spark))).select("name", "x", "y", "value")


@_query(_values([(n, p, z, len(s) // 2) for n, _, _, p, z, s, _ in vectors.GOLDEN_BLOCKS], "name, num_passes, zero_bit_planes, segment_bytes"))
def packet_parse(spark, sf_dir):
    """Code-blocks of those streams."""
    return code_blocks(golden_streams(spark)).select("name", "num_passes", "zero_bit_planes", F.length("segment").alias("segment_bytes"))


@_query(_values([(n, w, h, 0, "5-3", 2, 8) for n, w, h, *_ in vectors.GOLDEN_BLOCKS], "name, width, height, levels, transform, guard_bits, exponent"))
def header_fields(spark, sf_dir):
    """Headers of those streams."""
    h = with_headers(golden_streams(spark))
    return h.select("name", F.col("siz.x_size").alias("width"), F.col("siz.y_size").alias("height"), F.col("header.cod.levels").alias("levels"), F.col("header.cod.transform").alias("transform"), F.col("header.qcd.guard_bits").alias("guard_bits"), F.col("header.qcd.steps")[0]["exp"].alias("exponent"))


def _broken() -> list[tuple[str, str, bytes]]:
    """Streams with one thing wrong each, and the kind of fault that it must give."""
    good = vectors.wrapped("small_4x4")
    hexed = good.hex()

    def swap(old: str, new: str) -> bytes:
        assert hexed.count(old) == 1, old
        return bytes.fromhex(hexed.replace(old, new))

    siz = "ff5100290000" + "00000004" * 2 + "0" * 16 + "00000004" * 2 + "0" * 16 + "0001070101"
    cod, qcd, sot = "ff52000c00000001000004040001", "ff5c00044040", "ff90000a0000"
    s = lambda **k: swap(siz, "ff5100290000" + k.get("size", "00000004" * 2) + k.get("off", "0" * 16) + k.get("tile", "00000004" * 2) + k.get("toff", "0" * 16) + k.get("comp", "0001070101"))
    return [
        ("no_soc", "Codestream", b"\0\0" + good[2:]), ("siz_not_first", "Codestream", swap(siz, cod)), ("empty", "Codestream", b""), ("cut_short", "Codestream", good[:30]),
        ("no_components", "Marker", s(comp="0000070101")), ("two_components", "Unsupported", s(comp="0002070101")), ("no_width", "Marker", s(size="0000000000000004")),
        ("image_offset", "Unsupported", s(off="0000000100000000")), ("tile_offset", "Unsupported", s(toff="0000000000000001")), ("no_tile", "Marker", s(tile="0000000000000004")),
        ("small_tile", "Unsupported", s(tile="0000000300000004")), ("huge", "Unsupported", s(size="0001000000010000", tile="0001000000010000")),
        ("siz_tail", "Codestream", swap(siz, siz.replace("ff510029", "ff51002a") + "00")),
        ("precincts", "Unsupported", swap(cod, cod.replace("000c00", "000c01"))), ("sop", "Unsupported", swap(cod, cod.replace("000c00", "000c02"))), ("rlcp", "Unsupported", swap(cod, "ff52000c00010001000004040001")),
        ("progression_5", "Marker", swap(cod, "ff52000c00050001000004040001")), ("two_layers", "Unsupported", swap(cod, "ff52000c00000002000004040001")), ("mct", "Unsupported", swap(cod, "ff52000c00000001010004040001")),
        ("wavelet_2", "Marker", swap(cod, "ff52000c00000001000004040002")), ("cod_tail", "Codestream", swap(cod, "ff52000d0000000100000404000100")), ("bypass", "Unsupported", swap(cod, "ff52000c00000001000004040101")),
        ("no_cod", "Codestream", swap(cod, "")), ("no_qcd", "Codestream", swap(qcd, "")), ("two_cod", "Codestream", swap(cod, cod + cod)), ("two_qcd", "Codestream", swap(qcd, qcd + qcd)),
        ("quant_3", "Marker", swap(qcd, "ff5c00044340")), ("quant_empty", "Codestream", swap(qcd, "ff5c000340")), ("quant_odd", "Codestream", swap(qcd, "ff5c00044240")), ("derived_two", "Codestream", swap(qcd, "ff5c00074140004000")),
        ("coc", "Unsupported", swap(qcd, qcd + "ff530004" + "0000")), ("eoc_early", "Codestream", swap(qcd, qcd + "ffd9")), ("unknown", "Codestream", swap(qcd, qcd + "ff700002")), ("comment", "", swap(qcd, qcd + "ff6400040000")),
        ("tile_1", "Unsupported", swap(sot, "ff90000a0001")), ("psot_long", "Codestream", swap("00000019", "00000fff")), ("psot_short", "Codestream", swap("00000019", "00000001")), ("psot_0", "", swap("00000019", "00000000")),
        ("no_eoc", "Codestream", good[:-2]), ("tile_cod", "Unsupported", swap("ff93", "ff520002ff93")), ("tile_unknown", "Codestream", swap("ff93", "ff700002ff93")),
        ("levels_33", "Unsupported", swap(cod, "ff52000c00000001002104040001")), ("block_size", "Marker", swap(cod, "ff52000c00000001000009040001")),
        ("steps_missing", "Inconsistent", _two_levels()),
        ("left_over", "Codestream", bytes.fromhex(hexed.replace("00000019", "0000001a")[:-4] + "00ffd9")), ("depth_33", "Marker", s(comp="0001200101")), ("unsigned_32", "Unsupported", s(comp="00011f0101")), ("sampling_0", "Marker", s(comp="0001070001")),
        ("irreversible_none", "Inconsistent", swap(cod, "ff52000c00000001000004040000")),
    ]


def _two_levels() -> bytes:
    """A stream of one level whose QCD has a single entry."""
    made = grid.encode(np.arange(16).reshape(4, 4), levels=1)
    at = made.index(bytes.fromhex("ff5c"))
    return made[:at] + bytes.fromhex("ff5c00044040") + made[at + 2 + int.from_bytes(made[at + 2 : at + 4]) :]


@_query(_values([(n, k) for n, k, _ in _broken()], "name, kind"))
def marker_reject_matrix(spark, sf_dir):
    """The fault kind of each broken stream; none for those that are only unusual."""
    df = spark.createDataFrame([(n, x) for n, _, x in _broken()], "name string, content binary")
    return decode(df).select("name", F.coalesce("error.kind", F.lit("")).alias("kind"))


# round trips of table data through the whole codec


def encode_tiles(tiles: DataFrame, by: str, w: int, h: int, **how) -> DataFrame:
    """(by, content): samples (x, y, v) of each tile as a codestream; a sample that is absent or has a null is 0.

    Samples are read in the Arrow buffers, one tile at a time: as Python objects, those of a
    batch take some twenty times its bytes.
    """

    def run(batches):
        for b in batches:
            made, lists = [], b.column(1)
            ends = lists.offsets.to_numpy()
            x, y, v = (lists.values.field(n).to_numpy() for n in ("x", "y", "v"))
            for i in range(b.num_rows):
                a, own = np.zeros((h, w), np.int64), slice(ends[i], ends[i + 1])
                a[y[own], x[own]] = v[own]
                made.append(grid.encode(a, **how))
            yield pa.RecordBatch.from_pydict({by: b.column(0), "content": pa.array(made, pa.binary())})

    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("v").isNotNull()
    one = tiles.groupBy(by).agg(F.collect_list(F.when(whole, F.struct("x", "y", "v"))).alias("s"))
    return one.mapInArrow(run, f"{by} long, content binary")


def _event_tiles(spark, sf_dir):
    k = F.col("event_id") % 1024
    return _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1024).alias("g"), (k % 32).cast("int").alias("x"), F.floor(k / 32).cast("int").alias("y"), (F.floor(F.col("value") * 10) % 4096).cast("int").alias("v"))


_EVENT_TILES = """
SELECT g, x, y, coalesce(v, 0) AS value FROM (SELECT g, x, y FROM (SELECT DISTINCT event_id // 1024 AS g FROM events), range(0, 32) AS a(x), range(0, 32) AS b(y)) c
LEFT JOIN (SELECT event_id // 1024 AS g, event_id % 1024 % 32 AS x, event_id % 1024 // 32 AS y, CAST(floor(value * 10) AS BIGINT) % 4096 AS v FROM events) e USING (g, x, y)"""


@_query(_EVENT_TILES)
def roundtrip_53_pyramid(spark, sf_dir):
    """32 x 32 tiles of `events` encoded over three levels and decoded from the bytes alone."""
    streams = encode_tiles(_event_tiles(spark, sf_dir), "g", 32, 32, depth=12, levels=3)
    return images_to_samples(decode(streams)).select("g", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("value").cast("long").alias("value"))


@_query(_EVENT_TILES)
def roundtrip_53_exploded(spark, sf_dir):
    """The same with small code-blocks that are decoded apart and gathered again."""
    streams = encode_tiles(_event_tiles(spark, sf_dir), "g", 32, 32, depth=12, levels=2, xcb=1, ycb=2)
    return images_to_samples(decode(streams, strategy="exploded")).select("g", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("value").cast("long").alias("value"))


@_query("SELECT g, count(*) AS n, true AS within FROM (" + _EVENT_TILES + ") GROUP BY g")
def roundtrip_97_pyramid(spark, sf_dir):
    """Irreversible coding of the same tiles stays within 2 of them."""
    tiles = _event_tiles(spark, sf_dir)
    out = images_to_samples(decode(encode_tiles(tiles, "g", 32, 32, depth=12, levels=3, transform="9-7")))
    both = out.join(tiles, ["g", "x", "y"], "left")
    return both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("value") - F.coalesce("v", F.lit(0)))) <= 2).alias("within"))


def _grib(body: bytes) -> bytes:
    sections = b"".join((len(b) + 5).to_bytes(4) + bytes([n]) + b for n, b in ((1, b"\0" * 16), (5, b"\0" * 18), (7, body))) + b"7777"
    return b"GRIB\0\0\0\2" + (16 + len(sections)).to_bytes(8) + sections


@_query(_values([("two.grib2", i, len(vectors.wrapped(n)), None) for i, n in enumerate(("sparse_8x8", "small_4x4"))] + [("bad.grib2", 0, None, "section 7 is not a JPEG 2000 codestream")], "path, message_index, bytes, error"))
def grib2_section7(spark, sf_dir):
    """Codestreams inside weather messages, with noise between them."""
    from .sources import grib2_codestreams

    two = b"noise GRIB" + _grib(vectors.wrapped("sparse_8x8")) + b"GRIB\0\0\0\1" + _grib(vectors.wrapped("small_4x4")) + b"end"
    files = spark.createDataFrame([("two.grib2", two), ("bad.grib2", _grib(b"raw")), ("none.grib2", b"")], "path string, content binary")
    return grib2_codestreams(files).select("path", "message_index", F.length("content").alias("bytes"), "error")


# fixed values: file, bytes, and samples with depth and sign
_PGX = [("a", b"PG ML + 8 2 1\n\x01\xff", [(0, 8, False, 1), (1, 8, False, 255)]), ("b", b"PG ML -8 2 1\n\x01\xff", [(0, 8, True, 1), (1, 8, True, -1)]), ("c", b"PG LM 12 1 2\n\x34\x02\xff\x0f", [(0, 12, False, 564), (1, 12, False, 4095)]), ("d", b"PG ML +8 1 1\n\x2a", [(0, 8, False, 42)])]


@_query(_values([(n, *r) for n, _, rows in _PGX for r in rows], "path, i, bit_depth, signed, value"))
def pgx_read(spark, sf_dir):
    """PGX images in both byte orders and both ways to write the sign."""
    from .sources import pgx_images

    files = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in _PGX], "path string, content binary")
    return pgx_images(files).select("path", "bit_depth", "signed", F.posexplode("samples").alias("i", "value")).select("path", "i", "bit_depth", "signed", "value")


@_query(_GOLDEN_SAMPLES)
def decode_stream_micro_batch(spark, sf_dir):
    """The golden streams as arriving files, decoded by a streaming query."""
    from .streaming import decode_arrivals

    base = shared_folder(spark, "stream")
    write_files(spark, f"{base}/in", {f"{n}.j2k": vectors.wrapped(n) for n, *_ in vectors.GOLDEN_BLOCKS})
    stream = decode_arrivals(spark, f"{base}/in").writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    stream.awaitTermination()
    images = spark.read.parquet(f"{base}/out").withColumn("name", F.regexp_extract("path", r"([^/]+)\.j2k$", 1))
    return images_to_samples(images.drop("path", "modificationTime", "length")).select("name", "x", "y", "value")


@_query(f"SELECT copy, x, y, value FROM ({_GOLDEN_SAMPLES}) g, (VALUES (0), (1), (2)) AS c(copy)")
def decode_repeated_rows(spark, sf_dir):
    """Streams in several rows, without a name or with one name, decoded apart: an image for each."""
    streams = golden_streams(spark).select(F.lit(None).cast("string").alias("name"), "content")
    rows = streams.withColumn("copy", F.lit(0)).union(streams.withColumn("copy", F.lit(1))).union(streams.select(F.lit("same").alias("name"), "content", F.lit(2).alias("copy")))
    # names that code-blocks have, too
    clash = rows.withColumn("w", F.lit("w")).withColumn("band_idx", F.lit(7))
    return images_to_samples(decode(clash, strategy="exploded")).select("copy", "x", "y", "value")


# corpora, snapshots and files


def _u(value, n: int):
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def _corpus(spark, sf_dir) -> DataFrame:
    """Main headers from `nation`: profile 0 for the first 16, then profile 1."""
    n, c = F.col("n_nationkey"), F.col("n_regionkey") + 4
    siz = F.concat(
        F.lit("ff51"), _u(38 + 3 * c, 2), F.lit("0000"), _u(100 + 13 * n, 4), _u(80 + 7 * n, 4), F.lit("0" * 16), _u(F.lit(64), 4), _u(F.lit(32), 4), F.lit("0" * 16), _u(c, 2),
        F.array_join(F.array_repeat(F.concat(_u(7 + n % 5, 1), F.lit("0101")), c.cast("int")), ""),
    )
    cod = F.concat(F.lit("ff52000c00"), _u(n % 5, 1), _u(n + 1, 2), _u(n % 2, 1), _u(n % 6, 1), F.lit("040400"), _u(n % 2, 1))
    first = n < 16
    return _table(spark, sf_dir, "nation").select(
        F.when(first, 0).otherwise(1).alias("profile"), F.when(first, n + 1).otherwise(n - 15).cast("int").alias("index"), F.unhex(F.concat(F.lit("ff4f"), siz, cod, F.lit("ff90"))).alias("content"),
    )


_CELLS = _values([(p, c, m, text) for (c, p, m), text in BOUNDS.items()], "profile, class, measure, cells")


@_query(f"""
WITH s AS (SELECT profile, class, measure, string_split(cells, ';') AS cells FROM ({_CELLS})),
cell AS (SELECT profile, class, measure, CAST(i AS INTEGER) AS index, list_transform(string_split(cells[i], ':'), lambda x: CAST(x AS DOUBLE)) AS b FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM s)),
n AS (SELECT *, CASE WHEN n_nationkey < 16 THEN 0 ELSE 1 END AS profile, CAST(CASE WHEN n_nationkey < 16 THEN n_nationkey + 1 ELSE n_nationkey - 15 END AS INTEGER) AS index FROM nation),
w AS (SELECT n.*, p.b AS pae, m.b AS mse, z.b AS pae0, printf('p%d_%02d', n.profile, n.index) AS name FROM n
  JOIN cell p ON (p.profile, p.index, p.class, p.measure) = (n.profile, n.index, 1, 'pae') JOIN cell m ON (m.profile, m.index, m.class, m.measure) = (n.profile, n.index, 1, 'mse')
  JOIN cell z ON (z.profile, z.index, z.class, z.measure) = (n.profile, n.index, 0, 'pae'))
SELECT 'codestreams/' || name || '.j2k' AS codestream, CAST(len(pae) AS INTEGER) AS graded, list_max(pae) = 0 AND list_max(mse) = 0 AS bit_exact, list_max(pae) AS largest_pae, list_max(mse) AS largest_mse, pae0[1] AS pae0,
  100 + 13 * n_nationkey AS width, 80 + 7 * n_nationkey AS height, CAST(n_regionkey + 4 AS INTEGER) AS components, CAST(n_nationkey % 5 + 8 AS INTEGER) AS depth,
  CAST(ceil((100 + 13 * n_nationkey) / 64.0) AS BIGINT) AS tiles_x, CAST(ceil((80 + 7 * n_nationkey) / 32.0) AS BIGINT) AS tiles_y, ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][n_nationkey % 5 + 1] AS progression,
  CAST(n_nationkey + 1 AS INTEGER) AS layers, CAST(n_nationkey % 6 + 1 AS INTEGER) AS resolutions, n_nationkey % 2 = 1 AS reversible, 'references/c1' || name || '_' || (len(pae) - 1) || '.pgx' AS last_reference,
  CASE name WHEN 'p0_03' THEN 'r0,r1' WHEN 'p0_15' THEN 'r0,r1' WHEN 'p1_04' THEN 'r0,r3' ELSE '' END AS at FROM w""")
def conformance_manifest_entries(spark, sf_dir):
    """The manifest of a corpus whose headers come from `nation`: bounds, features and references."""
    m, f = conformance_manifest(_corpus(spark, sf_dir), conformance_bounds(spark)), "features."
    of = lambda c: F.array_max(f"bounds_class1.{c}")
    at = F.array_join(F.transform("references.class0", lambda r: F.regexp_extract(r, r"_[0-9]{2}(.*)\.pgx$", 1)), ",")
    return m.select(
        "codestream", F.col("graded_components").alias("graded"), "bit_exact", of("pae").alias("largest_pae"), of("mse").alias("largest_mse"), F.col("bounds_class0_first_component.pae")[0].alias("pae0"),
        f + "width", f + "height", f + "components", F.array_max(f + "precision").alias("depth"), F.col(f + "tiles")[0].alias("tiles_x"), F.col(f + "tiles")[1].alias("tiles_y"), f + "progression", f + "layers", f + "resolutions", f + "reversible",
        F.element_at("references.class1", -1).alias("last_reference"), at.alias("at"),
    )


@_query("""
SELECT 'c/' || o_orderkey AS codestream, CASE o_orderkey % 9 WHEN 1 THEN 'codestream' WHEN 2 THEN 'features' WHEN 3 THEN 'graded' WHEN 4 THEN 'class1' WHEN 5 THEN 'class0' WHEN 6 THEN 'reference' WHEN 7 THEN 'pae'
  WHEN 8 THEN CASE WHEN o_custkey % 2 = 0 THEN 'bit_exact' ELSE 'mse,bit_exact' END ELSE '' END AS faults FROM orders""")
def conformance_consistency(spark, sf_dir):
    """Rules that entries from `orders` break, each with at most two defects."""
    k, d = F.col("o_orderkey"), F.col("o_orderkey") % 9
    n = (F.col("o_custkey") % 3 + 1).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    reference = F.concat(F.lit("r/"), k.cast("string"))
    o = _table(spark, sf_dir, "orders")
    manifest = o.select(
        F.concat(F.lit("c/"), k.cast("string")).alias("codestream"), n.alias("graded_components"), F.when(d != 2, F.struct((n - F.when(d == 3, 1).otherwise(0)).alias("components"))).alias("features"),
        F.struct(F.when(d == 5, F.array().cast("array<string>")).otherwise(F.array(reference)).alias("class0"), F.array_repeat(reference, n - F.when(d == 4, 1).otherwise(0)).alias("class1")).alias("references"),
        F.struct(zeros(n + F.when(d == 7, 1).otherwise(0)).alias("pae"), zeros(n + F.when((d == 8) & (F.col("o_custkey") % 2 == 1), 1).otherwise(0)).alias("mse")).alias("bounds_class1"), (d != 8).alias("bit_exact"),
    )
    files = o.select(F.concat(F.lit("c/"), k.cast("string")).alias("path"), F.when(d == 1, F.unhex(F.lit("ff4d00"))).otherwise(F.unhex(F.lit("ff4fff51"))).alias("content"))
    files = files.union(o.select(reference, F.when(d == 6, F.encode(F.lit("GP ML"), "UTF-8")).otherwise(F.encode(F.lit("PG ML + 8 1 1"), "UTF-8"))))
    return check_entries(manifest, files).select("codestream", F.array_join("faults", ",").alias("faults"))


def _images(t: DataFrame, key: str) -> DataFrame:
    """An 8-bit image of 3 x 2 samples a row."""
    samples = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col(key) * 37 + i * i * 11) % 256).cast("int"))
    return t.select(F.concat(F.lit("i"), F.col(key).cast("string")).alias("name"), F.lit(3).alias("width"), F.lit(2).alias("height"), F.lit(8).alias("bit_depth"), F.lit(False).alias("signed"), samples.alias("samples"), F.lit(None).cast("string").alias("error"))


_SAMPLES = "list_transform(range(0, 6), lambda i: (k * 37 + i * i * 11) % 256)"


@_query(f"""
SELECT 'i' || k AS name, '{{"geometry":{{"width":3,"height":2,"bit_depth":8,"signed":false}},"tolerance":{{"mode":"exact"}},"samples":[' || array_to_string({_SAMPLES}, ',') || '],"provenance":{{"source":"orders","oracle_command":"none"}}}}' AS json
FROM (SELECT o_orderkey AS k FROM orders)""")
def snapshot_json(spark, sf_dir):
    """Snapshots of images from `orders`, as they are written."""
    return to_snapshots(_images(_table(spark, sf_dir, "orders"), "o_orderkey"), "orders", "none")


@_query(f"""
SELECT 'i' || k AS name, octet_length(encode('stream ' || k)) AS bytes, k % 4 <> 0 AND k % 4 <> 3 AS readable, CAST(CASE k % 4 WHEN 1 THEN 0.0 WHEN 2 THEN 1.5 END AS DOUBLE) AS max_abs_error,
  CASE WHEN k % 4 IN (1, 2) THEN array_to_string({_SAMPLES}, ',') END AS samples FROM (SELECT n_nationkey AS k FROM nation)""")
def fixture_scan(spark, sf_dir):
    """Streams named by `nation` in a folder, beside snapshots that are there, missing or broken."""
    folder, files = shared_folder(spark, "fixtures"), {}
    for r in to_snapshots(_images(_table(spark, sf_dir, "nation"), "n_nationkey"), "nation", "none").toLocalIterator():  # 25 rows
        k = int(r.name[1:])
        files[f"a/{r.name}.j2k"] = f"stream {k}".encode()
        text = {1: r.json, 2: r.json.replace('"exact"', '"absolute","max_abs_error":1.5'), 3: r.json.replace('"samples":[', '"samples":[1,')}.get(k % 4)
        if text:
            files[f"a/{r.name}.expected.json"] = text.encode()
    files["a/alone.expected.json"] = b"{}"
    write_files(spark, folder, files)
    found = read_fixtures(spark, folder)
    return found.select("name", F.octet_length("content").alias("bytes"), F.col("expected").isNotNull().alias("readable"), "max_abs_error", F.array_join(F.col("expected.samples").cast("array<string>"), ",").alias("samples"))


@_query(f"""
SELECT 'i' || k AS name, i, CAST(s[i + 1] AS INTEGER) AS value FROM (SELECT k, {_SAMPLES} AS s, unnest(range(0, 6)) AS i FROM (SELECT n_nationkey AS k FROM nation))""")
def snapshot_read(spark, sf_dir):
    """Snapshots written and read again, sample by sample."""
    folder = shared_folder(spark, "snapshots")
    made = to_snapshots(_images(_table(spark, sf_dir, "nation"), "n_nationkey"), "nation", "none")
    write_files(spark, folder, {f"{r.name}.expected.json": r.json.encode() for r in made.toLocalIterator()})  # 25 rows
    return read_snapshots(spark, folder).select("name", F.posexplode("expected.samples").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@_query(f"""
SELECT 'i' || k AS path, 11 + 6 AS bytes, i, CAST(s[i + 1] AS INTEGER) AS value FROM (SELECT k, {_SAMPLES} AS s, unnest(range(0, 6)) AS i FROM (SELECT c_custkey AS k FROM customer))""")
def pgm_round_trip(spark, sf_dir):
    """Images from `customer` as P5 files and back."""
    files = to_pgm(_images(_table(spark, sf_dir, "customer"), "c_custkey")).select(F.col("name").alias("path"), "content")
    back = pgm_images(files).join(files.select("path", F.octet_length("content").alias("bytes")), "path")
    return back.select("path", "bytes", F.posexplode("samples").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: table data through encoder, bytes and decoder."""
    return roundtrip_53_pyramid(spark, sf_dir)
