"""DataFrame operators, sources, streaming and SQL."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwave import sql
from gridwave.codec import grid, vectors
from gridwave.codec.features import read_features
from gridwave.operators import code_blocks, decode, images_to_samples, summarize, with_headers
from gridwave.operators.decode import supported
from gridwave.operators.grading import classify
from gridwave.plans.strategy import choose
from gridwave.queries import _grib, golden_streams
from gridwave.sources import grib2_codestreams, pgm_images, pgx_images, read_codestreams, read_fixtures, to_snapshots
from gridwave.sources import check_entries, conformance_bounds, conformance_manifest, corpus_consistent, to_pgm
from gridwave.sources.conformance import ENTRIES
from gridwave.sources.pgx import write_pgm


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(1)
    rows = [(f"g{i}", grid.encode(np.clip(np.cumsum(r.integers(-3, 4, (20, 30)), 0) + 100, 0, 255), levels=2, xcb=1, ycb=1, transform=t)) for i, t in enumerate(("5-3", "9-7", "5-3"))]
    rows += [("null", None), ("empty", b""), ("cut", rows[0][1][:90]), ("zero", grid.encode(np.full((4, 4), 128), levels=1))]
    return spark.createDataFrame(rows, "name string, content binary").withColumn("width", F.lit("clash")).withColumn("x", F.lit(1))


def test_strategies_agree(mixed):
    fused = {r.name: r for r in decode(mixed).collect()}
    exploded = {r.name: r for r in decode(mixed, strategy="exploded").collect()}
    assert set(fused) == set(exploded)
    for n in fused:
        assert (fused[n].samples, fused[n].error and fused[n].error.kind) == (exploded[n].samples, exploded[n].error and exploded[n].error.kind)
    assert [fused[n].error.kind for n in ("null", "empty", "cut")] == ["Codestream"] * 3
    assert set(fused["zero"].samples) == {128}


def test_modes(mixed):
    assert decode(mixed, mode="DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="malformed codestream"):
        decode(mixed, mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        decode(mixed, mode="other")


def test_rows_are_told_apart_without_keys(spark):
    """Null, repeated and clashing columns: each row gets the image of its own bytes."""
    r = np.random.default_rng(4)
    grids = [r.integers(0, 256, (8, 8)) for _ in range(3)]
    streams = [grid.encode(g, levels=1, xcb=1, ycb=1) for g in grids]
    rows = [(None, 0, streams[0]), (2, 1, streams[1]), (2, 2, streams[2]), (2, 3, streams[2]), (None, 4, None)]
    df = spark.createDataFrame(rows, "x int, n int, content binary").withColumn("band_idx", F.lit("b")).withColumn("q", F.col("n"))
    for strategy in ("fused", "exploded"):
        got = {x.n: x for x in decode(df, strategy=strategy).collect()}
        assert len(got) == 5 and got[4].samples is None and got[4].error.kind == "Codestream"
        for n, g in enumerate([*grids, grids[2]]):
            assert got[n].samples == g.ravel().tolist() and got[n].error is None and (got[n].q, got[n].band_idx) == (n, "b")


def test_failfast_under_any_projection(mixed):
    for strategy in ("fused", "exploded"):
        bad = decode(mixed, mode="FAILFAST", strategy=strategy)
        for look in (lambda: bad.select("samples").collect(), lambda: bad.select("name").collect(), lambda: bad.count(), lambda: bad.select("error").collect()):  # noqa: B023
            with pytest.raises(Exception, match="malformed codestream"):
                look()
    assert decode(mixed.where("name LIKE 'g%'"), mode="FAILFAST").count() == 3


def test_conformance_corpus(spark):
    """The whole corpus with files for all references is consistent; each defect is named."""
    bounds = conformance_bounds(spark)
    assert bounds.where("class = 1 AND measure = 'pae'").count() == ENTRIES
    head = lambda c: (
        b"\xff\x4f\xff\x51" + struct.pack(">HH8IH", 38 + 3 * c, 0, 40, 30, 0, 0, 40, 30, 0, 0, c) + b"\x07\x01\x01" * c + b"\xff\x52" + struct.pack(">HBBHBBBBBB", 12, 0, 0, 1, 0, 5, 4, 4, 0, 1) + b"\xff\x90")
    keys = [(r[0], r[1]) for r in bounds.select("profile", "index").distinct().collect()]
    manifest = conformance_manifest(spark.createDataFrame([(p, i, head(4)) for p, i in keys], "profile int, index int, content binary"), bounds).cache()
    rows = {r.codestream: r for r in manifest.collect()}
    files = [(n, head(4)) for n in rows] + [(p, b"PG ML + 8 1 1\n\x00") for r in rows.values() for p in (*r.references.class0, *r.references.class1)]
    made = lambda f: spark.createDataFrame(f, "path string, content binary")
    assert corpus_consistent(manifest, made(files)).first() == (23, 0, True)
    r = rows["codestreams/p0_06.j2k"]
    assert (r.graded_components, r.bit_exact, r.bounds_class1.pae, r.references.class1[2]) == (4, False, [635.0, 403.0, 378.0, 0.0], "references/c1p0_06_2.pgx")
    assert rows["codestreams/p0_13.j2k"].graded_components == 4 and rows["codestreams/p1_04.j2k"].references.class0 == ["references/c0p1_04r0.pgx", "references/c0p1_04r3.pgx"]
    missing = [f for f in files if f[0] != "references/c1p0_06_2.pgx"]
    assert {x.codestream: x.faults for x in check_entries(manifest, made(missing)).where("size(faults) > 0").collect()} == {"codestreams/p0_06.j2k": ["reference"]}
    assert corpus_consistent(manifest.limit(22), made(files)).first().consistent is False
    few = conformance_manifest(spark.createDataFrame([(0, 5, head(2)), (0, 1, b""), (0, 2, None)], "profile int, index int, content binary"), bounds)
    assert {x.codestream[12:17]: x.faults for x in check_entries(few, made(files)).collect()} == {"p0_05": ["graded"], "p0_01": ["features"], "p0_02": ["features"]}
    none = conformance_manifest(spark.createDataFrame([], "profile int, index int, content binary"), bounds)
    assert check_entries(none, made(files)).count() == 0


def test_features_of_broken_headers():
    for data in (b"", b"\xff\x4f", b"\xff\x4f\xff\x51\x00\x01", b"\xff\x4f\xff\x51" + b"\x00" * 40, b"\xff\x4f\xff\x51\x00\x29" + b"\x01" * 10):
        with pytest.raises(ValueError):
            read_features(data)


def test_pgm_writer(spark):
    rows = [("a", 2, 1, 8, False, [0, 255]), ("wide", 2, 2, 8, False, [1]), ("deep", 1, 1, 12, False, [1]), ("none", 1, 1, 8, False, None), ("big", 1, 1, 8, False, [300])]
    got = {r.name: r.content for r in to_pgm(spark.createDataFrame(rows, "name string, width int, height int, bit_depth int, signed boolean, samples array<int>")).collect()}
    assert bytes(got.pop("a")) == write_pgm(np.array([[0, 255]])) and set(got.values()) == {None}


def test_headers_without_python(spark, mixed):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    h = with_headers(golden_streams(spark))
    assert "Python" not in plan(h.select("siz.x_size")) and "Python" in plan(h.select("header"))
    filtered = plan(h.where("siz.x_size > 4").select("name", "header"))
    assert filtered.index("ArrowEvalPython") < filtered.index("Filter")  # the filter stands below
    assert {r.name for r in supported(mixed).collect()} == {"g0", "g1", "g2", "cut", "zero"}
    faults = {r.name: r.error and r.error.kind for r in with_headers(mixed).select("name", "error").collect()}
    assert faults["g0"] is None and faults["null"] == "Codestream"


def test_absent_blocks(spark, mixed):
    zero = mixed.where("name = 'zero'")
    assert code_blocks(zero).count() == 0 and code_blocks(zero, absent=True).count() == 4


def test_choice_of_strategy(spark):
    small = golden_streams(spark)
    large = bytearray(vectors.wrapped("small_4x4"))
    large[8:16] = (2048).to_bytes(4) + (2048).to_bytes(4)
    assert choose(small) == "fused"
    assert choose(spark.createDataFrame([(bytes(large),)], "content binary")) == "exploded"
    assert choose(small.limit(0)) == "fused"


def test_files_snapshots_and_grades(spark, tmp_path):
    for n, *_ in vectors.GOLDEN_BLOCKS:
        (tmp_path / f"{n}.j2k").write_bytes(vectors.wrapped(n))
    (tmp_path / "lonely.j2k").write_bytes(b"junk")
    for r in to_snapshots(decode(golden_streams(spark)), "here", "none").collect():
        text = r.json
        if r.name == "sparse_8x8":
            text = text.replace('"mode"', '"odd":1,"mode"')  # an unknown key
        if r.name == "small_4x4":
            text = text.replace('"samples":[130', '"samples":[131')
        (tmp_path / f"{r.name}.expected.json").write_text(text)
    rows = read_fixtures(spark, str(tmp_path))
    assert [r.name for r in rows.collect()] == ["gradient_8x8", "lonely", "small_4x4", "sparse_8x8"]
    images = decode(rows.drop("expected", "max_abs_error"))
    fields = ("width", "height", "bit_depth", "signed", "samples", "error")
    graded = classify(images.select("name", F.struct(*fields).alias("actual")).join(rows.drop("content"), "name"))
    got = {r.name: (r.status, r.reason) for r in graded.collect()}
    assert got["gradient_8x8"] == ("Passed", None) and got["small_4x4"] == ("Failed", "sample 0")
    assert got["sparse_8x8"][0] == got["lonely"][0] == "LoadError"
    assert {r.status: r.n for r in summarize(graded).collect()} == {"Passed": 1, "Failed": 1, "LoadError": 2}
    assert read_codestreams(spark, str(tmp_path)).select("path", "length").count() == 4


def test_grib_sources(spark, tmp_path):
    two = _grib(vectors.wrapped("small_4x4")) + b"xx" + _grib(vectors.wrapped("sparse_8x8"))
    (tmp_path / "a.grib2").write_bytes(two)
    files = read_codestreams(spark, str(tmp_path), "*.grib2")
    images = decode(grib2_codestreams(files).where("error IS NULL").drop("error"))
    assert images_to_samples(images).count() == 16 + 64
    sql.register(spark)
    rows = spark.read.format("grib2_jpeg").load(str(tmp_path)).collect()
    assert [(r.message_index, r.error) for r in sorted(rows, key=lambda r: r.message_index)] == [(0, None), (1, None)]


def test_sql_function(spark):
    sql.register(spark)
    golden_streams(spark).createOrReplaceTempView("streams")
    got = spark.sql("SELECT name, gridwave_decode(content).width AS w, size(gridwave_decode(content).samples) AS n FROM streams ORDER BY name").collect()
    assert [(r.w, r.n) for r in got] == [(8, 64), (4, 16), (8, 64)]


def test_pgx_and_pgm_faults(spark):
    files = spark.createDataFrame([("ok", write_pgm(np.arange(6).reshape(2, 3))), ("note", b"P5 # c\n# d\n2 1 255\nab"), ("bad", b"P6\n1 1 255\nx"), ("null", None)], "path string, content binary")
    got = {r.path: r for r in pgm_images(files).collect()}
    assert got["ok"].samples == list(range(6)) and got["note"].samples == [97, 98] and got["bad"].error and got["null"].error
    bad = spark.createDataFrame([(str(i), b) for i, b in enumerate((b"PG ML 8 1 1\n", b"PG XX 8 1 1\nx", b"PG ML 33 1 1\nabcde", b""))], "path string, content binary")
    assert all(r.error for r in pgx_images(bad).collect())


def test_empty_table(spark):
    none = golden_streams(spark).limit(0)
    assert decode(none).count() == code_blocks(none).count() == decode(none, strategy="exploded").count() == 0
