"""Tables of samples put together to tiles and encoded."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from gridwave import queries
from gridwave.codec import grid


@pytest.mark.parametrize("tiles", (200, 2000))
def test_a_batch_of_tiles_takes_little_more_than_its_bytes(spark, monkeypatch, tiles):
    """What Python allocates for a batch does not grow with its samples (240 bytes for each of them as objects)."""
    held, seen = [], []
    empty = spark.createDataFrame([], "g long, x int, y int, v int")
    with monkeypatch.context() as m:
        m.setattr(type(empty), "mapInArrow", lambda self, run, schema: held.append(run))
        queries.encode_tiles(empty, "g", 32, 32)
    monkeypatch.setattr(grid, "encode", lambda a, **how: seen.append(int(a[31, 1])) or b"stream")
    at = np.arange(tiles * 1024, dtype=np.int32)
    samples = pa.StructArray.from_arrays([pa.array(at % 32), pa.array(at // 32 % 32), pa.array(at // 1024)], ["x", "y", "v"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(tiles), pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, tiles * 1024 + 1, 1024), pa.int32()), samples)], ["g", "s"])
    tracemalloc.start()
    try:
        made = list(held[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in made) == tiles and seen == list(range(tiles))
    assert most < 2 << 20


def test_samples_with_nulls_and_sparse_tiles_are_zero(spark):
    rows = [(0, 0, 0, 7), (0, 1, 2, None), (0, 3, None, 9), (0, None, 1, 9), (1, 3, 3, 5), (None, None, None, 4), (2, 0, 0, None)]
    made = queries.encode_tiles(spark.createDataFrame(rows, "g long, x int, y int, v int"), "g", 4, 4, depth=8, levels=1).collect()
    got = {r.g: grid.decode(bytes(r.content))[1] for r in made}
    assert len(made) == 4
    assert {g: {(int(x), int(y)): int(a[y, x]) for y, x in zip(*np.nonzero(a))} for g, a in got.items()} == {0: {(0, 0): 7}, 1: {(3, 3): 5}, 2: {}, None: {}}


@pytest.mark.parametrize("name", ("roundtrip_53_pyramid", "roundtrip_53_exploded", "roundtrip_97_pyramid"))
def test_tiles_of_events_without_values_as_sql(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.selectExpr("nullif(event_id, 5) AS event_id", "CASE WHEN event_id % 3 > 0 THEN value END AS value").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in contract.queries()[name](spark, str(tmp_path)).select(*names).collect())
