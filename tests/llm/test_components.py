import os
import random

import pytest

from gridwave.llm import store
from gridwave.llm.components import components
from gridwave.llm.store import Scratch, released, shared_dir


def test_paths_stars_and_loops(spark):
    r = random.Random(4)
    path = list(range(100, 160))
    r.shuffle(path)
    edges = list(zip(path, path[1:])) + [(999, i) for i in range(10)] + [(5, 5), (7, 7), (2000, 2001), (2001, 2000)]
    got = {x.c: x.root for x in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in path}) == 1
    assert len({got[i] for i in (999, *range(10))}) == 1
    assert len({got[i] for i in (100, 999, 2000)}) == 3


def test_no_edges(spark):
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_go_with_their_block(spark, tmp_path, monkeypatch):
    folder = lambda: sorted(os.listdir(f"{tmp_path}/gridwave")) if os.path.isdir(f"{tmp_path}/gridwave") else []
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    with released():
        Scratch(spark, "one").table(spark.range(3), "t")
        with released():
            Scratch(spark, "two").table(spark.range(3), "t")
        assert [f[:3] for f in folder()] == ["one"]
    assert folder() == []
    kept = Scratch(spark, "kept")
    kept.table(spark.range(3), "a")
    kept.table(spark.range(3), "b")
    kept.drop("a")
    assert os.listdir(f"{tmp_path}/gridwave/{folder()[0]}") == ["b"]
    kept.release()
    assert folder() == []



def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
