"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from gridwave.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = contract.queries()[name](spark, SF)
    want = db.execute(contract.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    assert names == sorted(got.columns)
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(map(str, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
