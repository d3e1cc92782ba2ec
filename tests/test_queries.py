"""Every registered query with SQL equals it in DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from spanforge.plans.oracles import ORACLES
from spanforge.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def shown(rows, names):
    return sorted(repr([str(r[n]) for n in sorted(names)]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in got.collect()]
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert sorted(names) == sorted(got.columns)
        assert shown(rows, names) == shown(expected, names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
