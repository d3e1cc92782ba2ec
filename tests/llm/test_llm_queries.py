"""Registered queries of the subpackage that have SQL equal it in DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import pytest

from spanforge.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings labels".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    expected = sorted(repr([str(v) for _, v in sorted(zip(names, r, strict=True))]) for r in found.fetchall())
    assert sorted(repr([str(v) for _, v in sorted(r.asDict().items())]) for r in got.collect()) == expected
