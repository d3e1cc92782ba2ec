"""Queries on texts where their SQL, which frames spans by characters, and look-around part: both must give the same rows."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanforge.operators import structured
from spanforge.plans.oracles import ORACLES
from spanforge.plans.queries import QUERIES

TEXTS = [
    None, "", " ", "plain",
    "a@b.co c@d.org e@f.net", "x@y.co, z@w.co", "a@b.co\n", "mail a@b.com.", "éva@b.co", "a@b‿c.de", "x²@b.co",
    "10.0.0.1 10.0.0.2 10.0.0.3", "10.0.0.1, 10.0.0.2", "1.2.3.4.\n", "1.2.3.4.", "v.1.2.3.4", "256.1.1.1 1.1.1.1", "١.2.3.4.5",
    "+91 20 4505 3237 +91 20 4505 3238", "+44 20 7946 0958\x0b+44 20\x0b7946 0958", "555-123-4567 555-123-4568", "+1 555 123 4567",
    "9876543210", "call 7470461894 or +91 98765 43210", "+1 (555) 123-4567 8", "١+91 20 4505 3237",
    "4028005252517056 27", "4111111111111111 4111111111111111", "4111 1111 1111 1111 4111-1111-1111-1111", "1" * 20000, "1" * 30 + " 1",
    "4111111111111111,4111111111111111", "١" * 16, "192.168.100.100 4111111111111111", "+4111 1111 1111 1111", "+1 411 111 1111 1111",
]
PIECES = ["a@b.co", "c@d.org", "10.1.2.3", "1", "23", "4567", "4111111111111111", "+91", "98765", "43210", "9876543210", "555", "(555)", "123", " ", " ", "-", ".", ",", "\n", "é", "́", "٣", "\x0b", "\x85"]
NAMES = ["email_spans", "ip_spans", "phone_international", "phone_us", "phone_priority", "card_candidates", "card_luhn", "redacted_emails", "structured_counts", "occurrence_counts", "category_rollup", "category_share", "quality_join", "stream_redaction"]


def rows(names, found):
    return sorted(repr([str(r[n]) for n in sorted(names)]) for r in found)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder with documents and labels of odd texts, and DuckDB's views of them."""
    rng, folder, duck = random.Random(7), tmp_path_factory.mktemp("odd"), duckdb.connect()
    texts = TEXTS + ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(4000)]
    ids = list(range(len(texts)))
    made = {
        "documents": pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": [("en", "de", None)[i % 3] for i in ids]}),
        "labels": pa.table({"doc_id": pa.array(ids[::2], pa.int64()), "quality": [i % 4 // 2 for i in ids[::2]], "toxic": [i % 3 // 2 for i in ids[::2]]}),
    }
    for name, table in made.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), duck


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, odd, name):
    folder, duck = odd
    got = QUERIES[name](spark, folder)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert expected and sorted(names) == sorted(got.columns)
    assert rows(names, got.collect()) == rows(names, expected)


def test_ip_in_digits_of_any_script(spark):
    """The operator takes them as the pattern does; a cast to int stopped the whole run."""
    made = spark.createDataFrame([("from ١٠.2.3.٤",), ("٩٩٩.1.1.1",)], "text string")
    got = [[s.text for s in r[0]] for r in made.select(structured.ip_spans(F.col("text"))).collect()]
    assert got == [["١٠.2.3.٤"], []]
