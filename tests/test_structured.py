"""Structured detectors: literals, agreement with Python's `re`, and the phone rule."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import expressions as X
from spanforge.functions.expressions import part, pieces, running_sums, spans
from spanforge.operators import structured

CASES = [
    ("EMAIL", "Send to cs.connect@kshinternational.com please", ["cs.connect@kshinternational.com"]),
    ("EMAIL", "user@mail.example.co.uk", ["user@mail.example.co.uk"]),
    ("EMAIL", "test+filter@example.com", ["test+filter@example.com"]),
    ("EMAIL", "not_an_email missing@", []),
    ("EMAIL", "mail a@b.com.", []),
    ("EMAIL", "/a.b@c.d", ["b@c.d"]),
    ("EMAIL", "a@b.co-x.", ["a@b.co"]),
    ("EMAIL", "x@y.co, z@w.co", ["x@y.co", "z@w.co"]),
    ("PHONE", "+91 20 4505 3237", ["+91 20 4505 3237"]),
    ("PHONE", "(555) 123-4567", ["(555) 123-4567"]),
    ("PHONE", "9876543210", ["9876543210"]),
    ("PHONE", "+91 98765 43210", ["+91 98765 43210"]),
    ("PHONE", "+91 9876543210", ["9876543210"]),
    ("PHONE", "123", []),
    ("PHONE", "9999999999999999", []),
    ("IP", "Server at 192.168.1.1", ["192.168.1.1"]),
    ("IP", "0.0.0.0 and 127.0.0.1", ["0.0.0.0", "127.0.0.1"]),
    ("IP", "999.999.999.999 256.0.0.1", []),
    ("CREDIT_CARD", "Card: 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("CREDIT_CARD", "5500005555555559", ["5500005555555559"]),
    ("CREDIT_CARD", "4111-1111-1111-1111 4111111111111111", ["4111-1111-1111-1111", "4111111111111111"]),
    ("CREDIT_CARD", "1234 5678 9012 3456 123456789012", []),
    ("SSN", "SSN: 123-45-6789", ["123-45-6789"]),
    ("SSN", "Reference 234-56-7890", ["234-56-7890"]),
    ("SSN", "000-00-0000 123456789 666-12-3456", []),
    ("DOB", "DOB: 15/03/1985", ["15/03/1985"]),
    ("DOB", "Born: 01 January 1990", ["01 January 1990"]),
    ("DOB", "Date of Birth: 22/07/1978", ["22/07/1978"]),
    ("DOB", "Filed on 15/03/1985 with the authority", []),
    ("DOB", "Born " + "x" * 120 + " 15/03/1985", []),
    ("EMAIL", None, []),
    ("IP", "", []),
]


def test_literals(spark):
    rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, text string")
    found = {r.i: r.m for r in rows.select("i", structured.detect_structured(F.col("text")).alias("m")).collect()}
    for i, (category, text, expected) in enumerate(CASES):
        mine = [m for m in found[i] if m.category == category]
        assert [m.text for m in mine] == expected, text
        assert all(text[m.start : m.end] == m.text for m in mine)
        assert [m.seq for m in found[i]] == list(range(len(found[i])))


def test_ssn_confidence(spark):
    rows = spark.createDataFrame([("SSN 523-45-6789",), ("Reference 234-56-7890",), ("x" * 40 + " Tax ID: 523-45-6789",)], "text string")
    got = [r[0] for r in rows.select(structured.detect_ssns(F.col("text"))[0]["confidence"]).collect()]
    assert got == [0.95, 0.80, 0.95]


def test_long_text_and_marks(spark):
    long = ("word " * 60_000) + "a@b.co"
    rows = spark.createDataFrame([(long,), ("\u0001a@b.co\u0002 c@d.org",)], "text string")
    got = [[(s.text, s.start) for s in r[0]] for r in rows.select(structured.email_spans(F.col("text"))).collect()]
    assert got == [[("a@b.co", 300_000)], [("a@b.co", 1), ("c@d.org", 9)]]


def python_pattern(java: str) -> re.Pattern:
    flags, body = re.match(r"\(\?(\w+)\)(.*)", java, re.S).groups()
    return re.compile(body, re.IGNORECASE if "i" in flags else 0)


PATTERNS = [P.EMAIL, P.PHONE_INTERNATIONAL, P.PHONE_TEN_DIGITS, P.PHONE_US, P.IP, P.CARD, P.SSN, *P.DATES, P.ADDRESS_KEYWORD, P.POSTAL]
PIECES = ["1", "23", "4567", "-", ".", " ", "+", "(", ")", "@", "a", "é", "b.co", "May", "12", "1999", "/", "street", "po box", "Ünit", "٣", "\n", "😀"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=40))
def test_dialects_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", *[spans(F.col("text"), p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    for row in got:
        for i, p in enumerate(PATTERNS):
            expected = [(m[0], m.start(), m.end()) for m in python_pattern(p).finditer(row.text)]
            assert [tuple(s) for s in row[f"p{i}"]] == expected, (row.text, p)


def brute_phones(text: str) -> list[tuple[int, int]]:
    taken: list[tuple[int, int]] = []
    for p in (P.PHONE_INTERNATIONAL, P.PHONE_TEN_DIGITS, P.PHONE_US):
        for m in python_pattern(p).finditer(text):
            clash = any(s <= m.start() < e or s < m.end() <= e for s, e in taken)
            if not clash and 7 <= sum(map(str.isdecimal, m[0])) <= 15:
                taken.append(m.span())
    return taken


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["+91", "98765", "43210", "555", "123", "4567", " ", "-", "9876543210", "(555)"]), max_size=12).map("".join), min_size=1, max_size=40))
def test_phone_priority(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in rows.select("text", structured.phone_spans(F.col("text")).alias("s")).collect():
        assert [(s.start, s.end) for s in row.s] == brute_phones(row.text)


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "+" * 1000, "1." * 2000])
def test_hard_texts_end(spark, text):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(structured.detect_structured(F.col("text"))).count() == 1


def test_parts_of_long_texts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(X.PIECE * X.PIECES + X.PIECE + 77))
    cuts = [(0, 0), (0, 5), (X.PIECE - 1, 2), (X.PIECE, X.PIECE), (X.PIECE * X.PIECES - 3, 7), (len(text) - 2, 2), (5, 3 * X.PIECE)]
    rows = spark.createDataFrame([(text,)], "text string")
    got = rows.select([part(pieces(F.col("text")), F.lit(a), F.lit(n)) for a, n in cuts]).first()
    assert list(got) == [text[a : a + n] for a, n in cuts]
    numbers = list(range(1000))
    sums = spark.createDataFrame([(numbers,), ([],)], "n array<int>").select(running_sums(F.col("n"))).collect()
    assert [r[0] for r in sums] == [[sum(numbers[:i]) for i in range(1001)], [0]]


@pytest.mark.parametrize("kind", ["ip", "phone", "ssn"])
def test_many_matches_in_one_text(spark, kind):
    """12,000 matches in one text come whole, in time that follows the text."""
    import time

    made, find = {"ip": ("10.1.2.{} ", structured.ip_spans), "phone": ("555-123-4{:03d} +49 (30) 555-01{:02d} ", structured.phone_spans), "ssn": ("SSN 123-45-6{:03d} ", structured.detect_ssns)}[kind]
    took = []
    for n in (3_000, 12_000):
        each = 1 if kind != "phone" else 2
        text = "".join(made.format(i % 100, i % 100) for i in range(n // each))
        began = time.time()
        found = spark.createDataFrame([(text,)], "text string").select(F.explode(find(F.col("text"))).alias("s")).select("s.*").collect()
        took.append(time.time() - began)
        assert len(found) == n and all(text[r.start : r.end] == r.text for r in found)
    assert took[1] < 10 * took[0] + 2
