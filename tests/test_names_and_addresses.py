from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions.expressions import let, pieces
from spanforge.operators import address
from spanforge.operators.detect import collect_matches, exploded
from spanforge.operators.entities import NOT_COMPANIES, NOT_NAME_WORDS, NOT_PERSONS, clean_text, propose_entities, validate_company, validate_person
from spanforge.plans.samples import COMPANY_CASES, PERSON_CASES


def test_clean_text(spark):
    cases = {"Lindqvist Family Trust&": "Lindqvist Family Trust", "Tomas Okoro*^&": "Tomas Okoro", "Harbour Dues#": "Harbour Dues", "Okoro & Lindqvist LLP": "Okoro & Lindqvist LLP"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert [r[0] for r in rows.select(clean_text(F.col("raw"))).collect()] == list(cases.values())


def test_person_rules(spark):
    rows = spark.createDataFrame([(c[0], c[1]) for c in PERSON_CASES], "raw string, before string")
    got = rows.select(validate_person(F.col("raw"), F.col("before")).alias("v")).collect()
    for r, case in zip(got, PERSON_CASES, strict=True):
        assert tuple(r.v) == case[2:], case


def test_company_rules(spark):
    rows = spark.createDataFrame([(c[0],) for c in COMPANY_CASES], "raw string")
    got = rows.select(validate_company(F.col("raw")).alias("v")).collect()
    for r, case in zip(got, COMPANY_CASES, strict=True):
        assert tuple(r.v)[:4] == case[1:], case


def test_every_listed_text_is_rejected(spark):
    rows = spark.createDataFrame([(t.upper(),) for t in NOT_COMPANIES], "raw string")
    assert not any(r[0] for r in rows.select(validate_company(F.col("raw"))["accepted"]).collect())
    rows = spark.createDataFrame([(t,) for t in NOT_PERSONS] + [(f"Anna {w}",) for w in NOT_NAME_WORDS], "raw string")
    got = rows.select("raw", validate_person(F.col("raw"), F.lit("mr."))["accepted"].alias("a")).collect()
    assert {r.raw for r in got if r.a} == {"Anna limited", "Anna ltd", "Anna llp", "Anna inc", "Anna corp", "Anna foundation"}


def test_addresses(spark):
    long = "Prose goes on and on. " * 60 + "123, Waterloo Industrial Estate, Phase II, Bandra Kurla Complex, Mumbai 400051." + " More prose follows here." * 60
    rows = spark.createDataFrame([("Office at Plot 5, Industrial Estate, Pune - 411001",), ("The company is based in Pune.",), ("India has a large population.",), (long,)], "text string")
    full = exploded(collect_matches(rows, ["address"]).withColumnRenamed("text", "block"), "block").collect()
    assert len(full) == 2
    for r in full:
        assert r.block[r.start_char : r.end_char] == r.text and len(r.text) < 300 and r.needs_review


def brute_clusters(signals):
    out = []
    for s in sorted(signals, key=lambda s: s[0]):
        if out and s[0] - out[-1][2] <= 60:
            c = out[-1]
            out[-1] = (min(c[0], s[0]), max(c[1], s[1]), s[1], c[3] | s[2])
        else:
            out.append((s[0], s[1], s[1], s[2]))
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 600), st.integers(1, 40), st.sampled_from([1, 2, 4])), max_size=25))
def test_clusters(spark, raw):
    signals = [(s, s + n, k) for s, n, k in raw]
    rows = spark.createDataFrame([([{"start": s, "seq": i, "end": e, "kind": k} for i, (s, e, k) in enumerate(signals)],)], f"signals array<{address.SIGNAL}>")
    got = rows.select(let(F.array_sort("signals"), address.clusters)).first()[0]
    assert [tuple(c) for c in got] == brute_clusters(signals)


def brute_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    before = [m.end() for m in re.finditer(r"[.;\n]", text[:start])]
    after = re.search(r"[.;\n]", text[end:])
    a, b = (before[-1] if before else 0), (end + after.start() if after else len(text))
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (start, end) if b - a > 300 else (a, b)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["x ", ". ", ";", "\n", "  ", "abc", "y" * 90]), max_size=12).map("".join), st.lists(st.sampled_from(["z", " ", ".", "\n", "w" * 80]), max_size=10).map("".join))
def test_bounds(spark, left, right):
    text = f"{left}Plot 400051{right}"
    rows = spark.createDataFrame([(text,)], "text string")
    cluster = F.struct(F.lit(len(left)).alias("start"), F.lit(len(left) + 11).alias("end"))
    got = rows.select(address._bounded(F.col("text"), pieces(F.col("text")), cluster)).first()[0]
    assert tuple(got) == brute_bounds(text, len(left), len(left) + 11)


def test_five_words_before_each_name(spark):
    """Also where names follow one another, words are long, or a sentence has many short names."""
    names = "Signed by Asha Rao, Rohit Rao, Meera Shah and Dev Anand Rao"
    long = f"signed by {'w' * 200} Asha Rao and {'v' * 300} at {'u' * 90} by Rohit Rao"
    many = "by " + " of ".join(f"Na{chr(97 + i)}e Surname" for i in range(12))
    rows = spark.createDataFrame([(t,) for t in (names, long, many)], "text string")
    for r in rows.select("text", propose_entities(F.col("text")).alias("found")).collect():
        assert r.found
        for e in r.found:
            before = r.text[: e.start]
            words = re.findall(r"\S+(?=\s)", before) if before[-1:].isspace() else []
            assert re.split(r"\s+", e.preceding) == [w.lower() for w in words[-5:]] or (not words and e.preceding == "")
    matched = collect_matches(rows.where("text like 'Signed%'").withColumn("doc_id", F.lit("x")))
    sure = {m.text: m.confidence for m in exploded(matched).collect() if m.category == "PERSON"}
    assert sure["Rohit Rao"] == 0.9 and sure["Asha Rao"] == 0.9


def test_address_of_300_characters(spark):
    """A sentence of more than 300 characters is left at the signals' hull, one of 300 is taken."""
    for extra in (0, 1):
        text = "x" * (300 - 11 + extra - 1) + " Plot 400051"
        rows = spark.createDataFrame([(f"Before. {text}; after",)], "text string")
        got = rows.select(F.explode(address.detect_addresses(F.col("text"))).alias("m")).select("m.text").collect()
        assert [r[0] for r in got] == ["Plot 400051" if len(text) > 300 else text]
