"""Pseudonyms: a stand-in of the same format, computed from (seed, category, text) alone.

Eight hex digits of an MD5 at a time are the random numbers. So the same text gets the same stand-in in every task, run
and restart, no mapping has to be gathered, and any engine with MD5 gets the same values. `compat_mapping` gives one
stand-in per text, by the category that the text is first seen with, for the price of one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

SEED = 42
#: Ages of generated birth dates, counted back from this day unless another is given.
REFERENCE_DATE, YOUNGEST, OLDEST = "2025-01-01", 18, 90
# Domains and networks that are reserved or safe for examples.
DOMAINS = ("example.com", "testmail.org", "sample.net", "demo.org")
NETWORKS = ("192.0.2", "198.51.100")
FIRST_NAMES = ("Alex", "Bianca", "Carlos", "Diana", "Emil", "Farah", "Goran", "Helena", "Ivan", "Jonas", "Karin", "Luis", "Maya", "Nora", "Omar", "Paula")
LAST_NAMES = ("Abbott", "Berger", "Castro", "Dubois", "Ellis", "Fischer", "Garcia", "Hansen", "Ito", "Jensen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Petrov")
COMPANY_ENDS = ("Limited", "Group", "Holdings", "Partners")
STREETS = ("Maple Street", "Oak Avenue", "Cedar Lane", "Hill Road", "Lake Drive", "Park Way", "River Street", "Station Road")
CITIES = ("Ashford", "Brookfield", "Clinton", "Dover", "Easton", "Fairview", "Georgetown", "Hudson")


def number(digest: Column, i: int) -> Column:
    """The i-th 32-bit number of an MD5 in hex."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def digest(category: Column, text: Column, seed: int, more: str = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), category, F.lit("|"), text, F.lit(more)).cast("binary"))


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def padded(n: Column, width: int) -> Column:
    return F.lpad((n % 10**width).cast("string"), width, "0")


def _email(d: Column) -> Column:
    user = F.concat(F.lower(pick(FIRST_NAMES, number(d, 0))), F.lit("."), F.lower(pick(LAST_NAMES, number(d, 1))), (number(d, 2) % 100).cast("string"))
    return F.concat(user, F.lit("@"), pick(DOMAINS, number(d, 3)))


def _phone(d: Column, text: Column) -> Column:
    bare = F.regexp_replace(text, r"[\s\-()]", "")
    tail = padded(number(d, 1), 9)
    indian = F.concat(F.lit("+91 "), (number(d, 0) % 4 + 6).cast("string"), F.substring(tail, 1, 4), F.lit(" "), F.substring(tail, 5, 5))
    code = F.regexp_extract(text, r"^(\+\d{1,3})", 1)
    other = F.concat(F.when(code == "", "+1").otherwise(code), F.lit(" "), padded(number(d, 0), 4), F.lit(" "), padded(number(d, 1), 4))
    local = F.concat(F.lit("("), padded(number(d, 0), 3), F.lit(") "), padded(number(d, 1), 3), F.lit("-"), padded(number(d, 2), 4))
    return F.when(F.startswith(bare, F.lit("+91")), indian).when(F.startswith(bare, F.lit("+")), other).otherwise(local)


def _ssn(d: Column) -> Column:
    area = number(d, 0) % 898 + 1
    area = F.when(area >= 666, area + 1).otherwise(area)  # 666 does not exist
    group, serial = number(d, 1) % 99 + 1, number(d, 2) % 9999 + 1
    return F.concat_ws("-", padded(area, 3), padded(group, 2), padded(serial, 4))


def _card(d: Column) -> Column:
    body = F.concat(F.lit("4"), padded(number(d, 0), 7), padded(number(d, 1), 7))
    checks = lambda b: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(b, c.cast("string"))))
    return let(body, lambda b: F.concat(b, F.get(checks(b), F.lit(0)).cast("string")))


def _birth(d: Column, text: Column, reference: str) -> Column:
    days = F.lit(YOUNGEST * 366) + number(d, 0) % ((OLDEST - YOUNGEST) * 365)
    day = F.date_sub(F.lit(reference).cast("date"), days.cast("int"))
    formats = (
        (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
        (r"^\d{1,2}/\d{1,2}/\d{4}", "dd/MM/yyyy"),
        (r"^\d{1,2}-\d{1,2}-\d{4}", "dd-MM-yyyy"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}", "dd.MM.yyyy"),
        (r"[A-Za-z]", "MMMM dd, yyyy"),
    )
    out = F.date_format(day, "dd/MM/yyyy")
    for pattern, shape in reversed(formats):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.date_format(day, shape)).otherwise(out)
    return out


def pseudonym(text: Column, category: Column, seed: int = SEED, reference: str = REFERENCE_DATE) -> Column:
    """Stand-in of a text of a category; unknown categories become [REDACTED_<CATEGORY>]."""

    def made(d: Column) -> Column:
        last = pick(LAST_NAMES, number(d, 1))
        return (
            F.when(category == "EMAIL", _email(d))
            .when(category == "PHONE", _phone(d, text))
            .when(category == "SSN", _ssn(d))
            .when(category == "CREDIT_CARD", _card(d))
            .when(category == "DOB", _birth(d, text, reference))
            .when(category == "IP", F.concat(pick(NETWORKS, number(d, 0)), F.lit("."), (number(d, 1) % 254 + 1).cast("string")))
            .when(category == "PERSON", F.concat(pick(FIRST_NAMES, number(d, 0)), F.lit(" "), last))
            .when(category == "COMPANY", F.concat(last, F.lit(" "), pick(COMPANY_ENDS, number(d, 0))))
            .when(category == "ADDRESS", F.concat((number(d, 0) % 999 + 1).cast("string"), F.lit(" "), pick(STREETS, number(d, 1)), F.lit(", "), pick(CITIES, number(d, 2))))
            .otherwise(F.concat(F.lit("[REDACTED_"), category, F.lit("]")))
        )

    return let(digest(category, text, seed), made)


def with_fakes(matches: Column, seed: int = SEED, reference: str = REFERENCE_DATE) -> Column:
    """Matches with the field `fake`."""
    return F.transform(matches, lambda m: m.withField("fake", pseudonym(m["text"], m["category"], seed, reference)))


def mapping(found: DataFrame, seed: int = SEED, reference: str = REFERENCE_DATE) -> DataFrame:
    """(text, category, fake), one row per text and category of the rows (text, category)."""
    return found.select("text", "category").distinct().withColumn("fake", pseudonym(F.col("text"), F.col("category"), seed, reference))


def compat_mapping(found: DataFrame, order: list[str], seed: int = SEED, reference: str = REFERENCE_DATE) -> DataFrame:
    """(text, category, fake), one row per text: its category is that of its first row in `order`."""
    first = found.groupBy("text").agg(F.min_by("category", F.struct(*order)).alias("category"))
    return first.withColumn("fake", pseudonym(F.col("text"), F.col("category"), seed, reference))
