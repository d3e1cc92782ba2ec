"""Detectors of structured entities: e-mail, phone, IP, card, social-security number, date of birth.

Each takes the text column of a block and returns an array of matches; everything runs inside the JVM on the block's
own row. The order of emission (email, phone, ip, card, ssn, dob) decides ties later.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.expressions import around, as_match, empty, grown, let, nothing_grown, numbered, spans, whole, within
from ..schemas import MATCH, SPAN

#: Any decimal digit; texts without one skip the patterns that need it.
DIGIT = r"(?U)\d"
#: Decimal digits of all scripts, which patterns take and casts don't, and their values.
ALL_DIGITS = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Nd")
VALUES = "".join(str(unicodedata.decimal(c)) for c in ALL_DIGITS)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def has_digit(text: Column) -> Column:
    return F.regexp_like(text, F.lit(DIGIT))


def email_spans(text: Column, pattern: str | tuple[str, str, str] = P.EMAIL) -> Column:
    return spans(text, pattern, F.contains(text, F.lit("@")))


def ip_spans(text: Column, pattern: str | tuple[str, str, str] = P.IP) -> Column:
    small = lambda s: F.forall(F.split(F.translate(s["text"], ALL_DIGITS, VALUES), r"\."), lambda octet: octet.cast("int") <= 255)
    return F.filter(spans(text, pattern, has_digit(text)), small)


def card_candidates(text: Column, pattern: str | tuple[str, str, str] = P.CARD) -> Column:
    return spans(text, pattern, has_digit(text))


def parted(text: Column) -> Column:
    """The text with a second blank behind a long run of digits, so that two cards that one blank parts are both framed
    and a number behind a card does not become part of it. Offsets are those of this text."""
    return F.regexp_replace(text, r"(?<!\d)(\d{14,}+) ", "$1  ")


def card_spans(text: Column, pattern: str | tuple[str, str, str] = P.CARD) -> Column:
    def fine(s: Column) -> Column:
        bare = F.regexp_replace(s["text"], "[ -]", "")
        return F.length(bare).between(13, 19) & F.call_function("luhn_check", bare)

    return F.filter(card_candidates(text, pattern), fine)


def ssn_spans(text: Column) -> Column:
    return spans(text, P.SSN, F.contains(text, F.lit("-")))


def phone_kinds(text: Column) -> list[Column]:
    """International, bare ten-digit and US candidates, in this order of priority, each with 7 to 15 digits."""
    fits = lambda s: F.length(digits(s["text"])).between(7, 15)
    kinds = ((P.PHONE_INTERNATIONAL, F.contains(text, F.lit("+"))), (P.PHONE_TEN_DIGITS, has_digit(text)), (P.PHONE_US, has_digit(text)))
    return [F.filter(spans(text, kind, hint), fits) for kind, hint in kinds]


def outside(found: Column, taken: Column) -> Column:
    """`found` without spans whose start or end lies in one of `taken`; what strictly contains one stays.

    Neither side overlaps itself. One pass over both in order of start: a span waits until the next ones of `taken` have
    shown whether its end lies in one.
    """
    both = F.array_sort(F.concat(F.transform(taken, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("side"), s.alias("s"))), F.transform(found, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("side"), s.alias("s")))))

    def step(state: Column, event: Column) -> Column:
        s, last, waiting = event["s"], state["last"], state["waiting"]
        ends_inside = (s["start"] < waiting["end"]) & (waiting["end"] <= s["end"])
        begins_inside = ((last["start"] <= s["start"]) & (s["start"] < last["end"])) | ((last["start"] < s["end"]) & (s["end"] <= last["end"]))
        kept, done = waiting.isNotNull(), grown(state, waiting)
        taken_next = F.struct(state["done"].alias("done"), state["now"].alias("now"), s.alias("last"), F.when(~F.coalesce(ends_inside, F.lit(False)), waiting).alias("waiting"))
        found_next = F.struct(F.when(kept, done[0]).otherwise(state["done"]).alias("done"), F.when(kept, done[1]).otherwise(state["now"]).alias("now"), last.alias("last"), F.when(~F.coalesce(begins_inside, F.lit(False)), s).alias("waiting"))
        return F.when(event["side"] == 0, taken_next).otherwise(found_next)

    none = F.lit(None).cast(SPAN)
    start = F.struct(*nothing_grown(SPAN), none.alias("last"), none.alias("waiting"))
    rest = F.aggregate(both, start, step, lambda state: F.concat(whole(state), F.filter(F.array(state["waiting"]), lambda s: s.isNotNull())))
    return F.when((F.size(taken) > 0) & (F.size(found) > 0), rest).otherwise(found)


def phone_spans(text: Column) -> Column:
    """Candidates in order of priority; one whose start or end lies in a span that was taken before goes, and so does
    one without 7 to 15 digits. A candidate that strictly contains an earlier span stays."""
    international, ten, us = phone_kinds(text)
    return let(international, lambda a: let(outside(ten, a), lambda b: F.concat(a, b, outside(outside(us, a), b))))


def framed_phone_spans(text: Column) -> Column:
    """International and US numbers in their framed forms, the latter where neither end lies in one of the former: what
    the queries' SQL states. It knows no bare ten-digit numbers; `phone_spans` does."""
    international = spans(text, P.FRAMED_INTERNATIONAL, F.contains(text, F.lit("+")))
    return let(international, lambda a: F.concat(a, outside(spans(text, P.FRAMED_US, has_digit(text)), a)))


def date_spans(text: Column) -> Column:
    """Date-shaped strings; equal spans count once, overlapping ones are left to the resolver."""
    return F.array_distinct(F.concat(*[spans(text, p, has_digit(text)) for p in P.DATES]))


def birth_spans(text: Column) -> Column:
    """Dates with a birth word within 100 characters."""
    near = lambda cut: lambda s: F.regexp_like(around(cut, s, 100), F.lit(P.BIRTH_CONTEXT))
    dates = within(text, date_spans(text), lambda cut, found: F.filter(found, near(cut)))
    return F.when(F.regexp_like(text, F.lit(P.BIRTH_CONTEXT)), dates).otherwise(empty(SPAN))


def ssn_confidence(cut: Column, span: Column) -> Column:
    """0.95 with a keyword within 50 characters, else 0.80; of a text in pieces."""
    return F.when(F.regexp_like(around(cut, span, 50), F.lit(P.SSN_CONTEXT)), 0.95).otherwise(0.80)


def detect_emails(text: Column, pattern: str | tuple[str, str, str] = P.EMAIL) -> Column:
    return F.transform(email_spans(text, pattern), lambda s: as_match(s, "EMAIL", 1.0, "regex"))


def detect_phones(text: Column) -> Column:
    return F.transform(phone_spans(text), lambda s: as_match(s, "PHONE", 1.0, "regex"))


def detect_ips(text: Column) -> Column:
    return F.transform(ip_spans(text), lambda s: as_match(s, "IP", 1.0, "regex"))


def detect_cards(text: Column) -> Column:
    return F.transform(card_spans(text), lambda s: as_match(s, "CREDIT_CARD", 1.0, "regex"))


def detect_ssns(text: Column) -> Column:
    return within(text, ssn_spans(text), lambda cut, found: F.transform(found, lambda s: as_match(s, "SSN", ssn_confidence(cut, s), "regex")), MATCH)


def detect_births(text: Column) -> Column:
    return F.transform(birth_spans(text), lambda s: as_match(s, "DOB", 0.9, "regex"))


DETECTORS = {
    "EMAIL": detect_emails,
    "PHONE": detect_phones,
    "IP": detect_ips,
    "CREDIT_CARD": detect_cards,
    "SSN": detect_ssns,
    "DOB": detect_births,
}


def register_detector(category: str, detect) -> None:
    """Add a detector (from the text column to an array of matches) after those that are there."""
    DETECTORS[category] = detect


def detect_structured(text: Column) -> Column:
    """All structured matches of a block, numbered in order of emission; a null block has none."""
    return let(F.coalesce(text, F.lit("")), lambda t: numbered(F.concat(*[detect(t) for detect in DETECTORS.values()])))


def framed_structured(text: Column) -> Column:
    """(category, text) of the kinds that the queries' SQL states, in their framed forms and without resolution: e-mail,
    IP, international and US phones, cards."""
    found = {"EMAIL": email_spans(text, P.FRAMED_EMAIL), "IP": ip_spans(text, P.FRAMED_IP), "PHONE": framed_phone_spans(text), "CREDIT_CARD": card_spans(parted(text), P.FRAMED_CARD)}
    of = lambda category: lambda s: F.struct(F.lit(category).alias("category"), s["text"].alias("text"))
    return F.concat(*[F.transform(s, of(category)) for category, s in found.items()])
