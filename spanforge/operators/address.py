"""Address detector: nearby signals of different kinds make an address.

Signals are place entities, address keywords and postal codes. Signals whose gap to the signal before is at most 60
characters form a cluster; a cluster of two kinds or more becomes a span that reaches to the sentence's bounds, or just
over its signals if that would be longer than 300 characters. It is a session window folded over the block's own array,
so no row leaves its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.expressions import PIECE, empty, grown, let, nothing_grown, part, spans, whole, within
from ..schemas import MATCH

GAP, LONGEST, KINDS_NEEDED, CONFIDENCE = 60, 300, 2, 0.85
PLACE_LABELS = ("GPE", "LOC", "FAC")
SIGNAL = "struct<start:int,seq:int,end:int,kind:int>"
CLUSTER = "struct<start:int,end:int,last:int,kinds:int>"


def address_signals(text: Column, entities: Column | None = None) -> Column:
    """Place entities (bit 1), keywords (bit 2) and postal codes (bit 4), in order of start, then of this list."""

    def signal(seq: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(seq).alias("seq"), s["end"].alias("end"), F.lit(1 << seq).alias("kind"))

    parts = [F.transform(spans(text, P.ADDRESS_KEYWORD), signal(1)), F.transform(spans(text, P.POSTAL, F.regexp_like(text, F.lit(r"(?U)\d{5}"))), signal(2))]
    if entities is not None:
        places = F.filter(entities, lambda e: e["label"].isin(*PLACE_LABELS))
        parts.insert(0, F.transform(places, signal(0)))
    return F.array_sort(F.concat(*parts).cast(f"array<{SIGNAL}>"))


def clusters(signals: Column) -> Column:
    """Sessions of signals by the gap to the signal before (in order of start, not the furthest end)."""

    def fresh(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["end"].alias("last"), s["kind"].alias("kinds")).cast(CLUSTER)

    def step(state: Column, s: Column) -> Column:
        last = state["last"]
        joined = F.struct(
            F.least(last["start"], s["start"]).alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            s["end"].alias("last"),
            last["kinds"].bitwiseOR(s["kind"]).alias("kinds"),
        ).cast(CLUSTER)
        done, now = grown(state, last)
        near = s["start"] - last["last"] <= GAP
        stay = F.struct(state["done"].alias("done"), state["now"].alias("now"), joined.alias("last"))
        return F.when(near, stay).otherwise(F.struct(done, now, fresh(s).alias("last")))

    start = F.struct(*nothing_grown(CLUSTER), fresh(F.get(signals, F.lit(0))).alias("last"))
    rest = F.slice(signals, 2, F.size(signals))
    return F.when(F.size(signals) > 0, F.aggregate(rest, start, step, lambda state: F.array_append(whole(state), state["last"]))).otherwise(empty(CLUSTER))


def _bounded(text: Column, cut: Column, cluster: Column) -> Column:
    """The cluster's span, reaching to the bounds of its sentence, as struct<start,end>.

    The bounds are looked for in the nearest piece of the text, and only where that has none in all of it.
    """
    from_, to = F.greatest(cluster["start"] - PIECE, F.lit(0)), cluster["end"]
    ahead = r"(?s)^(.*[.;\n])"
    near = part(cut, from_, cluster["start"] - from_)
    far = F.length(F.regexp_extract(F.substring(text, F.lit(1), cluster["start"]), ahead, 1))
    left = F.when((from_ == 0) | F.regexp_like(near, F.lit(r"[.;\n]")), F.when(F.regexp_like(near, F.lit(r"[.;\n]")), from_ + F.length(F.regexp_extract(near, ahead, 1))).otherwise(0)).otherwise(far)
    behind = part(cut, to, F.lit(PIECE))
    right = to + F.when(F.regexp_like(behind, F.lit(r"[.;\n]")), F.length(F.regexp_extract(behind, r"^([^.;\n]*)", 1))).otherwise(F.length(F.regexp_extract(F.substr(text, to + 1), r"^([^.;\n]*)", 1)))

    def trimmed(bounds: Column) -> Column:
        wide = part(cut, bounds["left"], bounds["right"] - bounds["left"])
        return let(wide, lambda w: F.struct((bounds["left"] + F.length(w) - F.length(F.regexp_replace(w, r"(?U)^\s+", ""))).cast("int").alias("start"), (bounds["right"] - F.length(w) + F.length(F.regexp_replace(w, r"(?U)\s+\z", ""))).cast("int").alias("end")))

    hull = F.struct(cluster["start"].alias("start"), cluster["end"].alias("end"))
    bounds = F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"))
    return let(bounds, lambda x: let(trimmed(x), lambda r: F.when(r["end"] - r["start"] > LONGEST, hull).otherwise(r)))


def detect_addresses(text: Column, entities: Column | None = None) -> Column:
    """Address matches of a block, always for review."""

    def match(cut: Column, c: Column) -> Column:
        return let(
            _bounded(text, cut, c),
            lambda s: F.struct(
                part(cut, s["start"], s["end"] - s["start"]).alias("text"),
                F.lit("ADDRESS").alias("category"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(CONFIDENCE).alias("confidence"),
                F.lit(True).alias("needs_review"),
                F.lit("heuristic").alias("detector"),
                F.lit(0).alias("seq"),
            ),
        )

    strong = lambda found: F.filter(found, lambda c: F.bit_count(c["kinds"]) >= KINDS_NEEDED)
    found = let(address_signals(text, entities), lambda signals: strong(clusters(signals)))
    return within(text, found, lambda cut, some: F.filter(F.transform(some, lambda c: match(cut, c)), lambda m: m["start"] < m["end"]), MATCH)
