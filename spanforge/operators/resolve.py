"""Overlap resolution: of overlapping matches in a block one survives.

A fold in order of (start, end, emission) that compares each match with the last survivor only. The better one has the
lower detector rank (regex, ner, heuristic), then is longer, then is surer; on a tie the earlier stays. It is not the
best set overall, and it must run before categories are filtered: an unwanted match still displaces a wanted one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import grown, let, nothing_grown, whole
from ..schemas import MATCH

RANKS = {"regex": 0, "ner": 1, "heuristic": 2}
UNKNOWN_RANK = 1


def rank(detector: Column) -> Column:
    out = F.lit(UNKNOWN_RANK)
    for name, value in RANKS.items():
        out = F.when(detector == name, value).otherwise(out)
    return out


def _worth(m: Column) -> Column:
    return F.struct((-rank(m["detector"])).alias("r"), (m["end"] - m["start"]).alias("n"), m["confidence"].alias("c"))


def in_order(matches: Column) -> Column:
    """By start, end and emission; the other fields decide where these agree, so that no order of rows shows through."""

    def compare(a: Column, b: Column) -> Column:
        key = lambda m: F.struct(m["start"], m["end"], m["seq"], m)
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    return F.array_sort(matches, compare)


def resolve(matches: Column) -> Column:
    """Survivors of array<MATCH>, in order."""

    def step(state: Column, m: Column) -> Column:
        last = state["last"]
        clash = (last["start"] < m["end"]) & (m["start"] < last["end"])
        done, now = grown(state, last)
        put = F.struct(done, now, m.alias("last"))
        stay = F.struct(state["done"].alias("done"), state["now"].alias("now"), F.when(_worth(m) > _worth(last), m).otherwise(last).alias("last"))
        return F.when(clash, stay).otherwise(put)

    def fold(ordered: Column) -> Column:
        start = F.struct(*nothing_grown(MATCH), F.get(ordered, F.lit(0)).cast(MATCH).alias("last"))
        rest = F.slice(ordered, 2, F.size(ordered))
        return F.when(F.size(ordered) > 1, F.aggregate(rest, start, step, lambda state: F.array_append(whole(state), state["last"]))).otherwise(ordered)

    return let(in_order(matches), fold)


def only(matches: Column, categories: Iterable[str] | None) -> Column:
    """Matches of the wanted categories; none named means all. For use after `resolve`."""
    wanted = sorted({c.strip().upper() for c in categories or ()})
    return F.filter(matches, lambda m: m["category"].isin(*wanted)) if wanted else matches
