"""Rewriting: stand-ins take the place of spans in plain text or in runs of formatted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import let, part, pieces, running_sums
from ..schemas import RUN


def rewrite_text(text: Column, matches: Column) -> Column:
    """The text with each match's `fake` in place; matches are resolved and in order. One without a fake is skipped."""

    def put(cut: Column, used: Column) -> Column:
        after = lambda i: F.coalesce(F.get(used, i - 1)["end"], F.lit(0))
        filled = F.transform(used, lambda m, i: F.concat(part(cut, after(i), m["start"] - after(i)), m["fake"]))
        rest = after(F.size(used))
        return F.concat(F.array_join(filled, ""), part(cut, rest, F.length(text) - rest))

    chosen = F.filter(matches, lambda m: m["fake"].isNotNull())
    return let(chosen, lambda used: F.when(F.size(used) > 0, let(pieces(text), lambda cut: put(cut, used))).otherwise(text))


def run_starts(texts: Column) -> Column:
    """Offsets at which runs of text start: the sum of the lengths before each."""
    return let(running_sums(F.transform(texts, F.length)), lambda s: F.slice(s, 1, F.size(s) - 1))


def make_runs(texts: Column) -> Column:
    """array<RUN> of run texts, without attributes."""

    def build(starts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(i.alias("idx"), t.alias("text"), F.get(starts, i).alias("start"), F.lit(None).cast("map<string,string>").alias("attrs")))

    return let(run_starts(texts), build).cast(f"array<{RUN}>")


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def rewrite_runs(runs: Column, matches: Column) -> Column:
    """Runs with each match's `fake` in the first run that the match touches; the others lose what it covers and keep
    the rest, and all keep their attributes. A block without runs stays without."""
    used = F.filter(matches, lambda m: m["fake"].isNotNull())

    def rewritten(run: Column) -> Column:
        start, end = run["start"], run["start"] + F.length(run["text"])

        def step(acc: Column, m: Column) -> Column:
            gap = F.substring(run["text"], acc["at"] - start + 1, F.greatest(m["start"], acc["at"]) - acc["at"])
            put = F.when(m["start"] >= start, m["fake"]).otherwise("")
            return F.struct(F.least(m["end"], end).alias("at"), F.concat(acc["out"], gap, put).alias("out"))

        here = F.filter(used, lambda m: (m["start"] < end) & (start < m["end"]))
        first = F.struct(start.alias("at"), F.lit("").alias("out"))
        return F.aggregate(here, first, step, lambda acc: F.concat(acc["out"], F.substring(run["text"], acc["at"] - start + 1, end - acc["at"])))

    return F.transform(runs, lambda r: r.withField("text", rewritten(r)))
