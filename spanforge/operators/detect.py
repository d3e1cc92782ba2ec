"""From blocks to resolved matches: one map-only stage per block."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import each, let, numbered
from .address import detect_addresses
from .entities import detect_companies, detect_persons, propose_entities
from .resolve import only, resolve
from .structured import DETECTORS

#: A source of entities: from the text column to array<struct<text,label,start,end,preceding>>.
EntitySource = Callable[[Column], Column]


def all_matches(text: Column, entities: Column | None = None) -> Column:
    """Matches of all detectors in order of emission: structured ones, persons, companies, addresses."""
    parts = [detect(text) for detect in DETECTORS.values()]
    if entities is not None:
        parts += [detect_persons(entities), detect_companies(entities)]
    return numbered(F.concat(*parts, detect_addresses(text, entities)))


def collect_matches(blocks: DataFrame, categories: Iterable[str] | None = None, entities: EntitySource | str | None = propose_entities) -> DataFrame:
    """blocks plus `matches`, resolved and then filtered by category.

    `entities`: a source, the name of a column that a model has filled, or None for none. The entities are computed
    once per block and serve persons, companies and addresses.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if entities is None:
        found = let(text, lambda t: all_matches(t))
    elif isinstance(entities, str):
        found = let(text, lambda t: all_matches(t, F.col(entities)))
    else:
        found = let(text, lambda t: let(entities(t), lambda e: all_matches(t, e)))
    out = blocks.withColumn("matches", resolve(found))
    return out.withColumn("matches", only(F.col("matches"), categories))


def exploded(matched: DataFrame, *columns: str) -> DataFrame:
    """One row per match: `columns` of the block and the match's fields."""
    names = {"start": "start_char", "end": "end_char"}
    fields = ("text", "category", "start", "end", "confidence", "needs_review", "detector", "seq")
    rows = each(matched, F.col("matches"), "m", *columns)
    return rows.select(*columns, *[F.col("m")[f].alias(names.get(f, f)) for f in fields])
