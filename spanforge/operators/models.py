"""Entities by a trained model: any model that marks spans in texts, loaded once in each worker and run on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import ENTITY

#: A model: for each of many texts, (text, label, start, end) of its entities, offsets in code points.
Model = Callable[[list[str]], list[list[tuple[str, str, int, int]]]]
#: What makes the model in a worker; it is sent there, so it should hold names and paths rather than weights.
Loader = Callable[[], Model]
#: Words before an entity that validators see.
BEFORE = 5
#: Characters that are put into a model at once.
BATCH = 1 << 18


def preceding(text: str, start: int) -> str:
    """The last words before a place, in lower case; read backwards, so that a long text costs no more."""
    found, at = [], start
    while len(found) < BEFORE and at:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        at = end
        while at and not text[at - 1].isspace():
            at -= 1
        if at < end:
            found.append(text[at:end])
    return " ".join(reversed(found)).lower()


def with_entities(blocks: DataFrame, load: Loader, column: str = "entities") -> DataFrame:
    """blocks plus the model's entities, for `collect_matches(..., entities=column)`. A null text has none."""

    @F.pandas_udf(f"array<{ENTITY}>")
    def marked(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in series:
            given, out, at = [t or "" for t in texts], [], 0
            while at < len(given):
                end, size = at, 0
                while end < len(given) and (end == at or size < BATCH):
                    size += len(given[end])
                    end += 1
                for text, found in zip(given[at:end], model(given[at:end]), strict=True):
                    out.append([{"text": name, "label": label, "start": start, "end": stop, "preceding": preceding(text, start)} for name, label, start, stop in found])
                at = end
            yield pd.Series(out, index=texts.index, dtype=object)

    return blocks.withColumn(column, marked(F.col("text")))


def spacy_loader(name: str) -> Loader:
    """A loader of an installed spaCy model; without it the worker fails and says what is missing."""

    def load() -> Model:
        try:
            import spacy

            pipeline = spacy.load(name)
        except (ImportError, OSError) as e:
            raise RuntimeError(f"the entity model {name!r} is not installed on this worker: {e}") from e
        pipeline.max_length = 1 << 30
        return lambda texts: [[(e.text, e.label_, e.start_char, e.end_char) for e in doc.ents] for doc in pipeline.pipe(texts)]

    return load

