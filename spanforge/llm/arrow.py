"""Helpers for operators that work on Arrow batches inside Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step inside a worker handles at once. A single longer text is one step.
STEP_BYTES = 2 << 20


def steps(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about `most` bytes of the string column, keeping every row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(starts, starts[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its offsets (rows + 1, from 0). A null has no bytes."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pa.array(column.fill_null("") if column.null_count else column, pa.large_string())
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def map_steps(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: int = 1, most: int = STEP_BYTES) -> DataFrame:
    """Apply `step` to slices of bounded size; map-only, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, column, most):
            yield step(part)

    return df.mapInArrow(run, schema)


def ids_and_texts(documents: DataFrame) -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
