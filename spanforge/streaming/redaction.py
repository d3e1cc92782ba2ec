"""The redaction plan on streams.

Detecting, resolving and rewriting are map-only, so they run on a stream as on a table, without state. Counts use event
time windows with a watermark; first-seen texts are told apart within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import exploded
from ..plans.redaction import redact_blocks


def redact_stream(blocks: DataFrame, **options) -> DataFrame:
    """Redacted blocks of a stream of blocks, for append mode."""
    return redact_blocks(blocks, **options)


def windowed_counts(matched: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, category, n) of a stream of matched blocks with an event time; late rows beyond the watermark
    are left out."""
    rows = exploded(matched.withWatermark(time, late), time)
    spans = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(spans.alias("w"), "category").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "category", "n")


def session_counts(matched: DataFrame, key: str, time: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, n): matches per session of a key."""
    rows = exploded(matched.withWatermark(time, late), key, time)
    counted = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), "n")


def first_seen(matched: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows of texts and categories that were not seen within the watermark."""
    rows = exploded(matched.withWatermark(time, late), time)
    return rows.dropDuplicatesWithinWatermark(["category", "text"])


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files; with `available_now` it ends when the input that is there is done."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
