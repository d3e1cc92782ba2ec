"""Tables of texts as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rewrite import make_runs, run_text

#: White space of any kind is not enough for a block.
VISIBLE = r"(?U)\S"


def visible(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.regexp_like("text", F.lit(VISIBLE)))


#: Bytes of input per core below which rows are spread over all cores before costly detection.
SMALL_SHARE = 32 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small input dealt out over all cores by a key; a large one has enough splits and stays where it is.

    A small file often is one row group, which one task would read and work on alone.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(4 * cores, key) if size < SMALL_SHARE * cores else rows


def text_blocks(table: DataFrame, key: str, text: str = "text", *keep: str) -> DataFrame:
    """One block per row with text: (doc_id, block_seq, text, kept columns)."""
    rows = table.select(F.col(key).alias("doc_id"), F.lit(0).alias("block_seq"), F.col(text).alias("text"), *keep)
    return visible(rows)


def line_blocks(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One block per line with text; block_seq counts empty lines too."""
    lines = table.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("block_seq", "text"))
    return visible(lines)


def run_blocks(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One block per row whose runs are the lines, each with its line feed."""
    runs = make_runs(F.split(text, r"(?<=\n)"))
    rows = table.select(F.col(key).alias("doc_id"), F.lit(0).alias("block_seq"), runs.alias("runs"))
    return visible(rows.withColumn("text", run_text(F.col("runs"))))
