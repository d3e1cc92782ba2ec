"""From blocks to rewritten blocks: detect, resolve, filter, replace and rewrite in one map-only stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import where_computed
from ..operators.detect import EntitySource, collect_matches, exploded
from ..operators.entities import propose_entities
from ..operators.models import Loader, with_entities
from ..operators.pseudonym import REFERENCE_DATE, SEED, with_fakes
from ..operators.rewrite import rewrite_runs, rewrite_text
from ..schemas import CATEGORIES
from ..sources import docx, records


def wanted_categories(names: str | Iterable[str] | None) -> list[str]:
    """Categories of a comma-separated list, upper case and trimmed; an unknown one is an error."""
    given = names.split(",") if isinstance(names, str) else list(names or ())
    wanted = [n.strip().upper() for n in given if n.strip()]
    if unknown := sorted(set(wanted) - set(CATEGORIES)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return wanted


def redact_blocks(blocks: DataFrame, categories: Iterable[str] | None = None, seed: int = SEED, reference: str = REFERENCE_DATE, entities: EntitySource | str | None = propose_entities) -> DataFrame:
    """blocks plus matches (with fakes) and new_text, and new_runs if there are runs. No shuffle; works on streams."""
    found = collect_matches(blocks, categories, entities)
    found = found.withColumn("matches", with_fakes(F.col("matches"), seed, reference))
    out = found.withColumn("new_text", rewrite_text(F.col("text"), F.col("matches")))
    if "runs" in blocks.columns:
        out = out.withColumn("new_runs", rewrite_runs(F.col("runs"), F.col("matches")))
    return out


def changed_blocks(redacted: DataFrame) -> DataFrame:
    """(doc_id, block_seq, runs) of blocks with matches."""
    return where_computed(redacted, F.size("matches") > 0, "doc_id", "block_seq", F.col("new_runs").alias("runs"))


def counts(matched: DataFrame) -> DataFrame:
    """Occurrences per category, in order of category."""
    return exploded(matched).groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def run_redaction(spark: SparkSession, source: str, output: str | None, detections: str | None, categories: Iterable[str] | None = None, seed: int = SEED, dry_run: bool = False, model: Loader | None = None) -> DataFrame:
    """Redact all .docx files under `source` into the folder `output`; detections are written in any case.

    Returns the counts per category. The matched blocks serve all outputs, so they are kept until these are written.
    `model` loads a model of entities in the workers; without one they are proposed by rules.
    """
    blocks = docx.read_docx(spark, source)
    found = redact_blocks(blocks, categories, seed) if model is None else redact_blocks(with_entities(blocks, model), categories, seed, entities="entities")
    redacted = found.persist()
    try:
        if detections:
            records.write_detections(records.detection_records(exploded(redacted, "doc_id", "location", "runs")), detections)
        if not dry_run:
            spark.dataSource.register(docx.DocxSource)
            docx.rewrite_docx(docx.files(spark, source), changed_blocks(redacted)).write.format("docx").mode("append").save(output)
        table = counts(redacted)
        return spark.createDataFrame(table.collect(), table.schema)
    finally:
        redacted.unpersist()


def redact_contents(contents: DataFrame, categories: Iterable[str] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, content) of redacted documents from rows (doc_id, content), such as uploads."""
    redacted = redact_blocks(docx.parse_docx(contents), categories, seed)
    return docx.rewrite_docx(contents, changed_blocks(redacted))
