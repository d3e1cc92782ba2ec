"""Detections and ground truth as JSON, score tables as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETECTIONS, TRUTH

#: Texts that are no ground truth.
NOT_TRUTH = ("rohit branch", "post-offer", "offer for", "securities and exchange board of india", "non-gaap", "broad family trust")
TRUTH_NOTE = "Independently verified candidate"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or one array over many lines; anything else is an error."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    array = bool(first) and first[0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, DETECTIONS)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth; a record without text or category fails."""
    rows = _json(spark, path, TRUTH)
    fine = F.col("text").isNotNull() & F.col("category").isNotNull()
    return rows.withColumn("text", F.when(fine, F.col("text")).otherwise(F.raise_error(F.lit("a ground truth record needs text and category"))))


def detection_records(found: DataFrame) -> DataFrame:
    """Rows of matches with their document, if they name one, and location as records: no runs but their offsets,
    confidence with four decimals."""
    fields = [F.col("location")[k].alias(k) for k in ("type", "para_idx", "table_idx", "row_idx", "col_idx", "section_idx")]
    offsets = F.transform("runs", lambda r: r["start"]).alias("run_offsets")
    named = ["doc_id"] if "doc_id" in found.columns else []
    return found.select(*named, "text", "category", "start_char", "end_char", F.struct(*fields, offsets).alias("source_location"), F.round("confidence", 4).alias("confidence"), "needs_review", "detector")


def write_detections(records: DataFrame, path: str) -> None:
    """JSON lines in a folder, or one array in a local file if the path ends in .json; that comes part by part."""
    if not path.endswith(".json"):
        records.write.mode("overwrite").json(path)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, line in enumerate(records.toJSON().toLocalIterator()):
            f.write((",\n" if i else "\n") + line)
        f.write("\n]\n")


def truth_candidates(detections: DataFrame) -> DataFrame:
    """Detections as ground truth, without known false ones."""
    known = "(?i)" + "|".join(NOT_TRUTH)
    kept = detections.where(~F.regexp_like("text", F.lit(known)))
    place = F.col("source_location")["para_idx"] if "source_location" in detections.columns else F.col("para_idx")
    named = ["doc_id"] if "doc_id" in detections.columns else []
    return kept.select(*named, "text", "category", place.alias("para_idx"), "start_char", "end_char", F.lit(TRUTH_NOTE).alias("notes"))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Small result tables, one folder of one file for each."""
    for name, table in tables.items():
        writer = table.coalesce(1).write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{folder}/{name}")
