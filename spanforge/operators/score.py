"""Scoring of detections against ground truth.

Texts and categories are equi-join keys; places are compared within a group of equal keys. Detections take the first
free truth that fits, in order. Where both sides name a paragraph everywhere, numbering the rows of a paragraph says the
same, and for scores alone counts do, which pre-aggregate before their shuffle; only where a paragraph is missing the
group is folded as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import each
from ..schemas import CATEGORIES

#: Characters by which starts may differ, in the short and in the full report.
TOLERANCE, FULL_TOLERANCE = 10, 20
TARGET_PRECISION, TARGET_RECALL = 0.80, 0.85


def normal(text: Column) -> Column:
    """Lower case, white space collapsed, outer white space gone."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", ""))


def same_place(a: Column, b: Column, tolerance: int) -> Column:
    """Equal paragraphs if both have one; else starts within the tolerance if both have one; else true."""
    paragraphs = a["para_idx"].isNotNull() & b["para_idx"].isNotNull()
    starts = a["start_char"].isNotNull() & b["start_char"].isNotNull()
    return F.when(paragraphs, a["para_idx"] == b["para_idx"]).when(starts, F.abs(a["start_char"] - b["start_char"]) <= tolerance).otherwise(True)


def keyed(rows: DataFrame, extra: list[str]) -> DataFrame:
    return rows.select(F.upper("category").alias("category"), normal(F.col("text")).alias("norm"), *extra)


def match_pairs(detections: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(category, det_id, truth_id): pairs of the greedy one-to-one matching. Both sides have an id in the order of the
    file, text, category, para_idx and start_char; `keys`, such as a doc_id, must agree too.

    Texts whose paragraphs are all known are paired by number within category, text and paragraph, without arrays; only
    the others are folded.
    """
    fields, on = ["id", "para_idx", "start_char"], ["category", "norm", *keys]
    sides = [keyed(rows, [*keys, *fields]) for rows in (detections, truth)]
    unplaced = sides[0].unionByName(sides[1]).where("para_idx is null").select(*on).distinct()
    place = F.row_number().over(Window.partitionBy(*on, "para_idx").orderBy("id"))
    found, true = (rows.join(unplaced, on, "left_anti").select(*on, "para_idx", F.col("id").alias(name), place.alias("place")) for rows, name in zip(sides, ("det_id", "truth_id"), strict=True))
    placed = found.join(true, [*on, "para_idx", "place"]).select("category", *keys, "det_id", "truth_id")
    sides = [rows.join(unplaced, on, "left_semi") for rows in sides]
    return placed.unionByName(folded_pairs(*sides, tolerance, on))


def folded_pairs(detections: DataFrame, truth: DataFrame, tolerance: int, on: list[str]) -> DataFrame:
    """The pairs where some paragraph is not known: each detection takes the first free truth that fits."""
    fields, keys = ["id", "para_idx", "start_char"], on[2:]
    sides = [rows.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)) for rows, name in ((detections, "found"), (truth, "true"))]
    both = sides[0].join(sides[1], on)
    kind = both.schema["true"].dataType.simpleString()
    ids = both.schema["true"].dataType.elementType["id"].dataType.simpleString()

    def step(acc: Column, d: Column) -> Column:
        at = F.array_position(F.transform(acc["free"], lambda g: same_place(d, g, tolerance)), True).cast("int")
        hit = F.element_at(acc["free"], F.greatest(at, F.lit(1)))
        rest = F.concat(F.slice(acc["free"], 1, at - 1), F.slice(acc["free"], at + 1, F.size(acc["free"])))
        pair = F.struct(d["id"].alias("det_id"), hit["id"].alias("truth_id"))
        taken = F.struct(rest.alias("free"), F.array_append(acc["pairs"], pair).alias("pairs"))
        return F.when((F.size(acc["free"]) > 0) & (at > 0), taken).otherwise(acc)

    start = F.struct(F.col("true").cast(kind).alias("free"), F.array().cast(f"array<struct<det_id:{ids},truth_id:{ids}>>").alias("pairs"))
    pairs = F.aggregate("found", start, step, lambda acc: acc["pairs"])
    return each(both, pairs, "p", "category", *keys).select("category", *keys, "p.*")


def true_positives(detections: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(category, tp) where all rows have a para_idx: per category, text and paragraph the lesser of both counts."""
    on = ["category", "norm", "para_idx", *keys]
    found = keyed(detections, ["para_idx", *keys]).groupBy(*on).agg(F.count("*").alias("d"))
    true = keyed(truth, ["para_idx", *keys]).groupBy(*on).agg(F.count("*").alias("g"))
    return found.join(true, on).groupBy("category").agg(F.sum(F.least("d", "g")).alias("tp"))


def metrics(counts: DataFrame, group: Column | None = None) -> DataFrame:
    """Precision, recall and F1 of rows (category, detected, gt, tp), null where undefined; `group` renames groups."""
    sums = counts.groupBy((F.col("category") if group is None else group).alias("category")).agg(*[F.sum(c).cast("long").alias(c) for c in ("gt", "detected", "tp")])
    p = F.col("tp") / F.nullif(F.col("detected"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("gt"), F.lit(0))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    rows = sums.withColumns({"fp": F.col("detected") - F.col("tp"), "fn": F.col("gt") - F.col("tp"), "precision": p, "recall": r})
    return rows.withColumn("f1", f1).select("category", "gt", "detected", "tp", "fp", "fn", "precision", "recall", "f1")


def totals(detections: DataFrame, truth: DataFrame, tp: DataFrame) -> DataFrame:
    """(category, gt, detected, tp) of all nine categories; others are left out."""
    spark = detections.sparkSession
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    found = detections.groupBy(F.upper("category").alias("category")).agg(F.count("*").alias("detected"))
    true = truth.groupBy(F.upper("category").alias("category")).agg(F.count("*").alias("gt"))
    out = every
    for side in (true, found, tp):
        out = out.join(side, "category", "left")
    return out.select("category", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gt", "detected", "tp")])


def score(detections: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per category and an OVERALL one, by the greedy matching."""
    tp = match_pairs(detections, truth, tolerance, keys).groupBy("category").agg(F.count("*").alias("tp"))
    return with_overall(totals(detections, truth, tp))


def score_by_paragraph(detections: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same scores where all rows have a para_idx."""
    return with_overall(totals(detections, truth, true_positives(detections, truth, keys)))


def with_overall(counts: DataFrame) -> DataFrame:
    """Metrics by category and over all, by a rollup."""
    rolled = counts.rollup("category").agg(*[F.sum(c).cast("long").alias(c) for c in ("gt", "detected", "tp")])
    return metrics(rolled.withColumn("category", F.coalesce("category", F.lit("OVERALL"))))


def false_positives(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    return detections.join(pairs.select(F.col("det_id").alias("id")), "id", "left_anti")


def false_negatives(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.join(pairs.select(F.col("truth_id").alias("id")), "id", "left_anti")


def detector_metrics(counts: DataFrame) -> DataFrame:
    """Metrics with persons, companies and addresses as one detector."""
    ner = F.when(F.col("category").isin("PERSON", "COMPANY", "ADDRESS"), "NER").otherwise(F.col("category"))
    return metrics(counts, ner)


def consistent(scores: DataFrame) -> DataFrame:
    """The scores, or an error where tp + fn is not gt or tp + fp is not detected."""
    fine = (F.col("tp") + F.col("fn") == F.col("gt")) & (F.col("tp") + F.col("fp") == F.col("detected"))
    return scores.withColumn("fn", F.when(fine, F.col("fn")).otherwise(F.raise_error(F.lit("counts do not add up")).cast("long")))


def formatted(scores: DataFrame) -> DataFrame:
    """Metrics with three decimals or N/A, and marks of whether targets are met."""

    def shown(c: str) -> Column:
        return F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("N/A")).alias(c)

    def flag(c: str, target: float) -> Column:
        return F.when(F.col(c).isNull(), "—").when(F.col(c) >= target, "✓").otherwise("✗").alias(f"{c}_target")

    return scores.select("category", "gt", "detected", "tp", "fp", "fn", shown("precision"), shown("recall"), shown("f1"), flag("precision", TARGET_PRECISION), flag("recall", TARGET_RECALL))


def coverage(counts: DataFrame) -> DataFrame:
    """Truth and all detections per category, and their ratio."""
    return counts.select("category", "gt", "detected", (F.col("detected") / F.nullif(F.col("gt"), F.lit(0))).alias("ratio"))


def distribution(truth: DataFrame) -> DataFrame:
    """Number and share of each category in the truth; only the counts meet in one task."""
    counts = truth.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
