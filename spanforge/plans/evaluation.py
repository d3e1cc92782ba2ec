"""Evaluation: scores, error tables and reports of detections against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators import score as S

#: Examples in a full result and false positives in a report, per category; misses are all reported.
EXAMPLES, REPORT_FALSE = 10, 20
EXAMPLE_FIELDS = ("doc_id", "text", "category", "para_idx", "start_char", "end_char", "confidence", "detector", "notes")


def with_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with an id that follows `order`, such as doc_id and start_char: sorted by ranges, with gaps between these."""
    return durable(rows.orderBy(*order).withColumn("id", F.monotonically_increasing_id()))


def top_examples(errors: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The first k rows of each category by id."""
    order = Window.partitionBy("category").orderBy("id")
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def evaluate(detections: DataFrame, truth: DataFrame, tolerance: int = S.TOLERANCE, keys: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All result tables, by name: scores, outcomes, detectors, coverage, shares, all wrong and all missed ones. `keys`,
    such as a doc_id, are columns of both sides that must agree."""
    pairs = durable(S.match_pairs(detections, truth, tolerance, keys))
    tp = pairs.groupBy("category").agg(F.count("*").alias("tp"))
    counts = S.totals(detections, truth, tp)
    scores = S.consistent(S.with_overall(counts))
    overall = scores.where("category = 'OVERALL'")
    return {
        "per_category": scores.select("category", "tp", "fp", "fn"),
        "scores": scores,
        "metrics": S.formatted(scores),
        "outcomes": overall.select("tp", "fp", "fn"),
        "coverage": S.coverage(counts),
        "errors": scores.where("category <> 'OVERALL'").select("category", "fp", "fn"),
        "detectors": S.formatted(S.detector_metrics(counts)),
        "distribution": S.distribution(truth),
        "false_positives": S.false_positives(detections, pairs),
        "false_negatives": S.false_negatives(truth, pairs),
    }


def full_result(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as they are stored, with EXAMPLES wrong and missed ones for each category."""
    return tables | {name: top_examples(tables[name]) for name in ("false_positives", "false_negatives")}


def result_files(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """The contents of three JSON files: metrics by category, over all, and both with EXAMPLES wrong and missed ones."""
    scores = {r.category: r.asDict() for r in tables["scores"].collect()}
    examples = {}
    for key, name in (("fp_examples", "false_positives"), ("fn_examples", "false_negatives")):
        for r in top_examples(tables[name]).orderBy("category", "id").collect():
            examples.setdefault((r.category.upper(), key), []).append({k: v for k, v in r.asDict().items() if k in EXAMPLE_FIELDS})
    named = lambda r: {"TP": r["tp"], "FP": r["fp"], "FN": r["fn"], "precision": r["precision"], "recall": r["recall"], "f1": r["f1"]}
    by_category = {c: {"ground_truth_count": r["gt"], "detected_count": r["detected"], **named(r), "has_ground_truth": r["gt"] > 0} for c, r in scores.items() if c != "OVERALL"}
    total = scores["OVERALL"]
    overall = {"total_ground_truth": total["gt"], "total_detected": total["detected"], **named(total), "accuracy": "N/A: spans that are rightly not found can't be counted", "validation": {"TP_plus_FN_equals_GT": total["tp"] + total["fn"] == total["gt"]}}
    full = {c: {"GT": r["gt"], "detected": r["detected"], **named(r), **{k: examples.get((c, k), []) for k in ("fp_examples", "fn_examples")}} for c, r in scores.items()}
    return {"per_category_metrics": by_category, "overall_metrics": overall, "evaluation_results": full}


def report_lines(tables: dict[str, DataFrame]) -> Iterator[str]:
    """Lines of a Markdown report; what may be long comes to the driver part by part."""
    rows = tables["metrics"].orderBy(F.col("category") == "OVERALL", "category").collect()
    yield from ("# Evaluation", "", "| Category | Truth | Detected | TP | FP | FN | Precision | Recall | F1 |", "|---|---|---|---|---|---|---|---|---|")
    for r in rows:
        yield f"| {r.category} | {r.gt} | {r.detected} | {r.tp} | {r.fp} | {r.fn} | {r.precision} {r.precision_target} | {r.recall} {r.recall_target} | {r.f1} |"
    for title, found in (("False positives", top_examples(tables["false_positives"], REPORT_FALSE)), ("Missed", tables["false_negatives"])):
        yield from ("", f"## {title}", "")
        none = True
        for r in found.orderBy("category", "id").toLocalIterator():
            none = False
            yield f"- {r.category}: {r.text!r}"
        if none:
            yield "none"


def report(tables: dict[str, DataFrame]) -> str:
    """The Markdown report as one string."""
    return "\n".join(report_lines(tables)) + "\n"


def outcome_report(tables: dict[str, DataFrame]) -> str:
    """A plain-text report: outcomes over all, then each category's errors, up to REPORT_FALSE false ones and all missed."""
    total = tables["outcomes"].first()
    lines = ["Outcomes", f"  found and true: {total.tp}", f"  found, not true: {total.fp}", f"  true, not found: {total.fn}", ""]
    wrong = top_examples(tables["false_positives"], REPORT_FALSE).orderBy("category", "id").collect()
    missed = {}
    for r in tables["false_negatives"].orderBy("category", "id").toLocalIterator():
        missed.setdefault(r.category, []).append(f"  - missed: {r.text!r}")
    for row in tables["errors"].orderBy("category").collect():
        lines.append(f"{row.category}: {row.fp} false, {row.fn} missed")
        lines += [f"  - false: {r.text!r}" for r in wrong if r.category == row.category]
        lines += missed.get(row.category, [])
    return "\n".join(lines) + "\n"
