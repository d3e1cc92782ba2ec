"""Command line: redact, evaluate, ground-truth, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanforge")
    commands = top.add_subparsers(dest="command", required=True)
    redact = commands.add_parser("redact", help="replace sensitive spans in .docx files")
    redact.add_argument("--input", "-i", required=True, help="file or folder")
    redact.add_argument("--output", "-o", default="redacted", help="folder for the new files")
    redact.add_argument("--seed", type=int, default=42)
    redact.add_argument("--dry-run", action="store_true", help="write detections only")
    redact.add_argument("--categories", help="comma-separated categories; all if not given")
    redact.add_argument("--detections-out", default="detections", help="folder for JSON lines, or a .json file for one array")
    redact.add_argument("--model", help="name of an installed spaCy model of entities; rules if not given")
    evaluate = commands.add_parser("evaluate", help="score detections against ground truth")
    evaluate.add_argument("--detections", required=True)
    evaluate.add_argument("--ground-truth", required=True)
    evaluate.add_argument("--report", default="report.md")
    evaluate.add_argument("--tables", help="folder for the result tables as CSV, and for three JSON files of results")
    evaluate.add_argument("--charts", help="folder for charts as SVG")
    evaluate.add_argument("--char-tolerance", type=int, default=10)
    truth = commands.add_parser("ground-truth", help="candidates for ground truth from detections")
    truth.add_argument("--detections", required=True)
    truth.add_argument("--output", required=True)
    web = commands.add_parser("serve", help="a web form for single documents")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return top


def main(argv: list[str] | None = None) -> int:
    from .operators import models
    from .plans import charts, evaluation, redaction
    from .sources import records

    args = parser().parse_args(argv)
    if args.command == "serve":
        from .web import serve

        serve(session(), args.host, args.port).serve_forever()
        return 0
    given = args.input if args.command == "redact" else args.detections
    if "://" not in given and not os.path.exists(given):
        print(f"no such file: {given}", file=sys.stderr)
        return 1
    try:
        categories = redaction.wanted_categories(getattr(args, "categories", None))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = session()
    if args.command == "redact":
        found = redaction.run_redaction(spark, args.input, args.output, args.detections_out, categories, args.seed, args.dry_run, models.spacy_loader(args.model) if args.model else None)
        for row in found.collect():
            print(f"{row.category}: {row.n}")
    elif args.command == "evaluate":
        found = records.read_detections(spark, args.detections).select("*", "source_location.para_idx").drop("source_location")
        true = records.read_truth(spark, args.ground_truth).withColumnRenamed("id", "truth_name")
        # Documents must agree where both files name them.
        keys = ("doc_id",) if all(rows.where("doc_id is not null").limit(1).count() for rows in (found, true)) else ()
        order = [*keys, "para_idx", "start_char", "category", "text"]
        detections, truth = (evaluation.with_ids(rows.fillna("", list(keys)) if keys else rows, order) for rows in (found, true))
        tables = evaluation.evaluate(detections, truth, args.char_tolerance, keys)
        with open(args.report, "w", encoding="utf-8") as f:
            f.writelines(f"{line}\n" for line in evaluation.report_lines(tables))
        if args.tables:
            records.write_tables(evaluation.full_result(tables), f"{args.tables}/csv")
            for name, content in evaluation.result_files(tables).items():
                with open(os.path.join(args.tables, f"{name}.json"), "w", encoding="utf-8") as f:
                    json.dump(content, f, indent=2, ensure_ascii=False)
        if args.charts:
            os.makedirs(args.charts, exist_ok=True)
            for name, chart in charts.charts(tables["scores"], tables["distribution"], tables["coverage"]).items():
                with open(os.path.join(args.charts, f"{name}.svg"), "w", encoding="utf-8") as f:
                    f.write(chart)
    else:
        records.truth_candidates(records.read_detections(spark, args.detections)).write.mode("overwrite").json(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
