"""Bar charts of small result tables as SVG, without a plotting library."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

COLOURS = ("#3b6ea5", "#c8843c", "#5a9367")
HEIGHT, LEFT, TOP, GROUP = 260, 60, 40, 90


def bars(title: str, rows: list[tuple[str, list[float | None]]], series: list[str]) -> str:
    """Grouped bars: rows of (label, one value per series); a missing value has no bar."""
    most = max([v for _, values in rows for v in values if v is not None] or [1]) or 1
    width, wide = LEFT + GROUP * len(rows) + 20, (GROUP - 20) / max(1, len(series))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{HEIGHT + 90}" font-family="sans-serif" font-size="11">', f'<text x="{LEFT}" y="20" font-size="14">{escape(title)}</text>']
    for i, (label, values) in enumerate(rows):
        x = LEFT + GROUP * i
        for k, value in enumerate(values):
            if value is not None:
                tall = HEIGHT * 0.85 * value / most
                out.append(f'<rect x="{x + k * wide:.1f}" y="{TOP + HEIGHT - tall:.1f}" width="{wide - 2:.1f}" height="{tall:.1f}" fill="{COLOURS[k % len(COLOURS)]}"/>')
                out.append(f'<text x="{x + k * wide:.1f}" y="{TOP + HEIGHT - tall - 3:.1f}">{value:.3g}</text>')
        out.append(f'<text x="{x}" y="{TOP + HEIGHT + 16}">{escape(label)}</text>')
    out += [f'<text x="{LEFT + 110 * k}" y="{TOP + HEIGHT + 40}" fill="{COLOURS[k % len(COLOURS)]}">{escape(name)}</text>' for k, name in enumerate(series)]
    return "\n".join([*out, "</svg>"]) + "\n"


def charts(scores: DataFrame, distribution: DataFrame, coverage: DataFrame) -> dict[str, str]:
    """Five charts by name: metrics, outcomes, errors, distribution, coverage."""
    rows = scores.where("category <> 'OVERALL'").orderBy("category").collect()
    table = lambda *names: [(r.category, [r[n] for n in names]) for r in rows]
    return {
        "metrics": bars("Precision, recall and F1", table("precision", "recall", "f1"), ["precision", "recall", "F1"]),
        "outcomes": bars("Outcomes", table("tp", "fp", "fn"), ["true", "false", "missed"]),
        "errors": bars("Errors", table("fp", "fn"), ["false", "missed"]),
        "distribution": bars("Categories of the truth", [(r.category, [r.n]) for r in distribution.orderBy("category").collect()], ["records"]),
        "coverage": bars("Truth and detections", [(r.category, [r.gt, r.detected]) for r in coverage.orderBy("category").collect()], ["truth", "detected"]),
    }
