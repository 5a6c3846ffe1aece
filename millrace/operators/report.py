"""Reports: small aggregates become Markdown tables and an SVG chart at the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from millrace.operators import gate, ledger, metrics


def shown(value, digits: int = 3) -> str:
    return "—" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def table(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small aggregate."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([shown(v) for v in r]) for r in rows)]) + "\n"


def frontier_svg(df: DataFrame, x: str = "cost_per_resolved_task_usd", y: str = "pass_at_1", width: int = 480, height: int = 320) -> str:
    """Contenders by cost and quality."""
    rows = [r for r in df.collect() if r[x] is not None]
    most = max([r[x] for r in rows], default=1) or 1
    dots = "".join(f'<circle cx="{40 + (width - 80) * r[x] / most:.1f}" cy="{height - 40 - (height - 80) * r[y]:.1f}" r="5"/><text x="{48 + (width - 80) * r[x] / most:.1f}" y="{height - 44 - (height - 80) * r[y]:.1f}">{r["contender"]}</text>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}</svg>'


def write_all(folder: str, results: DataFrame, verdicts: DataFrame, book: DataFrame) -> list[str]:
    """Writes frontier.md, frontier.svg, histogram.md, bill.md and ablations.md to a folder at the driver."""
    summaries = metrics.summarize(results)
    variants = tuple(r.variant for r in results.where("variant is not null").groupBy("variant").count().orderBy("variant").collect())  # a handful
    front = metrics.frontier(summaries)
    files = {
        "frontier.md": table(front.drop("pos")) + "\n" + table(metrics.variant_block(results, variants)),
        "frontier.svg": frontier_svg(front),
        "histogram.md": table(gate.histogram(verdicts).orderBy("pos").drop("pos")) + "\n" + table(gate.by_variant(verdicts).orderBy("variant")),
        "bill.md": table(ledger.summary(book)) + "\n" + table(ledger.efficiency(book, verdicts)),
        "ablations.md": table(metrics.ablation(summaries)),
    }
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return sorted(files)
