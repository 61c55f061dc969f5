"""Sinks: tables as files, Markdown and HTML summaries, and the ledger of experiments. Reports are small and made on the driver."""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import statistics

MAX_ROWS = 100_000


def write_text(path: str | Path, text: str) -> None:
    """Atomically: a reader sees the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def small(df: DataFrame, *order: str):
    """df as pandas, sorted; more than MAX_ROWS rows are an error, as they belong in ``write_table``."""
    pdf = df.orderBy(*(order or df.columns)).limit(MAX_ROWS + 1).toPandas()
    if len(pdf) > MAX_ROWS:
        raise ValueError("too many rows for a report")
    return pdf


def markdown(pdf) -> str:
    def cell(v) -> str:
        return "" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    head = "| " + " | ".join(pdf.columns) + " |\n|" + " --- |" * len(pdf.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, row)) + " |" for row in pdf.itertuples(index=False))])


def write_tables(tables: dict[str, DataFrame], folder: str, title: str) -> list[str]:
    """A CSV for each table, summary.md with all of them, and summary.html with bars of the first numeric column."""
    parts, charts, files = [f"# {title}"], [], []
    for name, df in tables.items():
        pdf = small(df)
        write_text(f"{folder}/{name}.csv", pdf.to_csv(index=False))
        files.append(f"{name}.csv")
        parts.append(f"## {name}\n\n{markdown(pdf.head(50))}")
        charts.append(f"<h2>{html.escape(name)}</h2>{bars(pdf)}")
    write_text(f"{folder}/summary.md", "\n\n".join(parts) + "\n")
    write_text(f"{folder}/summary.html", f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(charts)}")
    return [*files, "summary.md", "summary.html"]


def bars(pdf, width: int = 300) -> str:
    """An inline chart, without scripts: a bar for each of the first 30 rows."""
    numbers = [c for c in pdf.columns if pdf[c].dtype.kind == "f"]
    if not numbers or not len(pdf):
        return "<p>no numbers</p>"
    x = pdf[numbers[0]].head(30).fillna(0.0)
    most = float(x.abs().max()) or 1.0
    rows = "".join(f"<rect x='{width if v >= 0 else width - width * -v / most:.1f}' y='{14 * i}' width='{width * abs(v) / most:.1f}' height='10' fill='{'#2a6' if v >= 0 else '#c33'}'/>" for i, v in enumerate(x))
    return f"<p>{html.escape(numbers[0])}</p><svg width='{2 * width}' height='{14 * len(x)}'>{rows}</svg>"


def shade(v: float) -> str:
    """White at 0, blue towards 1, red towards -1."""
    v = max(-1.0, min(1.0, v))
    strong, weak = round(255 - 60 * abs(v)), round(255 - 170 * abs(v))
    return f"rgb({weak},{weak},{strong})" if v >= 0 else f"rgb({strong},{weak},{weak})"


def heatmap(pairs, side: int = 46, margin: int = 110) -> str:
    """An inline chart of a symmetric table given as pairs (left, right, value): the diagonal is 1, a pair that is missing has no colour."""
    names = sorted({*pairs["left"], *pairs["right"]})
    known = {frozenset((a, b)): v for a, b, v in zip(pairs["left"], pairs["right"], pairs["value"], strict=True)}
    out = []
    for i, a in enumerate(names):
        y = margin + i * side
        label = html.escape(str(a))
        out.append(f"<text x='{margin - 4}' y='{y + side / 2:.1f}' text-anchor='end'>{label}</text><text x='{y + side / 2:.1f}' y='{margin - 4}' text-anchor='start' transform='rotate(-60 {y + side / 2:.1f} {margin - 4})'>{label}</text>")
        for j, b in enumerate(names):
            v = 1.0 if a == b else known.get(frozenset((a, b)))
            none = v is None or v != v
            out.append(f"<rect x='{margin + j * side}' y='{y}' width='{side - 1}' height='{side - 1}' fill='{'#eee' if none else shade(v)}'/>" + ("" if none else f"<text x='{margin + j * side + side / 2:.1f}' y='{y + side / 2 + 4:.1f}' text-anchor='middle'>{v:.2f}</text>"))
    size = margin + len(names) * side
    return f"<svg width='{size}' height='{size}' font-size='10'>{''.join(out)}</svg>"


#: Colours of lines, in order; they repeat.
COLOURS = ("#1b6ca8", "#d1495b", "#3c7a3f", "#8d5fa3", "#b7791f", "#444")


def lines(pdf, x: str, width: int = 640, height: int = 240, margin: int = 40) -> str:
    """An inline chart: a line for each other column over the (evenly spaced) values of x in order, broken where a value is missing, and a rule at 0."""
    rows = pdf.sort_values(x)
    series = [c for c in rows.columns if c != x]
    seen = [v for c in series for v in rows[c] if v is not None and v == v]
    if not seen:
        return "<p>no numbers</p>"
    lo, hi = min(0.0, *seen), max(0.0, *seen)
    at = lambda i: margin + i * (width - 2 * margin) / max(1, len(rows) - 1)
    up = lambda v: height - margin - (v - lo) / ((hi - lo) or 1.0) * (height - 2 * margin)
    out = [f"<line x1='{margin}' x2='{width - margin}' y1='{up(0):.1f}' y2='{up(0):.1f}' stroke='#aaa'/>"]
    out += [f"<text x='{at(i):.1f}' y='{height - 8}' text-anchor='middle'>{html.escape(f'{v:g}' if isinstance(v, float) else str(v))}</text>" for i, v in enumerate(rows[x])]
    for k, c in enumerate(series):
        colour, parts = COLOURS[k % len(COLOURS)], [[]]
        for i, v in enumerate(rows[c]):
            if v is None or v != v:
                parts.append([])
            else:
                parts[-1].append(f"{at(i):.1f},{up(v):.1f}")
        out += [f"<polyline fill='none' stroke='{colour}' points='{' '.join(p)}'/>" if len(p) > 1 else f"<circle r='2' fill='{colour}' cx='{p[0].split(',')[0]}' cy='{p[0].split(',')[1]}'/>" for p in parts if p]
        out.append(f"<text x='{margin + 4}' y='{14 + 12 * k}' fill='{colour}'>{html.escape(str(c))}</text>")
    return f"<svg width='{width}' height='{height}' font-size='10'>{''.join(out)}</svg>"


def scorecard_html(summary: str, factors: DataFrame, pairs: DataFrame, by_horizon: DataFrame, tradeoff: DataFrame | None = None, title: str = "Factor scorecard") -> str:
    """One page without scripts: metrics of the factors, their correlations (left, right, value), IC by horizon (factor, horizon, ic_mean), and what the interval of rebalancing (every, gross_sharpe, net_sharpe) costs."""
    table, wide = small(factors), small(by_horizon.groupBy("horizon").pivot("factor").agg(F.first("ic_mean")), "horizon")
    body = [f"<p>{html.escape(summary)}</p><p>Metrics only, no verdict.</p>", "<h2>Factors</h2>", table.to_html(index=False, na_rep="", float_format="%.4g"), bars(table), "<h2>Correlations</h2>", heatmap(small(pairs.select("left", "right", "value"))), "<h2>IC by horizon</h2>", lines(wide, "horizon")]
    if tradeoff is not None:
        body += ["<h2>Rebalancing</h2>", lines(small(tradeoff.select("every", "gross_sharpe", "net_sharpe"), "every"), "every")]
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}\n"


def write_table(df: DataFrame, path: str, two_decimals: bool = False) -> None:
    """A table of any size, as CSV files that Spark writes."""
    if two_decimals:
        df = df.select(*(F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.write.mode("overwrite").option("header", True).csv(path)


def folder_digest(folder: str) -> str:
    h = hashlib.sha256()
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file():
            h.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes())
    return h.hexdigest()


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows in any order: their count, and sums of two hashes of each."""
    columns = sorted(df.columns)
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.hash(*columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([columns, *map(str, r)]).encode()).hexdigest()


@dataclass(frozen=True)
class Entry:
    """A line of the ledger."""

    name: str
    family: str
    p: float
    n_hypotheses: int = 1
    passed: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.p <= 1 or self.n_hypotheses < 1:
            raise ValueError("p is within [0, 1] and n_hypotheses at least 1")


def append(path: str, entry: Entry) -> None:
    old = Path(path).read_text(encoding="utf-8") if Path(path).exists() else ""
    write_text(path, old + json.dumps(asdict(entry), sort_keys=True) + "\n")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with adjusted p-values; empty if there is none yet."""
    schema = "name string, family string, p double, n_hypotheses long, passed boolean"
    rows = spark.read.schema(schema).json(path) if Path(path).exists() else spark.createDataFrame([], schema)
    rows = rows.filter("name is not null").withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("n_hypotheses")))
    return statistics.benjamini_hochberg(statistics.bonferroni(rows))
