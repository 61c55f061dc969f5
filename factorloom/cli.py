"""Command line: card, check, validate, walk-forward, quality, ledger. Exit codes: 0 done, 1 bad formula, 2 infeasible idea, 3 no data."""

from __future__ import annotations

import argparse
import sys

from factorloom.plans import formula


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("card", help="what a formula may hold")
    c = sub.add_parser("check", help="whether a formula is allowed")
    c.add_argument("formula")
    i = sub.add_parser("idea", help="a formula for an idea in words")
    i.add_argument("text")
    for name, what in (("validate", "report on a formula"), ("walk-forward", "select out of sample"), ("quality", "score the bars")):
        s = sub.add_parser(name, help=what)
        s.add_argument("--data", required=True, help="folder with the tables")
        s.add_argument("--out", required=True, help="folder for the report")
        s.add_argument("--min-names", type=int, default=30)
        if name == "validate":
            s.add_argument("formula")
        if name == "walk-forward":
            s.add_argument("--config", help="YAML with the fields of WalkForward")
    ledger = sub.add_parser("ledger", help="adjusted p-values of past experiments")
    ledger.add_argument("path")
    return p


def main(argv: list[str] | None = None, translator=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "card":
        print(formula.capability_card())
        return 0
    if a.command in ("check", "validate"):
        ok, why = formula.is_valid(a.formula)
        if not ok or a.command == "check":
            print("valid" if ok else f"refused: {why}")
            return 0 if ok else 1
    if a.command == "idea":
        from factorloom.translate import translate

        found = translate(a.text, translator)
        print(found.formula if found.feasible else f"infeasible: {found.reason}\n{formula.capability_card()}")
        return 0 if found.feasible else 2
    return _run(a)


def _run(a: argparse.Namespace) -> int:
    from pathlib import Path

    from pyspark.sql import SparkSession

    from factorloom import reports
    from factorloom.operators import evaluation, quality
    from factorloom.plans import experiment
    from factorloom.sources import market

    spark = SparkSession.builder.appName("factorloom").getOrCreate()
    if a.command == "ledger":
        print(reports.markdown(reports.small(reports.ledger(spark, a.path))))
        return 0
    bars = market.lineitem_bars(spark, a.data)
    if bars.isEmpty():
        print("no bars")
        return 3
    if a.command == "quality":
        tables = {"scores": quality.scores(bars, bars.select("date").distinct().count(), str(bars.selectExpr("max(date)").first()[0]))}
    else:
        panel, industry = market.panel(spark, a.data), market.supplier_industry(spark, a.data)
        if a.command == "validate":
            tables = experiment.validate_formula(panel, a.formula, min_names=a.min_names, industry=industry).tables
            tables.pop("ic")
        else:
            spec = experiment.WalkForward.from_yaml(Path(a.config).read_text()) if a.config else experiment.WalkForward(min_names=a.min_names)
            factors = evaluation.unpivot(formula.evaluate(panel, formula.DEFAULTS), tuple(formula.DEFAULTS))
            tables = {k: t for k, t in experiment.walk_forward(panel, factors, industry, spec).tables.items() if k in ("overlaps", "selection", "weights", "performance")}
    print("\n".join(reports.write_tables(tables, a.out, a.command)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
