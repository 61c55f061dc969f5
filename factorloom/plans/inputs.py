"""Inputs of experiments over a research calendar whose factors are whole from its first date on.

The research calendar has the dates from a start on which enough names trade. Factors look back, so the panel begins as many
calendar rows earlier as the longest of them needs: the registry says it for registered formulas, the tree for others.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.functions import alphas
from factorloom.operators import evaluation as ev
from factorloom.plans import formula
from factorloom.sources import market
from factorloom.sources.shared import keep

#: Rows before its own that an input needs, and that an operator with window n adds, as (rows, times n).
OF_INPUTS = {"returns": 1, "adv20": 19}
OF_OPERATORS = {"delay": (0, 1), "delta": (0, 1)} | dict.fromkeys(("ts_sum", "ts_min", "ts_max", "stddev", "ts_rank", "correlation", "covariance", "adv"), (-1, 1))


def lookback(text: str) -> int:
    """How many rows before its own a formula needs."""

    def rows(n: ast.AST) -> int:
        if isinstance(n, ast.Name):
            return OF_INPUTS.get(n.id, 0)
        if isinstance(n, ast.Call):
            columns, literals, _ = formula.OPERATORS[n.func.id]
            below = max(rows(a) for a in n.args[:columns])
            if not literals or n.func.id not in OF_OPERATORS:
                return below
            add, times = OF_OPERATORS[n.func.id]
            return below + add + times * int(ast.literal_eval(n.args[columns]))
        return max((rows(x) for x in ast.iter_child_nodes(n) if isinstance(x, ast.expr)), default=0)

    return rows(formula.parse(text))


@dataclass
class Inputs:
    """panel: dense, from the padding on. calendar: date and pos (from 1) of the research dates. factors: long, on research dates only."""

    panel: DataFrame
    calendar: DataFrame
    factors: DataFrame
    metadata: dict[str, object]


def research_calendar(bars: DataFrame, start: str, share: float = 0.5, least: int = 30) -> DataFrame:
    """date, i (row of all dates with bars, from 1), pos (row of the research dates, from 1, or null).

    A research date isn't before ``start`` and has a close of at least ``share`` of the most names that any date has, and of ``least``.
    """
    days = bars.groupBy("date").agg(F.count("close").alias("n"))  # a row a date
    every = Window.partitionBy()
    needed = F.greatest(F.lit(float(least)), F.floor(F.max("n").over(every) * share))
    days = days.withColumns({"i": F.row_number().over(Window.orderBy("date")), "_in": (F.col("n") >= needed) & (F.col("date") >= F.lit(start).cast("date"))})
    pos = F.sum(F.col("_in").cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("date", "i", F.when(F.col("_in"), pos).cast("int").alias("pos"))


def extended(bars: DataFrame, start: str, formulas: dict[str, str] | None = None, numbers: tuple[int, ...] = (), share: float = 0.5, least: int = 30) -> Inputs:
    """Inputs from ``start`` on, of the formulas and the registered formulas with these numbers.

    The panel is of names that have a bar in the padded period. Values on research dates are those of the whole history.
    """
    formulas = formulas or {}
    unknown = set(numbers) - {a.number for a in alphas.ALPHAS}
    if unknown or not (formulas or numbers):
        raise ValueError(f"unknown numbers: {sorted(unknown)}" if unknown else "at least one factor is required")
    # the panel's own inputs reach back as well: a registered formula says all but that
    needed = max([*(lookback(t) for t in formulas.values()), *(a.lookback + a.delay + max(OF_INPUTS.get(i, 0) for i in a.inputs) for a in alphas.ALPHAS if a.number in numbers)])
    days = keep(research_calendar(bars, start, share, least))
    first = days.filter("pos = 1").select("i").first()  # one number
    if first is None:
        raise ValueError("no date has enough names")
    calendar = days.filter("pos is not null").select("date", "pos")
    since = days.filter(F.col("i") > first["i"] - 1 - needed).select("date")
    panel = keep(market.measures(market.densify(bars.join(since, "date", "left_semi"))))
    parts = [ev.unpivot(formula.evaluate(panel, formulas), tuple(formulas))] if formulas else []
    if numbers:
        built = alphas.build(panel, numbers)
        parts.append(ev.unpivot(built, tuple(c for c in built.columns if c not in ("date", "pos", "ticker"))))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    factors = both.join(calendar, "date").select("date", "pos", "ticker", "factor", "value")
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).first()
    return Inputs(panel, calendar, factors, {"lookback": needed, "date_start": str(ends["a"]), "date_end": str(ends["b"]), "dates": ends["n"], "window": "extended_price_calendar"})
