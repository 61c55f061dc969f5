"""Contracts of inputs: rules over a long table (date, ticker, measures), all checked in one pass; what breaks them, and where first."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ContractError(ValueError):
    """An input that breaks its contract; the message has every broken rule."""


def violations(df: DataFrame, measures: tuple[str, ...] = (), reference: DataFrame | None = None, order: str | None = None, required: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """rule, violations, first_date, first_ticker: a row for each rule, with 0 and nulls where it is kept.

    required: none of these columns is null. unique: one row a (date, ticker). finite: no measure is NaN or infinite (missing is null).
    sorted: along ``order`` (the order of arrival) a ticker's dates do not go back (rows of one place are taken by date). aligned: exactly the (date, ticker) of ``reference``, whose
    missing and surplus keys both count. One shuffle by key and one by ticker, and one aggregation of all rules.
    """
    key = ["date", "ticker"]
    rows = df.select(*key, *measures, *([order] if order else []), F.lit(True).alias("_in"), *(F.col(c).isNull().alias(f"_null{k}") for k, c in enumerate(required)))
    every = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    flags: dict[str, Column] = {"required": F.col("_required"), "unique": F.col("_unique"), "finite": F.col("_finite")}
    rows = rows.withColumn("_required", every(F.col(f"_null{k}") for k in range(len(required))))
    rows = rows.withColumn("_finite", every(F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False)) for m in measures))
    rows = rows.withColumn("_unique", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))) > 1)
    if order:
        before = F.lag("date").over(Window.partitionBy("ticker").orderBy(order, "date"))
        rows = rows.withColumn("_sorted", F.coalesce(F.col("date") < before, F.lit(False)))
        flags["sorted"] = F.col("_sorted")
    if reference is not None:
        there = reference.select(*key).distinct().withColumn("_there", F.lit(True))
        rows = rows.join(there, key, "full_outer")
        flags["aligned"] = F.col("_in").isNull() | F.col("_there").isNull()
    flags = {k: F.coalesce(f, F.lit(False)) for k, f in flags.items()}
    each = [F.struct(F.lit(k).alias("rule"), F.count_if(f).alias("violations"), F.min(F.when(f, F.struct(*key))).alias("first")) for k, f in flags.items()]
    found = rows.agg(F.array(*each).alias("r")).select(F.inline("r"))
    return found.select("rule", "violations", F.col("first.date").alias("first_date"), F.col("first.ticker").alias("first_ticker"))


def require(df: DataFrame, name: str, **rules) -> DataFrame:
    """df, if it keeps its contract; otherwise one error that names every broken rule."""
    found = violations(df, **rules).filter("violations > 0").collect()  # a row a rule
    if found:
        said = "; ".join(f"{r['rule']} ({r['violations']}, first at {r['first_date']} {r['first_ticker']})" for r in found)
        raise ContractError(f"{name} breaks its contract: {said}")
    return df


def factor_alignment(factors: DataFrame, panel: DataFrame) -> DataFrame:
    """factor, missing, surplus, repeated: keys of the panel that a factor lacks, has beyond it, and has more than once."""
    keys = panel.select("date", "ticker").distinct()
    own = factors.groupBy("factor", "date", "ticker").agg(F.count("*").alias("_n"))
    size = keys.agg(F.count("*").alias("_size"))
    rows = own.join(keys.withColumn("_there", F.lit(True)), ["date", "ticker"], "left")
    by_factor = rows.groupBy("factor").agg(F.count("_there").alias("_common"), F.count_if(F.col("_there").isNull()).alias("surplus"), F.count_if(F.col("_n") > 1).alias("repeated"))
    return by_factor.join(size, F.lit(True)).select("factor", (F.col("_size") - F.col("_common")).alias("missing"), "surplus", "repeated")  # size is one row


def require_inputs(panel: DataFrame, factors: DataFrame, industry: DataFrame) -> None:
    """The inputs of an experiment: a panel with unique finite rows, factors with exactly its keys, an industry for each ticker at most once."""
    require(panel, "panel", measures=("close",))
    if factors.isEmpty():
        raise ContractError("at least one factor is required")
    bad = factor_alignment(factors, panel).filter("missing + surplus + repeated > 0").orderBy("factor").collect()  # a row a factor
    if bad:
        raise ContractError("; ".join(f"factor {r['factor']} isn't aligned with the panel ({r['missing']} keys missing, {r['surplus']} beyond it, {r['repeated']} repeated)" for r in bad))
    twice = industry.groupBy("ticker").count().filter("count > 1").orderBy("ticker").limit(1).collect()
    if twice:
        raise ContractError(f"industry has ticker {twice[0]['ticker']} more than once")


def feasibility(factors: DataFrame, entry: float = 0.20, cap: float = 0.02) -> DataFrame:
    """factor, names (median of a date's), required, feasible: a book of the entry share at the cap reaches full weight only with so many names."""
    daily = factors.groupBy("factor", "date").agg(F.count("value").alias("n"))
    need = math.ceil(1 / (entry * cap) - 1e-9)
    rows = daily.groupBy("factor").agg(F.floor(F.percentile("n", F.lit(0.5))).alias("names"))
    return rows.select("factor", "names", F.lit(need).cast("long").alias("required"), (F.col("names") >= need).alias("feasible"))


def require_feasible(factors: DataFrame, entry: float = 0.20, cap: float = 0.02, label: str = "all") -> None:
    thin = feasibility(factors, entry, cap).filter("not feasible").orderBy("factor").limit(1).collect()
    if thin:
        raise ContractError(f"universe {label} has about {thin[0]['names']} names a date, and an entry share of {entry} with a cap of {cap} needs {thin[0]['required']}: raise either, or take a larger universe")
