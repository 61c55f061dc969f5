"""Portfolios: weights, buffered targets, simulation, costs, capacity. Weights are long: date, pos, ticker, w."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def rows_of(by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by, "ticker").orderBy("pos")


YEAR = 252


def long_short(df: DataFrame, x: str = "value", quantile: float = 0.2, by: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """date, pos, ticker, also (columns of df), w: equal weights of 1 on the top and -1 on the bottom, ties by ticker; 0 for the rest.

    With ``by`` (an industry) this is done within each group, and each side scaled to 1 over the date.
    """
    if not 0 < quantile <= 0.5:
        raise ValueError("quantile is within (0, 0.5]")
    group = Window.partitionBy("date", *([by] if by else []))
    valid = F.col(x).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True))
    rows = df.withColumn("_v", F.when(valid, F.col(x)))
    rows = rows.withColumns({"_n": F.count("_v").over(group), "_i": F.row_number().over(group.orderBy(F.col("_v").asc_nulls_last(), "ticker"))})
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * quantile)))
    side = F.when(F.col("_v").isNull() | (F.col("_n") < 2 * F.col("_k")), 0.0).when(F.col("_i") <= F.col("_k"), -1 / F.col("_k")).when(F.col("_i") > F.col("_n") - F.col("_k"), 1 / F.col("_k")).otherwise(0.0)
    rows = rows.withColumn("w", side)
    if by:
        day = Window.partitionBy("date")
        total = F.when(F.col("w") > 0, F.sum(F.greatest("w", F.lit(0.0))).over(day)).when(F.col("w") < 0, F.sum(F.greatest(-F.col("w"), F.lit(0.0))).over(day))
        rows = rows.withColumn("w", F.coalesce(F.try_divide("w", total), F.lit(0.0)))
    return rows.select("date", "pos", "ticker", *also, "w")


def check_buffer(every: int, entry: float, exit_: float) -> None:
    if not 0 < entry <= exit_ <= 0.5 or every < 1:
        raise ValueError("0 < entry <= exit <= 0.5, and every is positive")


def buffered_targets(df: DataFrame, x: str = "value", every: int = 5, entry: float = 0.20, exit_: float = 0.30, cap: float | None = None, by: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """by, date, pos, ticker, w, action, also: enter within the entry share, stay within the exit share, equal weights a side.

    On the rebalance rows that vary (each ``every``-th row; others hold), a name is long if its last entry is
    later than the last time it was outside the exit zone. Between them weights are carried on. Each group of ``by`` is a portfolio.
    Only the scheduled rows are ranked and counted; the others join them where weights are carried on. ``also`` are columns of df.
    """
    check_buffer(every, entry, exit_)
    day = Window.partitionBy(*by, "date")
    df = df.select(*by, "date", "pos", "ticker", x, *(c for c in also if c != x))
    due = (F.col("pos") - 1) % every == 0
    rows = df.filter(due).withColumns({"_n": F.count(x).over(day), "_lo": F.row_number().over(day.orderBy(F.col(x).asc_nulls_last(), "ticker")), "_varies": F.coalesce(F.min(x).over(day) < F.max(x).over(day), F.lit(False))})
    rows = rows.withColumn("action", F.when(~F.col("_varies"), "hold_invalid").otherwise("rebalance"))
    rows = rows.withColumn("_enter", F.greatest(F.lit(1), F.floor(F.col("_n") * entry)))
    rows = rows.withColumns({"_stay": F.greatest("_enter", F.floor(F.col("_n") * exit_)), "_hi": F.col("_n") + 1 - F.col("_lo"), "_k": F.when(F.col("action") == "rebalance", F.col("pos"))})
    known = F.col(x).isNotNull()
    past = rows_of(by).rowsBetween(Window.unboundedPreceding, 0)

    def latched(place: str):
        entered = F.max(F.when(known & (F.col(place) <= F.col("_enter")), F.col("_k"))).over(past)
        left = F.max(F.when(~known | (F.col(place) > F.col("_stay")), F.col("_k"))).over(past)
        return F.coalesce(entered, F.lit(-1)) > F.coalesce(left, F.lit(-1))

    rows = rows.withColumns({"_long": latched("_hi"), "_short": latched("_lo")})
    side = F.when(F.col("_long"), 1).when(F.col("_short"), -1)
    rows = rows.withColumn("_side", F.when(F.col("action") == "rebalance", F.coalesce(side, F.lit(0))))
    weight = F.col("_side") / F.count("*").over(Window.partitionBy(*by, "date", "_side"))
    if cap is not None:
        weight = F.when(F.abs(weight) > cap + 1e-12, F.raise_error(F.lit("the cap on a name's weight is infeasible"))).otherwise(weight)
    rows = rows.withColumn("_w", F.when(F.col("_side") == 0, 0.0).when(F.col("_side").isNotNull(), weight))
    out = (*by, "date", "pos", "ticker", "_w", "action", *also)
    held = df.filter(~due).withColumns({"_w": F.lit(None).cast("double"), "action": F.lit("hold_schedule")})
    rows = rows.select(*out).unionByName(held.select(*out))
    return rows.select(*by, "date", "pos", "ticker", F.coalesce(F.last("_w", ignorenulls=True).over(past), F.lit(0.0)).alias("w"), "action", *also)


MARKS = ("long", "long_stay", "short", "short_stay")


def marks(x: np.ndarray, ticker: pa.ChunkedArray, entry: float = 0.20, exit_: float = 0.30) -> dict[str, dict]:
    """The names (x and ticker) at which the shares to enter and to stay begin, on both sides, of one date's values of which none is missing."""
    n = len(x)
    enter = max(1, math.floor(n * entry))
    stay = max(enter, math.floor(n * exit_))
    order = pc.sort_indices(pa.table({"x": x, "t": ticker}), sort_keys=[("x", "ascending"), ("t", "ascending")])
    at = {m: order[k].as_py() for m, k in zip(MARKS, (n - enter, n - stay, enter - 1, stay - 1), strict=True)}
    return {m: {"x": float(x[k]), "t": ticker[k].as_py()} for m, k in at.items()}


def zone(x: Column, ticker: Column, m: Column) -> Column:
    """Three times the place on the long side and that on the short one: 2 within the share to enter, 1 within that to stay, 0 outside. Null without marks."""
    above = lambda k: (x > m[k]["x"]) | ((x == m[k]["x"]) & (ticker >= m[k]["t"]))
    below = lambda k: (x < m[k]["x"]) | ((x == m[k]["x"]) & (ticker <= m[k]["t"]))
    place = lambda within, side: F.when(within(side), 2).when(within(f"{side}_stay"), 1).otherwise(0)
    return F.when(m.isNotNull(), F.when(x.isNull(), 0).otherwise(place(above, "long") * 3 + place(below, "short"))).cast("tinyint")


def held(rows: DataFrame, n: int) -> DataFrame:
    """rows (pos, ticker, zones: those of n portfolios on rebalance rows) for each portfolio i, with its zone and what is held: now, on the row before (last), on the one before that (before).

    Holdings are three times the pos of the rebalance row and 0 if short, 1 if out, 2 if long; null before the first one. As in ``buffered_targets``, a name
    is long from a row within the share to enter up to one outside that to stay.
    """
    past = rows_of().rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(past)
    of = lambda place: latest(F.when(place == 2, True).when(place == 0, False))
    z = [F.col("zones")[i] for i in range(n)]
    out = rows.withColumns({k: c for i in range(n) for k, c in ((f"_l{i}", of(F.floor(z[i] / 3))), (f"_s{i}", of(z[i] % 3)), (f"_k{i}", latest(F.when(z[i].isNotNull(), F.col("pos")))))})
    now = F.array(*(F.col(f"_k{i}") * 3 + F.when(F.col(f"_l{i}"), 2).when(F.col(f"_s{i}"), 0).otherwise(1) for i in range(n)))
    out = out.select(*rows.columns, now.alias("_now")).withColumns({"_last": F.lag("_now", 1).over(rows_of()), "_before": F.lag("_now", 2).over(rows_of())})
    each = F.array(*(F.struct(F.lit(i).alias("i"), z[i].alias("zone"), *(F.col(f"_{c}")[i].alias(c) for c in ("now", "last", "before"))) for i in range(n)))
    return out.select(*(c for c in rows.columns if c != "zones"), F.inline(each))


def held_weights(kinds: DataFrame, cap: float | None = None) -> DataFrame:
    """i, held, w: equal weights of each side, by how many names (n of the kinds of rows: i, pos, now) take it on the rebalance row."""
    rows = kinds.filter(F.floor(F.col("now") / 3) == F.col("pos")).groupBy("i", F.col("now").alias("held")).agg(F.sum("n").alias("_n"))
    w = (F.col("held") % 3 - 1) / F.col("_n")
    if cap is not None:
        w = F.when(F.abs(w) > cap + 1e-12, F.raise_error(F.lit("the cap on a name's weight is infeasible"))).otherwise(w)
    return rows.select("i", "held", w.alias("w"))


def weighed(df: DataFrame, weights: DataFrame, *of: str) -> DataFrame:
    """df (i and holdings ``of``) with w_ and the holding's name: its weight, 0 where nothing was held yet. There are three weights a rebalance row at most."""
    for c in of:
        df = df.join(F.broadcast(weights.select("i", F.col("held").alias(c), F.col("w").alias(f"w_{c}"))), ["i", c], "left").withColumn(f"w_{c}", F.coalesce(f"w_{c}", F.lit(0.0)))
    return df


def executed(weights: DataFrame, returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, pos, ticker, w (the target of the row before), dw (its change), ret, on the returns' rows."""
    rows = returns.select(*by, "date", "pos", "ticker", F.coalesce("returns", F.lit(0.0)).alias("ret")).join(weights.select(*by, "date", "ticker", "w"), [*by, "date", "ticker"], "left")
    return _moved(rows, by)


def _moved(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumn("w", F.coalesce(F.lag(F.coalesce("w", F.lit(0.0))).over(rows_of(by)), F.lit(0.0)))
    return rows.withColumn("dw", F.col("w") - F.coalesce(F.lag("w").over(rows_of(by)), F.lit(0.0)))


def executed_targets(targets: DataFrame, by: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """As ``executed``, of targets that carry their rows' returns: nothing is joined or shuffled."""
    return _moved(targets.select(*by, "date", "pos", "ticker", F.coalesce("returns", F.lit(0.0)).alias("ret"), "w", *also), by)


def simulate(moves: DataFrame, bps: tuple[float, ...] = (10.0,), by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, pos, cost_bps, gross, turnover, net for each cost."""
    if min(bps) < 0:
        raise ValueError("costs aren't negative")
    daily = moves.groupBy(*by, "date", "pos").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"), F.sum(F.abs("dw")).alias("turnover"))
    return costed(daily, bps)


def costed(daily: DataFrame, bps: tuple[float, ...]) -> DataFrame:
    """daily (gross, turnover) for each cost, with net."""
    rows = daily.withColumn("cost_bps", F.explode(F.array(*map(F.lit, bps))))
    return rows.withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10_000)


def drawdowns(daily: DataFrame, x: str = "net", by: tuple[str, ...] = ("cost_bps",)) -> DataFrame:
    """wealth and drawdown of each row: the running product of 1 + x, and how far it is under its highest so far."""
    past = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("wealth", F.product(1 + F.col(x)).over(past))
    return rows.withColumn("drawdown", F.try_divide("wealth", F.max("wealth").over(past)) - 1)


def performance(daily: DataFrame, x: str = "net", by: tuple[str, ...] = ("cost_bps",)) -> DataFrame:
    """Yearly return and volatility, Sharpe, Sortino and Calmar ratios, deepest drawdown, win rate."""
    rows = drawdowns(daily, x, by).groupBy(*by).agg((F.avg(x) * YEAR).alias("annualized_return"), (F.stddev_samp(x) * math.sqrt(YEAR)).alias("annualized_volatility"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col(x) > 0).cast("double")).alias("win_rate"), (F.stddev_samp(F.least(x, F.lit(0.0))) * math.sqrt(YEAR)).alias("_down"), F.count(x).alias("n"))
    return rows.withColumns({"sharpe": F.try_divide("annualized_return", "annualized_volatility"), "sortino": F.try_divide("annualized_return", "_down"), "calmar": F.try_divide("annualized_return", F.abs("max_drawdown"))}).drop("_down")


@dataclass(frozen=True)
class Liquidity:
    """Half spread and impact in basis points, the impact's exponent, most participation that is costed."""

    spread_bps: float = 5.0
    impact_bps: float = 100.0
    exponent: float = 0.5
    cap: float = 0.20

    def __post_init__(self) -> None:
        if self.spread_bps < 0 or self.impact_bps < 0 or not 0 < self.exponent <= 1 or not 0 < self.cap <= 1:
            raise ValueError("costs aren't negative; exponent and cap are within (0, 1]")


def participation(moves: DataFrame, adv: DataFrame, aum: tuple[float, ...]) -> DataFrame:
    """moves for each AUM with the share of the name's ADV that is traded; that of ``illiquid`` trades (ADV missing) is infinite."""
    if not aum or min(aum) <= 0:
        raise ValueError("aum is positive")
    rows = moves.join(adv.select("date", "ticker", F.when(F.col("adv20") > 0, F.col("adv20")).alias("adv")), ["date", "ticker"], "left").withColumn("aum", F.explode(F.array(*(F.lit(float(a)) for a in aum))))
    traded = F.abs("dw") > 0
    return rows.withColumns({"illiquid": traded & F.col("adv").isNull(), "participation": F.when(~traded, 0.0).when(traded & F.col("adv").isNull(), float("inf")).otherwise(F.try_divide(F.abs("dw") * F.col("aum"), "adv"))})


def liquidity_costs(parts: DataFrame, model: Liquidity = Liquidity()) -> DataFrame:
    """parts with cost: spread and square-root impact of each trade; illiquid trades cost as at the cap."""
    used = F.when(F.col("illiquid"), model.cap).otherwise(F.least("participation", F.lit(model.cap)))
    return parts.withColumn("cost", F.abs("dw") * (model.spread_bps / 10_000 + model.impact_bps / 10_000 * F.pow(used, model.exponent)))


def capacity(parts: DataFrame, model: Liquidity = Liquidity(), by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each AUM (and group of ``by``): Sharpe ratio net of costs, yearly return, mean daily cost, greatest participation, breaches of the cap."""
    daily = liquidity_costs(parts, model).groupBy(*by, "aum", "date", "pos").agg((F.sum(F.col("w") * F.col("ret")) - F.sum("cost")).alias("net"), F.sum("cost").alias("cost"), F.max(F.when(F.abs("dw") > 0, F.col("participation"))).alias("p"), F.count_if(F.col("illiquid") | ((F.abs("dw") > 0) & F.coalesce(F.col("participation") > model.cap, F.lit(False)))).alias("breaches"))
    rows = daily.groupBy(*by, "aum").agg((F.avg("net") * YEAR).alias("annualized_return"), (F.stddev_samp("net") * math.sqrt(YEAR)).alias("_v"), F.avg("cost").alias("average_daily_cost"), F.max("p").alias("max_participation"), F.sum("breaches").alias("capacity_breach_trades"))
    return rows.withColumn("net_sharpe", F.try_divide("annualized_return", "_v")).drop("_v")


def exposure(weights: DataFrame, industry: DataFrame) -> DataFrame:
    """date, industry, exposure: net weights."""
    return weights.join(industry, "ticker").groupBy("date", "industry").agg(F.sum("w").alias("exposure"))


def max_exposure(exposures: DataFrame) -> DataFrame:
    return exposures.groupBy("date").agg(F.max(F.abs("exposure")).alias("max_abs_exposure"))
