"""Evaluation of factors: forward returns, information coefficients, quantiles, scorecards.

Factors are long: date, ticker, factor, value. An IC table (date, factor, horizon, ic, n) is computed once
and everything else about ICs is an aggregation of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from factorloom.operators.crosssection import mean_rank
from factorloom.sources.market import finite
from factorloom.sources.shared import deal, keep


def rows_of() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("pos")


def forward(h: int) -> Column:
    """The relative change of close over the next h rows."""
    return finite(F.try_divide(F.lead("close", h).over(rows_of()), "close") - 1)


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    """date, pos, ticker, horizon, fwd: the relative change of close over the next rows."""
    ahead = panel.select("date", "pos", "ticker", *(forward(h).alias(f"_{h}") for h in horizons))
    if len(horizons) == 1:
        return ahead.select("date", "pos", "ticker", F.lit(horizons[0]).alias("horizon"), F.col(f"_{horizons[0]}").alias("fwd"))
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("fwd")) for h in horizons))
    return ahead.select("date", "pos", "ticker", F.explode(each).alias("x")).select("date", "pos", "ticker", "x.horizon", "x.fwd")


def sanitize_returns(fwd: DataFrame, most: float = 0.30, q: float = 0.01) -> DataFrame:
    """Returns beyond ``most`` are dropped to null; the rest is clipped to the date's q and 1-q quantiles."""
    rows = fwd.withColumn("fwd", F.when(F.abs("fwd") <= most, F.col("fwd")))
    bounds = rows.groupBy("date", "horizon").agg(F.percentile("fwd", F.array(F.lit(q), F.lit(1 - q))).alias("_q"))
    rows = rows.join(bounds, ["date", "horizon"])
    return rows.withColumn("fwd", F.when(F.col("fwd").isNotNull(), F.greatest(F.least("fwd", F.col("_q")[1]), F.col("_q")[0]))).drop("_q")


def unpivot(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return wide.unpivot(["date", "ticker"], list(names), "factor", "value")


@dataclass(frozen=True)
class Wide:
    """Factors as columns of a panel's rows: ``names`` gives each factor's column. ``df`` has date, pos, ticker, close and returns too.

    ``ahead`` gives the columns of forward returns that df has, by horizon; others are made of close, which shuffles rows by ticker.
    ``rows`` is about how many df has; with it, dates are dealt to the tasks that so many rows need.
    """

    df: DataFrame
    names: dict[str, str]
    ahead: dict[int, str] = field(default_factory=dict)
    rows: int | None = None

    def forward(self, h: int) -> Column:
        return F.col(self.ahead[h]) if h in self.ahead else forward(h)

    @classmethod
    def of(cls, panel: DataFrame, factors: DataFrame) -> Wide:
        """From long factors of the panel's rows; their names are collected, as somebody wrote each one."""
        names = {n: f"_x{i}" for i, n in enumerate(sorted(r["factor"] for r in factors.select("factor").distinct().collect()))}
        cells = factors.groupBy("date", "ticker").agg(*(F.max(F.when(F.col("factor") == n, F.col("value"))).alias(c) for n, c in names.items())) if names else factors.select("date", "ticker").distinct()
        return cls(panel.join(cells, ["date", "ticker"], "left"), names)

    def kept(self) -> Wide:
        return Wide(keep(self.df), self.names, self.ahead, self.rows)

    def long(self) -> DataFrame:
        """date, ticker, factor, value."""
        if not self.names:
            return self.df.select("date", "ticker", F.lit("").alias("factor"), F.lit(None).cast("double").alias("value")).limit(0)
        return self.df.select("date", "ticker", *(F.col(c).alias(n) for n, c in self.names.items())).unpivot(["date", "ticker"], list(self.names), "factor", "value")

    def groups(self, horizon: int, q: int = 5, min_names: int = 30) -> DataFrame:
        """As ``quantile_groups`` of the long factors with the panel's forward returns, but nothing is joined."""
        ahead = self.df.select("date", "ticker", self.forward(horizon).alias("_fwd"), *(F.col(c).alias(n) for n, c in self.names.items())).filter("_fwd is not null")
        pairs = ahead.unpivot(["date", "ticker", "_fwd"], list(self.names), "factor", "value").filter("value is not null")
        return _groups(pairs.select("date", "ticker", "factor", F.lit(horizon).alias("horizon"), "value", F.col("_fwd").alias("fwd")), q, min_names)

    def ic(self, horizons: tuple[int, ...] = (1,), method: str = "spearman", min_names: int = 30) -> DataFrame:
        """As ``ic`` of the long factors with the panel's forward returns, but nothing is joined: a date's rows are shuffled once."""
        ahead = self.df.select("date", *self.names.values(), *(self.forward(h).alias(f"_fwd{h}") for h in horizons))
        return ic_by_date(deal(ahead, self.rows, "date"), ("date",), self.names, {h: f"_fwd{h}" for h in horizons}, method, min_names)


def mean_ranks(a: np.ndarray) -> np.ndarray:
    """Ranks from 1 with ties at their mean, of values of which none is missing."""
    order = np.argsort(a, kind="stable")
    s = a[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
    count = np.diff(np.concatenate((first, [len(s)])))
    out = np.empty(len(s))
    out[order] = np.repeat(first + (count + 1) / 2, count)
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's; None where a side is constant."""
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt(x @ x) * math.sqrt(y @ y)
    return float(x @ y / size) if size > 0 else None


def column(t: pa.Table, name: str) -> np.ndarray:
    """A column of doubles; what is missing is NaN."""
    return t.column(name).to_numpy().astype(float, copy=False)


def ic_by_date(df: DataFrame, keys: tuple[str, ...], names: dict[str, str], horizons: dict[int, str], method: str, min_names: int) -> DataFrame:
    """keys, factor, horizon, n, ic of the columns of ``names`` with those of ``horizons``; a task holds the names of one date."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method is spearman or pearson")
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "factor string, horizon int, n long, ic double"])
    columns = [*names.values(), *horizons.values()]

    def one(key: tuple, t: pa.Table) -> pa.Table:
        v = {c: column(t, c) for c in columns}
        has = {c: ~np.isnan(a) for c, a in v.items()}
        rows = []
        for name, c in names.items():
            for h, f in horizons.items():
                both = has[c] & has[f]
                n = int(both.sum())
                if n < max(min_names, 1):
                    continue
                x, y = v[c][both], v[f][both]
                if x.min() < x.max() and y.min() < y.max():
                    rows.append((name, h, n, correlation(mean_ranks(x), mean_ranks(y)) if method == "spearman" else correlation(x, y)))
        given = {k: pa.array([key[i].as_py()] * len(rows), key[i].type) for i, k in enumerate(keys)}
        return pa.table(given | {"factor": pa.array([r[0] for r in rows], pa.string()), "horizon": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64()), "ic": pa.array([r[3] for r in rows], pa.float64())})

    return df.select(*keys, *columns).groupBy(*keys).applyInArrow(one, schema)


def pearson(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic(factors: DataFrame, fwd: DataFrame, method: str = "spearman", min_names: int = 30) -> DataFrame:
    """date, factor, horizon, n, ic; dates with too few names or a constant side are left out."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method is spearman or pearson")
    pairs = factors.filter("value is not null").join(fwd.filter("fwd is not null"), ["date", "ticker"])
    key = ("date", "factor", "horizon")
    if method == "spearman":
        pairs = pairs.withColumns({"x": mean_rank(F.col("value"), key), "y": mean_rank(F.col("fwd"), key)})
    else:
        pairs = pairs.withColumnsRenamed({"value": "x", "fwd": "y"})
    rows = pairs.groupBy(*key).agg(F.count("*").alias("n"), pearson("x", "y").alias("ic"), ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("ok"))
    return rows.filter((F.col("n") >= min_names) & F.col("ok")).drop("ok")


def ic_summary(ics: DataFrame, per_year: float = 252.0) -> DataFrame:
    """A row for each factor and horizon: mean, deviation, their ratio (per year too), share above 0, dates."""
    rows = ics.groupBy("factor", "horizon").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"), F.count("ic").alias("observations"))
    ratio = F.try_divide("ic_mean", "ic_std")
    return rows.withColumns({"ic_ir": ratio, "ic_ir_annualized": ratio * math.sqrt(per_year)})


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float | None, df: float) -> float | None:
    """The two-sided p-value of Student's t."""
    return None if t is None or df <= 0 else _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float | None, level: float) -> float | None:
    """The t whose two-sided p-value is ``level``, by halving."""
    if df is None or df <= 0:
        return None
    lo, hi = 0.0, 1.0
    while t_tail(hi, df) > level:
        lo, hi = hi, 2 * hi
    for _ in range(100):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_tail(mid, df) > level else (lo, mid)
    return hi


def ic_t_test(ics: DataFrame, level: float = 0.05) -> DataFrame:
    """mean, standard error, t, p, whether p is under ``level``, and the interval of the mean at 1 - level, for each factor and horizon; fewer than two ICs have neither p nor interval."""
    if not 0 < level < 1:
        raise ValueError("level is within (0, 1)")
    rows = ics.groupBy("factor", "horizon").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.count("ic").alias("n"))
    rows = rows.withColumns({"se": F.col("sd") / F.sqrt("n"), "t": F.try_divide("mean", F.col("sd") / F.sqrt("n"))})
    tail, critical = F.udf(t_tail, "double"), F.udf(t_critical, "double")  # one call for each factor and horizon
    rows = rows.withColumn("p", tail("t", F.col("n") - 1.0)).withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))
    half = critical(F.col("n") - 1.0, F.lit(level)) * F.col("se")
    return rows.withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half}).drop("sd")


def quantile_groups(factors: DataFrame, fwd: DataFrame, q: int = 5, min_names: int = 30) -> DataFrame:
    """date, factor, horizon, bucket, mean_return, names: equal-count groups by value, ties by ticker."""
    return _groups(factors.filter("value is not null").join(fwd.filter("fwd is not null"), ["date", "ticker"]), q, min_names)


def _groups(pairs: DataFrame, q: int, min_names: int) -> DataFrame:
    w = Window.partitionBy("date", "factor", "horizon")
    pairs = pairs.withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("value", "ticker")), "varies": F.min("value").over(w) < F.max("value").over(w)})
    pairs = pairs.filter((F.col("n") >= max(min_names, q)) & F.col("varies"))
    bucket = F.greatest(F.lit(1), F.ceil((F.col("nth") - 1) * q / (F.col("n") - 1))).cast("int")
    return pairs.groupBy("date", "factor", "horizon", bucket.alias("bucket")).agg(F.avg("fwd").alias("mean_return"), F.count("*").alias("names"))


def quantile_returns(groups: DataFrame, q: int = 5) -> DataFrame:
    """A row for each date: group_1..group_q and top_bottom."""
    wide = groups.groupBy("date", "factor", "horizon").agg(*(F.max(F.when(F.col("bucket") == k, F.col("mean_return"))).alias(f"group_{k}") for k in range(1, q + 1)))
    return wide.withColumn("top_bottom", F.col(f"group_{q}") - F.col("group_1"))


def stratification(groups: DataFrame, q: int = 5) -> DataFrame:
    """For each factor the mean return of each group, the spread with its t, how monotonic the means are, and the dates."""
    wide = quantile_returns(groups, q)
    rows = wide.groupBy("factor", "horizon").agg(*(F.avg(f"group_{k}").alias(f"group_{k}") for k in range(1, q + 1)), F.avg("top_bottom").alias("top_bottom_mean"), F.stddev_samp("top_bottom").alias("_sd"), F.count("top_bottom").alias("_n"), F.count("*").alias("n_obs"))
    rows = rows.withColumn("top_bottom_t", F.try_divide("top_bottom_mean", F.col("_sd") / F.sqrt("_n"))).drop("_sd", "_n")
    means = F.array(*(F.col(f"group_{k}") for k in range(1, q + 1)))
    place = F.transform(means, lambda v: F.size(F.filter(means, lambda u: u < v)) + (F.size(F.filter(means, lambda u: u == v)) + 1) / 2)
    # Spearman over 1..q: both sides have mean (q+1)/2
    mid = (q + 1) / 2
    top = F.aggregate(F.transform(place, lambda p, i: (p - mid) * (i + 1 - mid)), F.lit(0.0), lambda a, b: a + b)
    own = F.aggregate(F.transform(place, lambda p: (p - mid) * (p - mid)), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("monotonicity", F.try_divide(top, F.sqrt(own * float(sum((k - mid) ** 2 for k in range(1, q + 1))))))


def group_backtest(groups: DataFrame, calendar: DataFrame, horizon: int, per_year: float = 252.0) -> DataFrame:
    """For each group: yearly return, Sharpe ratio, return compounded over every horizon-th row of the calendar, names."""
    rows = groups.filter(F.col("horizon") == horizon).join(calendar.select("date", "pos").distinct(), "date")
    kept = F.when((F.col("pos") - 1) % horizon == 0, 1 + F.col("mean_return"))
    out = rows.groupBy("factor", "bucket").agg(F.avg("mean_return").alias("mean_forward_return"), F.stddev_samp("mean_return").alias("_sd"), (F.product(kept) - 1).alias("cumulative_return"), F.avg("names").alias("avg_count"))
    return out.withColumns({"annualized_return": F.col("mean_forward_return") * (per_year / horizon), "sharpe": F.try_divide("mean_forward_return", "_sd") * math.sqrt(per_year / horizon)}).drop("_sd")


def ic_by_label(ics: DataFrame, label: Column) -> DataFrame:
    """Mean IC of each factor in each period (a year, or any label of the date)."""
    return ics.groupBy("factor", "horizon", label.alias("label")).agg(F.avg("ic").alias("mean_ic"), F.min("date").alias("since"), F.count("*").alias("n"))


def span_label(date: Column, cuts: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """The name of the half-open span between cut dates that date lies in."""
    if len(names) != len(cuts) + 1 or list(cuts) != sorted(set(cuts)):
        raise ValueError("cuts ascend, and there is one more name")
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names[:-1], strict=True))):
        out = F.when(date < F.lit(cut).cast("date"), name).otherwise(out)
    return out


def stability(labels: DataFrame) -> DataFrame:
    """For each factor: the sign of the mean over periods, the share of periods that agree, the least absolute mean, the worst period."""
    mean = labels.groupBy("factor", "horizon").agg(F.avg("mean_ic").alias("mean_over_labels"))
    rows = labels.join(mean, ["factor", "horizon"]).withColumn("direction", F.when(F.col("mean_over_labels") >= 0, 1).otherwise(-1))
    return rows.groupBy("factor", "horizon", "direction", "mean_over_labels").agg(F.avg((F.signum("mean_ic") == F.col("direction")).cast("double")).alias("consistency"), F.min(F.abs("mean_ic")).alias("min_abs_ic"), F.min_by("label", F.struct(F.col("mean_ic") * F.col("direction"), "label")).alias("worst_label"))


def factor_scorecard(ics: DataFrame, pearson_ics: DataFrame, strat: DataFrame, turnover: DataFrame, coverage: DataFrame, per_year: float = 252.0) -> DataFrame:
    """A row for each factor and horizon that joins its ICs, groups, turnover and coverage."""
    mean = ics.groupBy("factor", "horizon").agg(F.avg("ic").alias("rank_ic"), F.stddev_samp("ic").alias("_sd"), F.count("ic").alias("n_obs"))
    hits = ics.join(mean, ["factor", "horizon"]).groupBy("factor", "horizon").agg(F.avg((F.signum("ic") == F.signum("rank_ic")).cast("double")).alias("ic_hit_rate"))
    other = pearson_ics.groupBy("factor", "horizon").agg(F.avg("ic").alias("pearson_ic"))
    s = strat.select("factor", "horizon", "monotonicity", F.col("top_bottom_mean").alias("long_short_mean"), F.col("top_bottom_t").alias("long_short_t"))
    rows = mean.join(hits, ["factor", "horizon"]).join(other, ["factor", "horizon"], "left").join(s, ["factor", "horizon"], "left").join(turnover, "factor", "left").join(coverage, "factor", "left")
    icir = F.try_divide("rank_ic", "_sd")
    return rows.withColumns({"rank_ic_t": icir * F.sqrt("n_obs"), "icir": icir, "icir_annualized": icir * F.sqrt(per_year / F.col("horizon"))}).drop("_sd")


def rank_turnover(factors: DataFrame, calendar: DataFrame, every: int = 5, min_names: int = 30) -> DataFrame:
    """For each factor the mean absolute change of rank shares from one rebalance row (each ``every``-th) to the next."""
    days = calendar.select("date", "pos").distinct().filter((F.col("pos") - 1) % every == 0).withColumn("k", ((F.col("pos") - 1) / every).cast("int"))
    rows = factors.join(F.broadcast(days), "date")  # a row a date
    rows = rows.withColumn("p", mean_rank(F.col("value"), ("date", "factor")) / F.count("value").over(Window.partitionBy("date", "factor")))
    before = Window.partitionBy("factor", "ticker").orderBy("k")
    rows = rows.withColumns({"q": F.lag("p").over(before), "j": F.lag("k").over(before)}).filter("p is not null and q is not null and j = k - 1")
    daily = rows.groupBy("factor", "k").agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("change"), F.count("*").alias("n")).filter(F.col("n") >= min_names)
    return daily.groupBy("factor").agg(F.avg("change").alias("rank_turnover"))
