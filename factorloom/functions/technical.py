"""Thirteen technical and six fundamental factors.

Technical factors run on each ticker's own bars (``pos`` counts them), not on the calendar; windows may be
partly filled. ``winsorize`` clips each ticker's values to its own 1% and 99% over all dates, which looks
ahead; it is off unless asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from factorloom.sources.market import finite

EPS = 1e-12


def rows_of() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("pos")


#: The families of factors.
FAMILIES = {
    "reversal": ("reversal_5d", "short_reversal_1d", "min_ret_reversal", "vwap_reversion", "median_reversion", "ts_rank_close", "stoch_reversal", "weekly_range_reversal", "amihud_illiq", "intraday_position"),
    "momentum": ("momentum_126d", "momentum_63d", "price_volume_corr"),
    "value": ("earnings_yield", "book_to_market", "roe_ttm", "gross_profitability", "asset_growth_penalty", "eps_momentum"),
}


def _rolling(agg, x: Column, n: int, least: int) -> Column:
    w = rows_of().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def _change(x: str, n: int) -> Column:
    """Relative change over n rows of the column x_pad (gaps padded)."""
    return finite(F.try_divide(F.col(x), F.lag(x, n).over(rows_of())) - 1)


def _lagged(a: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((np.full(min(n, len(a)), np.nan), a[:-n]))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; missing where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _windows(a: np.ndarray, n: int) -> np.ndarray:
    """A row for each value: it and the n - 1 before it, of which those before the first are missing."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(n - 1, np.nan), a)), n)


def _over(a: np.ndarray, n: int, least: int, agg) -> np.ndarray:
    """agg (of rows, and of which of their values are there) over the last n rows, where at least so many of them have a value."""
    w = _windows(a, n)
    has = ~np.isnan(w)
    enough = has.sum(axis=1) >= least
    out = np.full(len(a), np.nan)
    if enough.any():
        out[enough] = agg(w[enough], has[enough])
    return out


def _total(w: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.where(has, w, 0.0).sum(axis=1)


def _mean(w: np.ndarray, has: np.ndarray) -> np.ndarray:
    return _total(w, has) / has.sum(axis=1)


def _least(w: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.where(has, w, np.inf).min(axis=1)


def _most(w: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.where(has, w, -np.inf).max(axis=1)


def _median(w: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.nanmedian(w, axis=1)


def _correlated(x: np.ndarray, y: np.ndarray, n: int, least: int) -> np.ndarray:
    """Pearson's over the last n rows that have both, where there are so many and neither is constant."""
    both = ~np.isnan(x) & ~np.isnan(y)
    w, v = _windows(np.where(both, x, np.nan), n), _windows(np.where(both, y, np.nan), n)
    has = ~np.isnan(w)
    rows = np.flatnonzero(has.sum(axis=1) >= least)
    out = np.full(len(x), np.nan)
    if len(rows):
        w, v, has = w[rows], v[rows], has[rows]
        moves = (_least(w, has) < _most(w, has)) & (_least(v, has) < _most(v, has))
        dx, dy = (np.where(has, a - _mean(a, has)[:, None], 0.0) for a in (w, v))
        spread = np.sqrt((dx * dx).sum(axis=1)) * np.sqrt((dy * dy).sum(axis=1))
        out[rows] = np.where(moves, _ratio((dx * dy).sum(axis=1), spread), np.nan)
    return out


def _pad(a: np.ndarray) -> np.ndarray:
    """The last known value."""
    at = np.maximum.accumulate(np.where(np.isnan(a), -1, np.arange(len(a))))
    return np.where(at >= 0, a[at], np.nan)


def _clean(a: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(a), a, np.nan)


TECHNICAL = (*FAMILIES["reversal"], *FAMILIES["momentum"])


def factors_of_ticker(t: pa.Table, names: tuple[str, ...] = TECHNICAL) -> pa.Table:
    """The named factors of one ticker's bars, which it puts in order."""
    t = t.sort_by("date")
    high, low, open_, close, volume = (_clean(t.column(c).to_numpy().astype(float, copy=False)) for c in ("high", "low", "open", "close", "volume"))
    with np.errstate(all="ignore"):
        pad = _pad(close)
        change = lambda n: _clean(_ratio(pad, _lagged(pad, n)) - 1)

        def stochastic() -> np.ndarray:
            floor_ = _over(low, 14, 7, _least)
            return 50 - _over(100 * _ratio(close - floor_, _over(high, 14, 7, _most) - floor_ + EPS), 3, 2, _mean)

        def from_vwap() -> np.ndarray:
            vwap = _ratio(_over((high + low + close) / 3 * volume, 20, 10, _total), _over(volume, 20, 10, _total) + EPS)
            return -_ratio(close - vwap, vwap + EPS)

        def place() -> np.ndarray:
            seen = _windows(close, 20)
            n = (~np.isnan(seen)).sum(axis=1)
            at = (seen < close[:, None]).sum(axis=1) + ((seen == close[:, None]).sum(axis=1) + 1) / 2
            return -np.where((n >= 10) & ~np.isnan(close), at / np.maximum(n, 1), np.nan)

        def of_week() -> np.ndarray:
            week = _over(low, 5, 2, _least)
            return 0.5 - _ratio(close - week, _over(high, 5, 2, _most) - week + EPS)

        one, dollars = change(1), volume * (open_ + close) / 2
        out = {
            "reversal_5d": lambda: -change(5),
            "short_reversal_1d": lambda: -_over(one, 3, 1, _mean),
            "min_ret_reversal": lambda: -_over(change(8), 240, 120, _least),
            "vwap_reversion": from_vwap,
            "median_reversion": lambda: _ratio(_over(close, 40, 20, _median), np.where(close != 0, close, np.nan) + EPS),
            "ts_rank_close": place,
            "stoch_reversal": stochastic,
            "weekly_range_reversal": of_week,
            "amihud_illiq": lambda: np.log1p(_over(_clean(_ratio(np.abs(one), np.where(dollars != 0, dollars, np.nan) + EPS)), 20, 10, _mean) * 1e8),
            "intraday_position": lambda: -_over(_ratio(close - low, np.where(high != low, high - low, np.nan) + EPS), 5, 2, _mean),
            "momentum_126d": lambda: _lagged(change(126), 5),
            "momentum_63d": lambda: _lagged(change(63), 5),
            "price_volume_corr": lambda: _correlated(_lagged(np.log(np.where(high > 0, high, np.nan)), 1), np.log1p(np.where(volume > 0, volume, np.nan)), 237, 118),
        }
        made = {c: pa.array(_clean(out[c]()), from_pandas=True) for c in names}
    return pa.table({"date": t.column("date"), "ticker": t.column("ticker")} | made)


def technical(bars: DataFrame, winsorize: bool = False, names: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """date, ticker and the named ones of the thirteen factors of each bar. Bars are shuffled once by ticker; a task rolls over one ticker's arrays at a time."""
    types = dict(bars.dtypes)
    rows = bars.select("date", "ticker", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
    d = rows.groupBy("ticker").applyInArrow(lambda t: factors_of_ticker(t, names), f"date {types['date']}, ticker {types['ticker']}, " + ", ".join(f"{c} double" for c in names))
    return clip_by_ticker(d, names) if winsorize else d


def clip_by_ticker(df: DataFrame, columns: tuple[str, ...], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Each column clipped to its own quantiles over all of a ticker's rows."""
    w = Window.partitionBy("ticker")
    q = {f"_q{i}": F.percentile(c, F.array(F.lit(lo), F.lit(hi))).over(w) for i, c in enumerate(columns)}
    rows = df.withColumns(q)
    return rows.select(*(c for c in df.columns if c not in columns), *(F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q{i}")[1]), F.col(f"_q{i}")[0])).alias(c) for i, c in enumerate(columns)))


def fundamental(items: DataFrame, year: int = 252) -> DataFrame:
    """date, ticker and six factors of items (date, pos, ticker, close, net_income_ttm, gross_profit_ttm, equity, assets, shares)."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    pads = {f"_{c}": F.last(c, ignorenulls=True).over(rows_of().rowsBetween(Window.unboundedPreceding, 0)) for c in ("assets", "net_income_ttm")}
    d = items.withColumns(pads)
    equity = _rolling(F.avg, F.col("equity"), 2, 1)
    out = {
        "earnings_yield": F.try_divide(F.try_divide(F.col("net_income_ttm"), some("shares")), some("close")),
        "book_to_market": F.try_divide(F.col("equity"), F.col("close") * some("shares")),
        "roe_ttm": F.try_divide(F.col("net_income_ttm"), equity),
        "gross_profitability": F.try_divide(F.col("gross_profit_ttm"), some("assets")),
        "asset_growth_penalty": -_change("_assets", year),
        "eps_momentum": _change("_net_income_ttm", year),
    }
    return d.select("date", "ticker", *(finite(c).alias(n) for n, c in out.items()))


def families() -> list[tuple[str, str]]:
    return [(name, family) for family, names in FAMILIES.items() for name in names]
