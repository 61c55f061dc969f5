"""SQL (DuckDB) for the registered queries, written from the definitions: where the Spark side uses a window, many of
these count or join instead."""

from __future__ import annotations

from factorloom.functions.technical import families
from factorloom.plans.formula import DEFAULTS

#: The panel: bars of suppliers, the calendar, all tickers on all dates, and the inputs of formulas.
BARS = """b0 AS (SELECT CAST(l_suppkey AS BIGINT) AS ticker, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS px,
  CAST(l_quantity AS DOUBLE) AS q, l_shipdate AS s, l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_quantity > 0),
bars AS (SELECT ticker, date, first(px ORDER BY s, o, n, p) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY s, o, n, p) AS close, sum(q) AS volume FROM b0 GROUP BY ticker, date),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM bars)),
dense AS (SELECT c.date, c.pos, t.ticker, b.open, b.high, b.low, b.close, b.volume FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM bars) t
  LEFT JOIN bars b ON b.date = c.date AND b.ticker = t.ticker)"""
PANEL = BARS.format(grain="week") + """,
p0 AS (SELECT date, pos, ticker, open, high, low, close, (open + high + low + close) / 4 AS vwap, volume AS reported_volume FROM dense),
p1 AS (SELECT *, vwap * reported_volume AS volume FROM p0),
panel AS MATERIALIZED (SELECT *, CASE WHEN count(volume) OVER w = 20 THEN sum(volume) OVER w / 20 END AS adv20,
  close / lag(close) OVER (PARTITION BY ticker ORDER BY pos) - 1 AS returns FROM p1
  WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS 19 PRECEDING)),
ind AS (SELECT CAST(s_suppkey AS BIGINT) AS ticker, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
WEEK = BARS.format(grain="week")


class Q:
    """A growing list of common table expressions, each with one more column than the last."""

    def __init__(self, start: str = PANEL, at: str = "panel"):
        self.ctes, self.at, self.k = [start], at, 0

    def _next(self, body: str) -> str:
        name = f"c{self.k}"
        self.ctes.append(f"t{self.k} AS MATERIALIZED ({body.format(c=name, at=self.at)})")
        self.at, self.k = f"t{self.k}", self.k + 1
        return name

    def col(self, e: str) -> str:
        return self._next(f"SELECT *, {e} AS {{c}} FROM {{at}}")

    def rank(self, e: str) -> str:
        x = self.col(e)
        return self._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.date, x.ticker, (count_if(y.{x} < x.{x}) + (count_if(y.{x} = x.{x}) + 1) / 2) / count(y.{x}) AS v FROM {{at}} x JOIN {{at}} y ON y.date = x.date WHERE x.{x} IS NOT NULL GROUP BY x.date, x.ticker) r ON r.date = a.date AND r.ticker = a.ticker")

    def lag(self, e: str, n: int) -> str:
        return self.col(f"lag({e}, {n}) OVER (PARTITION BY ticker ORDER BY pos)")

    def delta(self, e: str, n: int) -> str:
        x = self.col(e)
        return self.col(f"{x} - lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY pos)")

    def ts(self, agg: str, e: str, n: int) -> str:
        """agg(x) over the last n rows that are all there, by joining each row with its n last ones."""
        x = self.col(e)
        return self._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.pos, x.ticker, {agg.replace('(x)', f'(y.{x})')} AS v FROM {{at}} x JOIN {{at}} y ON y.ticker = x.ticker AND y.pos BETWEEN x.pos - {n - 1} AND x.pos GROUP BY x.pos, x.ticker HAVING count(y.{x}) = {n}) r ON r.pos = a.pos AND r.ticker = a.ticker")

    def ts_rank(self, e: str, n: int) -> str:
        x = self.col(e)
        return self._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.pos, x.ticker, (count_if(y.{x} < x.{x}) + (count_if(y.{x} = x.{x}) + 1) / 2) / {n} AS v FROM {{at}} x JOIN {{at}} y ON y.ticker = x.ticker AND y.pos BETWEEN x.pos - {n - 1} AND x.pos GROUP BY x.pos, x.ticker HAVING count(y.{x}) = {n}) r ON r.pos = a.pos AND r.ticker = a.ticker")

    def corr(self, a: str, b: str, n: int) -> str:
        x, y = self.col(a), self.col(b)
        ok = f"z.{x} IS NOT NULL AND z.{y} IS NOT NULL"
        return self._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.pos, x.ticker, covar_pop(z.{x}, z.{y}) / nullif(stddev_pop(z.{x}) * stddev_pop(z.{y}), 0) AS v FROM {{at}} x JOIN {{at}} z ON z.ticker = x.ticker AND z.pos BETWEEN x.pos - {n - 1} AND x.pos AND {ok} GROUP BY x.pos, x.ticker HAVING count(*) = {n} AND min(z.{x}) < max(z.{x}) AND min(z.{y}) < max(z.{y})) r ON r.pos = a.pos AND r.ticker = a.ticker")

    def end(self, body: str, *more: str) -> str:
        return "WITH " + ",\n".join([*self.ctes, *more]) + "\n" + body.format(at=self.at)

    def value(self, e: str, digits: int = 5) -> str:
        return self.end(f"SELECT date, ticker, round({e}, {digits}) AS value FROM {{at}}")


def sgn(x: str) -> str:
    return f"CAST(sign({x}) AS DOUBLE)"


def _ops() -> dict[str, str]:
    out = {}

    def put(name: str, digits: int, build) -> None:
        q = Q()
        out[f"op_{name}"] = q.value(build(q), digits)

    put("rank", 6, lambda q: q.rank("close"))
    put("delay", 6, lambda q: q.lag("close", 3))
    put("delta", 6, lambda q: q.delta("close", 2))
    put("ts_sum", 2, lambda q: q.ts("sum(x)", "volume", 5))
    put("ts_min", 6, lambda q: q.ts("min(x)", "low", 10))
    put("ts_max", 6, lambda q: q.ts("max(x)", "high", 10))
    put("stddev", 4, lambda q: q.ts("stddev_samp(x)", "close", 8))
    put("ts_rank", 6, lambda q: q.ts_rank("close", 10))
    put("correlation", 6, lambda q: q.corr("close", "volume", 6))
    put("abs", 6, lambda q: f"abs({q.delta('close', 1)})")
    put("sign", 6, lambda q: sgn(q.delta("close", 1)))
    put("signed_power", 4, lambda q: f"{sgn('returns')} * sqrt(abs(returns))")
    put("safe_divide", 6, lambda q: "close / nullif(reported_volume - 25, 0)")
    put("where", 6, lambda q: "CASE WHEN close > open THEN high WHEN close <= open THEN low END")
    put("adv", 2, lambda q: f"{q.ts('sum(x)', 'close * reported_volume', 5)} / 5")
    put("log", 6, lambda q: "CASE WHEN close > 1000 THEN ln(close - 1000) END")
    put("modulo", 4, lambda q: "(close - open) - 7 * floor((close - open) / 7)")

    def covariance(q: Q) -> str:
        x, y = q.col("close / 1000"), q.col("reported_volume")
        return q._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.pos, x.ticker, covar_samp(z.{x}, z.{y}) AS v FROM {{at}} x JOIN {{at}} z ON z.ticker = x.ticker AND z.pos BETWEEN x.pos - 5 AND x.pos AND z.{x} IS NOT NULL AND z.{y} IS NOT NULL GROUP BY x.pos, x.ticker HAVING count(*) = 6) r ON r.pos = a.pos AND r.ticker = a.ticker")

    put("covariance", 6, covariance)
    return out


def _alphas() -> dict[str, str]:
    out = {}

    def put(n: int, build) -> None:
        q = Q()
        out[f"alpha_{n:03d}"] = q.value(build(q))

    def a007(q: Q) -> str:
        d = q.delta("close", 7)
        r = q.ts_rank(f"abs({d})", 60)
        return f"CASE WHEN adv20 IS NULL OR volume IS NULL THEN NULL WHEN adv20 < volume THEN -{r} * {sgn(d)} ELSE -1 END"

    def a021(q: Q) -> str:
        s, f, d, a = q.ts("sum(x)", "close", 8), q.ts("sum(x)", "close", 2), q.ts("stddev_samp(x)", "close", 8), q.col("volume / nullif(adv20, 0)")
        return f"CASE WHEN {s} + {f} + {d} + {a} IS NULL THEN NULL WHEN {s} / 8 + {d} < {f} / 2 THEN -1.0 WHEN {f} / 2 < {s} / 8 - {d} THEN 1.0 WHEN {a} >= 1 THEN 1.0 ELSE -1.0 END"

    def a030(q: Q) -> str:
        c = [q.lag("close", k) for k in (1, 2, 3)]
        r = q.rank(f"{sgn(f'close - {c[0]}')} + {sgn(f'{c[0]} - {c[1]}')} + {sgn(f'{c[1]} - {c[2]}')}")
        return f"(1 - {r}) * {q.ts('sum(x)', 'volume', 5)} / nullif({q.ts('sum(x)', 'volume', 20)}, 0)"

    def a046(q: Q) -> str:
        a, b, d = q.lag("close", 20), q.lag("close", 10), q.delta("close", 1)
        s = q.col(f"({a} - {b}) / 10 - ({b} - close) / 10")
        return f"CASE WHEN {s} IS NULL OR {d} IS NULL THEN NULL WHEN {s} > 0.25 THEN -1.0 WHEN {s} < 0 THEN 1.0 ELSE -{d} END"

    put(2, lambda q: f"-{q.corr(q.rank(q.delta('CASE WHEN volume > 0 THEN ln(volume) END', 2)), q.rank('(close - open) / nullif(open, 0)'), 6)}")
    put(7, a007)
    put(12, lambda q: f"{sgn(q.delta('volume', 1))} * -{q.delta('close', 1)}")
    put(17, lambda q: f"-{q.rank(q.ts_rank('close', 10))} * {q.rank(q.delta(q.delta('close', 1), 1))} * {q.rank(q.ts_rank('volume / nullif(adv20, 0)', 5))}")
    put(21, a021)
    put(22, lambda q: f"-({q.delta(q.corr('high', 'volume', 5), 5)} * {q.rank(q.ts('stddev_samp(x)', 'close', 20))})")
    put(30, a030)
    put(34, lambda q: q.rank(f"(1 - {q.rank(q.ts('stddev_samp(x)', 'returns', 2) + ' / nullif(' + q.ts('stddev_samp(x)', 'returns', 5) + ', 0)')}) + (1 - {q.rank(q.delta('close', 1))})"))
    put(35, lambda q: f"{q.ts_rank('volume', 32)} * (1 - {q.ts_rank('close + high - low', 16)}) * (1 - {q.ts_rank('returns', 32)})")
    put(40, lambda q: f"-{q.rank(q.ts('stddev_samp(x)', 'high', 10))} * {q.corr('high', 'volume', 10)}")
    put(46, a046)
    put(101, lambda q: "(close - open) / (high - low + 0.001)")
    return out


OWN = WEEK + """,
own AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS pos FROM bars)"""


def _part(agg: str, x: str, n: int, least: int) -> str:
    w = f"(PARTITION BY ticker ORDER BY pos ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {agg}({x}) OVER {w} END"


def _technical() -> dict[str, str]:
    out = {}

    def put(name: str, build) -> None:
        q = Q(OWN, "own")
        out[f"fac_{name}"] = q.value(build(q))

    change = lambda q, n: q.col(f"close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY pos) - 1")
    put("reversal_5d", lambda q: f"-{change(q, 5)}")
    put("short_reversal_1d", lambda q: f"-{q.col(_part('avg', change(q, 1), 3, 1))}")
    put("min_ret_reversal", lambda q: f"-{q.col(_part('min', change(q, 8), 240, 120))}")
    put("momentum_126d", lambda q: q.lag(change(q, 126), 5))
    put("momentum_63d", lambda q: q.lag(change(q, 63), 5))

    def vwap(q: Q) -> str:
        t = q.col("(high + low + close) / 3 * volume")
        v = q.col(f"{q.col(_part('sum', t, 20, 10))} / ({q.col(_part('sum', 'volume', 20, 10))} + 1e-12)")
        return f"-(close - {v}) / ({v} + 1e-12)"

    put("vwap_reversion", vwap)
    put("median_reversion", lambda q: f"{q.col(_part('median', 'close', 40, 20))} / (close + 1e-12)")

    def ts_rank(q: Q) -> str:
        return "-" + q._next("SELECT a.*, r.v AS {c} FROM {at} a LEFT JOIN (SELECT x.pos, x.ticker, (count_if(y.close < x.close) + (count_if(y.close = x.close) + 1) / 2) / count(*) AS v FROM {at} x JOIN {at} y ON y.ticker = x.ticker AND y.pos BETWEEN x.pos - 19 AND x.pos GROUP BY x.pos, x.ticker HAVING count(*) >= 10) r ON r.pos = a.pos AND r.ticker = a.ticker")

    put("ts_rank_close", ts_rank)

    def stoch(q: Q) -> str:
        lo, hi = q.col(_part("min", "low", 14, 7)), q.col(_part("max", "high", 14, 7))
        return f"50 - {q.col(_part('avg', q.col(f'100 * (close - {lo}) / ({hi} - {lo} + 1e-12)'), 3, 2))}"

    put("stoch_reversal", stoch)
    put("weekly_range_reversal", lambda q: "0.5 - (close - {lo}) / ({hi} - {lo} + 1e-12)".format(lo=q.col(_part("min", "low", 5, 2)), hi=q.col(_part("max", "high", 5, 2))))

    def pv(q: Q) -> str:
        x, y = q.lag("ln(high)", 1), q.col("ln(1 + volume)")
        return q._next(f"SELECT a.*, r.v AS {{c}} FROM {{at}} a LEFT JOIN (SELECT x.pos, x.ticker, covar_pop(z.{x}, z.{y}) / nullif(stddev_pop(z.{x}) * stddev_pop(z.{y}), 0) AS v FROM {{at}} x JOIN {{at}} z ON z.ticker = x.ticker AND z.pos BETWEEN x.pos - 236 AND x.pos AND z.{x} IS NOT NULL GROUP BY x.pos, x.ticker HAVING count(*) >= 118) r ON r.pos = a.pos AND r.ticker = a.ticker")

    put("price_volume_corr", pv)
    put("amihud_illiq", lambda q: "ln(1 + 1e8 * {})".format(q.col(_part("avg", q.col(f"abs({change(q, 1)}) / (volume * (open + close) / 2 + 1e-12)"), 20, 10))))
    put("intraday_position", lambda q: f"-{q.col(_part('avg', q.col('(close - low) / (nullif(high - low, 0) + 1e-12)'), 5, 2))}")
    q = Q(OWN, "own")
    a, b = q.col(f"-{change(q, 5)}"), q.lag(change(q, 63), 5)
    clip = lambda x: f"round(CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {x}_hi), {x}_lo) END, 5)"
    out["fac_winsorized"] = q.end(f"SELECT date, ticker, {clip(a)} AS reversal_5d, {clip(b)} AS momentum_63d FROM {{at}} JOIN bounds USING (ticker)", "bounds AS (SELECT ticker, " + ", ".join(f"quantile_cont({x}, 0.01) AS {x}_lo, quantile_cont({x}, 0.99) AS {x}_hi" for x in (a, b)) + f" FROM {q.at} GROUP BY ticker)")
    return out


ITEMS = BARS.format(grain="month") + """,
items AS (SELECT date, pos, ticker, close, sum(open) OVER y AS ni, sum(high) OVER y AS gp, sum(volume) OVER a AS equity, sum(close) OVER a + sum(volume) OVER a AS assets, sum(volume) OVER y AS shares
  FROM dense WINDOW y AS (PARTITION BY ticker ORDER BY pos ROWS 11 PRECEDING), a AS (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING)),
padded AS (SELECT *, last_value(assets IGNORE NULLS) OVER w AS pa, last_value(ni IGNORE NULLS) OVER w AS pn FROM items WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def _fundamental() -> dict[str, str]:
    out = {}

    def put(name: str, e) -> None:
        q = Q(ITEMS, "padded")
        out[f"fund_{name}"] = q.value(e(q) if callable(e) else e)

    put("earnings_yield", "ni / nullif(shares, 0) / nullif(close, 0)")
    put("book_to_market", "equity / nullif(close * nullif(shares, 0), 0)")
    put("roe_ttm", lambda q: f"ni / nullif({q.col(_part('avg', 'equity', 2, 1))}, 0)")
    put("gross_profitability", "gp / nullif(assets, 0)")
    put("asset_growth_penalty", lambda q: f"-({q.col('pa / nullif(lag(pa, 12) OVER (PARTITION BY ticker ORDER BY pos), 0) - 1')})")
    put("eps_momentum", lambda q: q.col("pn / nullif(lag(pn, 12) OVER (PARTITION BY ticker ORDER BY pos), 0) - 1"))
    return out


def _formulas(q: Q) -> dict[str, str]:
    """The default formulas as columns of q."""
    out = {"reversal_5": f"-{q.delta('close', 5)} / nullif({q.lag('close', 5)}, 0)", "volatility_20": f"-{q.ts('stddev_samp(x)', 'returns', 20)}", "intraday": "(close - open) / (high - low + 0.001)", "volume_price": f"-{q.corr(q.rank('close'), q.rank('volume'), 10)}"}
    assert list(out) == list(DEFAULTS)
    return out


def _long(horizons: tuple[int, ...] = (1,)) -> tuple[Q, list[str]]:
    """factors (date, pos, ticker, factor, value) and fwd (date, ticker, horizon, fwd)."""
    q = Q()
    cols = _formulas(q)
    more = ["factors AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT date, pos, ticker, '{n}' AS factor, CAST({e} AS DOUBLE) AS value FROM {q.at}" for n, e in cols.items()) + ")"]
    more.append("fwd AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT a.date, a.ticker, {h} AS horizon, b.close / a.close - 1 AS fwd FROM panel a JOIN panel b ON b.ticker = a.ticker AND b.pos = a.pos + {h} WHERE b.close IS NOT NULL AND a.close IS NOT NULL" for h in horizons) + ")")
    return q, more


PAIRS = "pairs AS (SELECT f.date, f.pos, f.ticker, f.factor, f.value, w.horizon, w.fwd FROM factors f JOIN fwd w ON w.date = f.date AND w.ticker = f.ticker WHERE f.value IS NOT NULL)"
RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY date, factor, horizon ORDER BY value) + (count(*) OVER (PARTITION BY date, factor, horizon, value) - 1) / 2 AS x,
  rank() OVER (PARTITION BY date, factor, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY date, factor, horizon, fwd) - 1) / 2 AS y FROM pairs)"""
CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"

VALUE_CORR = f"""joined AS (SELECT a.date, a.factor AS l, b.factor AS r, a.ticker, a.value AS u, b.value AS v FROM factors a JOIN factors b ON b.date = a.date AND b.ticker = a.ticker AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
jr AS (SELECT date, l, r, rank() OVER (PARTITION BY date, l, r ORDER BY u) + (count(*) OVER (PARTITION BY date, l, r, u) - 1) / 2 AS x, rank() OVER (PARTITION BY date, l, r ORDER BY v) + (count(*) OVER (PARTITION BY date, l, r, v) - 1) / 2 AS y FROM joined),
dc AS (SELECT date, l, r, {CORR.format(x='x', y='y')} AS c FROM jr GROUP BY ALL HAVING count(*) >= 30)"""


def _ic_sql(source: str = "ranked", x: str = "x", y: str = "y", name: str = "ics", least: int = 30) -> str:
    return f"{name} AS MATERIALIZED (SELECT date, factor, horizon, count(*) AS n, {CORR.format(x=x, y=y)} AS ic FROM {source} GROUP BY date, factor, horizon HAVING count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}))"


GROUPS = """numbered AS (SELECT *, count(*) OVER (PARTITION BY date, factor, horizon) AS n, row_number() OVER (PARTITION BY date, factor, horizon ORDER BY value, ticker) AS nth,
  min(value) OVER (PARTITION BY date, factor, horizon) AS lo, max(value) OVER (PARTITION BY date, factor, horizon) AS hi FROM pairs),
grouped AS (SELECT date, factor, horizon, CAST(greatest(1, ((nth - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS bucket, avg(fwd) AS mean_return, count(*) AS names FROM numbered WHERE n >= 30 AND lo < hi GROUP BY ALL),
wide AS (SELECT date, factor, horizon, """ + ", ".join(f"max(mean_return) FILTER (bucket = {k}) AS group_{k}" for k in range(1, 6)) + """, max(mean_return) FILTER (bucket = 5) - max(mean_return) FILTER (bucket = 1) AS top_bottom FROM grouped GROUP BY ALL)"""
STRAT = """strat AS (SELECT factor, horizon, """ + ", ".join(f"avg(group_{k}) AS group_{k}" for k in range(1, 6)) + """, avg(top_bottom) AS top_bottom_mean, avg(top_bottom) / (stddev_samp(top_bottom) / sqrt(count(top_bottom))) AS top_bottom_t, count(*) AS n_obs FROM wide GROUP BY ALL),
mono0 AS (SELECT factor, horizon, g, v, rank() OVER (PARTITION BY factor, horizon ORDER BY v) AS rv FROM (SELECT factor, horizon, unnest([1, 2, 3, 4, 5]) AS g, unnest([group_1, group_2, group_3, group_4, group_5]) AS v FROM strat)),
mono AS (SELECT factor, horizon, """ + CORR.format(x="g", y="rv") + """ AS monotonicity FROM mono0 GROUP BY ALL)"""
TURN = """scheduled AS (SELECT date, factor, ticker, (pos - 1) // 5 AS k, value FROM factors WHERE (pos - 1) % 5 = 0 AND value IS NOT NULL),
shares AS (SELECT factor, ticker, k, (rank() OVER (PARTITION BY date, factor ORDER BY value) + (count(*) OVER (PARTITION BY date, factor, value) - 1) / 2) / count(*) OVER (PARTITION BY date, factor) AS p FROM scheduled),
changes AS (SELECT a.factor, a.k, avg(abs(a.p - b.p)) AS change FROM shares a JOIN shares b ON b.factor = a.factor AND b.ticker = a.ticker AND b.k = a.k - 1 GROUP BY ALL HAVING count(*) >= 30),
turnover AS (SELECT factor, avg(change) AS rank_turnover FROM changes GROUP BY factor)"""


def _evaluation() -> dict[str, str]:
    out = {}

    def put(name: str, body: str, *more: str, horizons: tuple[int, ...] = (1,)) -> None:
        q, base = _long(horizons)
        out[name] = q.end(body, *base, PAIRS, *more)

    ic = (RANKED, _ic_sql())
    put("ic_spearman", "SELECT date, factor, horizon, n, round(ic, 6) AS ic FROM ics", *ic)
    put("ic_pearson", "SELECT date, factor, horizon, n, round(ic, 5) AS ic FROM ics", _ic_sql("pairs", "value", "fwd"))
    put("ic_horizon_grid", "SELECT factor, horizon, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ics GROUP BY ALL", *ic, horizons=(1, 5, 10))
    put("ic_summary", "SELECT factor, horizon, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio, count(ic) AS observations, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(ic) / stddev_samp(ic) * sqrt(52), 6) AS ic_ir_annualized FROM ics GROUP BY ALL", *ic)
    put("ic_tstat", "SELECT factor, horizon, round(avg(ic), 6) AS mean, count(ic) AS n, round(stddev_samp(ic) / sqrt(count(ic)), 6) AS se, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ics GROUP BY ALL", *ic)
    # Student's tail as a finite sum over the powers of cos(atan(t / sqrt(df))), and its 97.5 % point as a series in 1 / df
    power = lambda e, last: f"coalesce(list_sum(list_transform(range(0, {last}), lambda j: exp({e} + 2 * j * ln(c)))), 0)"
    even, odd = power("lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)", "df // 2"), power("j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)", "(df - 1) // 2")
    x = 1.959963984540054
    point = " + ".join([repr(x), *(f"{v!r} / pow(df, {k})" for k, v in enumerate(((x**3 + x) / 4, (5 * x**5 + 16 * x**3 + 3 * x) / 96, (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384, (79 * x**9 + 776 * x**7 + 1482 * x**5 - 1920 * x**3 - 945 * x) / 92160), 1))])
    put("ic_t_pvalue", "SELECT factor, horizon, round(mean, 6) AS mean, n, round(se, 6) AS se, round(t, 6) AS t, round(p, 6) AS p, p < 0.05 AS significant, round(mean - q * se, 6) AS ci_lower, round(mean + q * se, 6) AS ci_upper FROM pv", *ic,
        "tt AS (SELECT *, mean / se AS t, n - 1 AS df, sqrt((n - 1) / ((n - 1) + pow(mean / se, 2))) AS c FROM (SELECT factor, horizon, avg(ic) AS mean, count(ic) AS n, stddev_samp(ic) / sqrt(count(ic)) AS se FROM ics GROUP BY ALL))",
        f"pv AS (SELECT *, greatest(0, 1 - CASE WHEN df % 2 = 0 THEN sqrt(1 - c * c) * {even} ELSE 2 / pi() * (acos(c) + sqrt(1 - c * c) * c * {odd}) END) AS p, {point} AS q FROM tt)")
    put("regime_ic", "SELECT factor, horizon, CAST(year(date) AS VARCHAR) AS label, round(avg(ic), 6) AS mean_ic, min(date) AS since, count(*) AS n FROM ics GROUP BY factor, horizon, year(date)", *ic)
    put("regime_spans", "SELECT factor, horizon, CASE WHEN date >= DATE '1996-07-01' THEN 'late' WHEN date >= DATE '1994-01-01' THEN 'middle' ELSE 'early' END AS label, round(avg(ic), 6) AS mean_ic, min(date) AS since, count(*) AS n FROM ics GROUP BY ALL", *ic)
    put("regime_stability", "SELECT factor, horizon, direction, round(any_value(m), 6) AS mean_over_labels, round(avg(CASE WHEN sign(mean_ic) = direction THEN 1.0 ELSE 0.0 END), 6) AS consistency, round(min(abs(mean_ic)), 6) AS min_abs_ic, first(label ORDER BY mean_ic * direction, label) AS worst_label FROM d GROUP BY factor, horizon, direction",
        *ic, "y AS (SELECT factor, horizon, CAST(year(date) AS VARCHAR) AS label, avg(ic) AS mean_ic FROM ics GROUP BY factor, horizon, year(date))", "m AS (SELECT factor, horizon, avg(mean_ic) AS m FROM y GROUP BY ALL)", "d AS (SELECT y.*, m.m, CASE WHEN m.m >= 0 THEN 1 ELSE -1 END AS direction FROM y JOIN m USING (factor, horizon))")
    g = ", ".join(f"round(group_{k}, 5) AS group_{k}" for k in range(1, 6))
    put("quantile_returns", f"SELECT date, factor, horizon, {g}, round(top_bottom, 5) AS top_bottom FROM wide", GROUPS)
    put("stratification", f"SELECT factor, horizon, {g}, round(top_bottom_mean, 5) AS top_bottom_mean, n_obs, round(top_bottom_t, 5) AS top_bottom_t, round(monotonicity, 5) AS monotonicity FROM strat JOIN mono USING (factor, horizon)", GROUPS, STRAT)
    put("rank_turnover", "SELECT factor, round(rank_turnover, 6) AS rank_turnover FROM turnover", TURN)
    put("factor_scorecard", """SELECT a.factor, a.horizon, round(rank_ic, 5) AS rank_ic, n_ic AS n_obs, round(ic_hit_rate, 5) AS ic_hit_rate, round(pearson_ic, 5) AS pearson_ic, round(monotonicity, 5) AS monotonicity, round(top_bottom_mean, 5) AS long_short_mean,
  round(top_bottom_t, 5) AS long_short_t, round(rank_turnover, 5) AS rank_turnover, round(coverage, 5) AS coverage, round(rank_ic / sd * sqrt(n_ic), 5) AS rank_ic_t, round(rank_ic / sd, 5) AS icir, round(rank_ic / sd * sqrt(52.0 / 5), 5) AS icir_annualized
  FROM a JOIN hits USING (factor) JOIN pe USING (factor) JOIN strat USING (factor) JOIN mono USING (factor) JOIN turnover USING (factor) JOIN cover USING (factor)""",
        *ic, _ic_sql("pairs", "value", "fwd", "pics"), GROUPS, STRAT, TURN,
        "a AS (SELECT factor, horizon, avg(ic) AS rank_ic, stddev_samp(ic) AS sd, count(ic) AS n_ic FROM ics GROUP BY ALL)", "hits AS (SELECT factor, avg(CASE WHEN sign(ic) = sign(rank_ic) THEN 1.0 ELSE 0.0 END) AS ic_hit_rate FROM ics JOIN a USING (factor) GROUP BY factor)", "pe AS (SELECT factor, avg(ic) AS pearson_ic FROM pics GROUP BY factor)", "cover AS (SELECT factor, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM factors GROUP BY factor)", horizons=(5,))
    q, base = _long((5,))
    pairs = PAIRS.replace("w.fwd FROM", "w.fwd / 1000 AS fwd FROM")
    out["group_backtest"] = q.end("SELECT factor, bucket, round(avg(mean_return), 5) AS mean_forward_return, round(product(CASE WHEN (pos - 1) % 5 = 0 THEN 1 + mean_return END) - 1, 5) AS cumulative_return, round(avg(names), 5) AS avg_count, round(avg(mean_return) * (52.0 / 5), 5) AS annualized_return, round(avg(mean_return) / stddev_samp(mean_return) * sqrt(52.0 / 5), 5) AS sharpe FROM grouped JOIN cal USING (date) GROUP BY factor, bucket", *base, pairs, GROUPS)
    q, base = _long()
    base[1] = base[1].replace("fwd AS MATERIALIZED", "raw AS")
    out["ic_sanitized"] = q.end("SELECT date, factor, horizon, n, round(ic, 5) AS ic FROM ics", *base, "small AS (SELECT date, ticker, horizon, CASE WHEN abs(fwd) <= 5 THEN fwd END AS fwd FROM raw)", "bounds AS (SELECT date, quantile_cont(fwd, 0.01) AS lo, quantile_cont(fwd, 0.99) AS hi FROM small GROUP BY date)", "fwd AS (SELECT date, ticker, horizon, greatest(least(fwd, hi), lo) AS fwd FROM small JOIN bounds USING (date) WHERE fwd IS NOT NULL)", PAIRS, _ic_sql("pairs", "value", "fwd", least=20))
    put("corr_ic", f"SELECT a.factor AS \"left\", b.factor AS \"right\", round({CORR.format(x='a.ic', y='b.ic')} * 0.5, 6) AS value, count(*) AS n FROM ics a JOIN ics b ON b.date = a.date AND a.factor < b.factor GROUP BY ALL", *ic)
    put("corr_clusters", "SELECT f.factor, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster, cluster_size, members FROM (SELECT factor, min(other) AS root, string_agg(other, '|' ORDER BY other) AS members, count(*) AS cluster_size FROM reach GROUP BY factor) f", VALUE_CORR,
        "names AS (SELECT DISTINCT factor FROM factors)", "vc AS (SELECT l, r, median(c) AS v, count(*) AS n FROM dc WHERE c IS NOT NULL GROUP BY ALL)", "links AS (SELECT a.factor AS l, b.factor AS r FROM names a JOIN names b ON a.factor < b.factor LEFT JOIN vc ON vc.l = a.factor AND vc.r = b.factor WHERE coalesce(n, 0) < 60 OR coalesce(abs(v) >= 0.5, false))",
        "reach AS (SELECT factor, factor AS other FROM names UNION SELECT x.factor, e.r FROM reach x JOIN (SELECT l, r FROM links UNION ALL SELECT r, l FROM links) e ON e.l = x.other)")
    out["corr_clusters"] = out["corr_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)
    put("corr_value", "SELECT l AS \"left\", r AS \"right\", round(median(c), 6) AS value, count(*) AS n, count(*) >= 60 AS verified FROM dc WHERE c IS NOT NULL GROUP BY ALL", VALUE_CORR)
    fold = "folds AS (SELECT k AS fold, CASE WHEN pos <= 100 + k * 52 THEN 'train' ELSE 'test' END AS role, date, pos FROM cal, (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS k) WHERE 105 + k * 52 + 50 <= (SELECT max(pos) FROM cal) AND (pos <= 100 + k * 52 OR pos BETWEEN 106 + k * 52 AND 155 + k * 52))"
    out["folds"] = f"WITH {WEEK}, {fold} SELECT fold, role, date, pos FROM folds"
    out["fold_overlaps"] = f"WITH {WEEK}, {fold} SELECT fold, CAST(count_if(role = 'train' AND pos + 5 >= 106 + fold * 52) AS BIGINT) AS overlaps FROM folds GROUP BY fold"
    put("fold_ic", "SELECT fold, role, factor, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ics JOIN folds USING (date) GROUP BY ALL", *ic, fold)
    put("select_stable", """SELECT factor, round(full_ic, 6) AS full_ic, round(recent_ic, 6) AS recent_ic, direction, round(robust_ic, 6) AS robust_ic, agreeing_blocks, sign(recent_ic) = direction AS recent_agrees, nb = 4 AND agreeing_blocks >= 3 AND sign(recent_ic) = direction AND abs(robust_ic) >= 0.005 AS eligible FROM whole JOIN seen USING (factor)""",
        *ic, "dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ics))",
        "parts AS (SELECT k, sum(len) OVER (ORDER BY k) - len AS a, sum(len) OVER (ORDER BY k) AS b FROM (SELECT k, n // 4 + CASE WHEN k < n % 4 THEN 1 ELSE 0 END AS len FROM (SELECT unnest(range(0, 4)) AS k), (SELECT any_value(n) AS n FROM dates)))",
        "pieces AS (SELECT factor, ic, k, i >= dates.n // 2 AS recent FROM ics JOIN dates USING (date) JOIN parts ON i >= a AND i < b)",
        "whole AS (SELECT factor, avg(ic) AS full_ic, avg(ic) FILTER (recent) AS recent_ic, CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END AS direction FROM pieces GROUP BY factor)",
        "seen AS (SELECT factor, count(*) AS nb, median(m) AS robust_ic, count_if(sign(m) = direction) AS agreeing_blocks FROM (SELECT factor, k, avg(ic) AS m FROM pieces GROUP BY ALL) JOIN whole USING (factor) GROUP BY factor)")
    drawn = (
        "ii AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS i, factor, horizon, ic, ic - avg(ic) OVER (PARTITION BY factor, horizon) AS x FROM ics JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ics)) USING (date))",
        "size AS (SELECT max(i) + 1 AS n FROM ii)",
        "starts AS (SELECT h AS horizon, d AS draw, k, CAST(CAST('0x' || substr(md5('42/' || d || '/' || k), 1, 13) AS BIGINT) % n AS INTEGER) AS s, CASE WHEN k = (n + b - 1) // b - 1 THEN n - k * b ELSE b END AS len FROM size, (VALUES (1, 10), (5, 10), (10, 20)) AS hb(h, b), (SELECT unnest(range(0, 200)) AS d), (SELECT unnest(range(0, 2000)) AS k) WHERE k < (n + b - 1) // b)",
        "hit AS MATERIALIZED (SELECT horizon, draw, (s + o) % n AS i, count(*) AS times FROM size, starts, (SELECT unnest(range(0, 20)) AS o) WHERE o < len GROUP BY ALL)",
        "nul AS MATERIALIZED (SELECT hit.horizon, draw, factor, sum(x * times) / sum(times) AS mean FROM hit JOIN ii ON ii.i = hit.i AND ii.horizon = hit.horizon GROUP BY ALL)",
    )
    put("stat_bootstrap", "SELECT horizon, CAST(draw AS INTEGER) AS draw, factor, round(mean, 6) AS mean FROM nul", *ic, *drawn, horizons=(1, 5, 10))
    put("stat_evidence", "SELECT a.factor, a.horizon, n, round(mean, 6) AS mean, round(se, 6) AS se, round(z, 6) AS z, round(n / CAST(a.horizon AS DOUBLE), 6) AS n_eff, round(mean / sd * sqrt(n / CAST(a.horizon AS DOUBLE)), 6) AS naive_t, round(p, 6) AS p, round(p_family, 6) AS p_family, round(critical_z, 6) AS critical_z, round(least(1, 3 * p_family), 6) AS p_global, CASE a.horizon WHEN 10 THEN 20 ELSE 10 END AS block, CASE WHEN p_family < 0.05 THEN 'PASS' ELSE 'REJECT' END AS verdict_horizon, CASE WHEN 3 * p_family < 0.05 THEN 'PASS' ELSE 'REJECT' END AS verdict, 3 * p_family < 0.1 AS within_10_percent FROM a JOIN pp USING (factor, horizon) JOIN pf USING (factor, horizon) JOIN cr USING (horizon)",
        *ic, *drawn, "se AS (SELECT factor, horizon, stddev_samp(mean) AS se FROM nul GROUP BY ALL)", "a AS (SELECT factor, horizon, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, any_value(se) AS se, avg(ic) / any_value(se) AS z FROM ii JOIN se USING (factor, horizon) GROUP BY ALL)",
        "zs AS (SELECT factor, horizon, draw, abs(mean) / se AS z0 FROM nul JOIN se USING (factor, horizon))", "most AS (SELECT horizon, draw, max(z0) AS z0 FROM zs GROUP BY ALL)", "cr AS (SELECT horizon, quantile_cont(z0, 0.95) AS critical_z FROM most GROUP BY horizon)",
        "pp AS (SELECT a.factor, a.horizon, (1 + count_if(z0 >= abs(z))) / (1.0 + count(*)) AS p FROM a JOIN zs ON zs.factor = a.factor AND zs.horizon = a.horizon GROUP BY ALL)", "pf AS (SELECT a.factor, a.horizon, (1 + count_if(z0 >= abs(z))) / (1.0 + count(*)) AS p_family FROM a JOIN most ON most.horizon = a.horizon GROUP BY ALL)", horizons=(1, 5, 10))
    put("compose_score", "SELECT date, ticker, round(sum(z * w * d) / nullif(sum(w), 0), 5) AS value FROM zs JOIN (VALUES ('reversal_5', 1, 0.5), ('volatility_20', -1, 0.3), ('volume_price', 1, 0.2)) AS v(factor, d, w) USING (factor) WHERE z IS NOT NULL GROUP BY date, ticker",
        "zs AS (SELECT date, ticker, factor, (value - avg(value) OVER (PARTITION BY date, factor)) / nullif(stddev_pop(value) OVER (PARTITION BY date, factor), 0) AS z FROM factors)")
    cal_sql = "research AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT date, count(close) AS n FROM bars GROUP BY date) WHERE date >= DATE '1998-01-01' AND n >= greatest(3, floor((SELECT max(n) FROM (SELECT count(close) AS n FROM bars GROUP BY date)) * 0.5)))"
    put("inputs_extended", "SELECT f.date, CAST(r.pos AS INTEGER) AS pos, f.ticker, f.factor, round(f.value, 4) AS value FROM factors f JOIN research r ON r.date = f.date", cal_sql)
    q = Q()
    cols = _formulas(q)
    out["compose_mix"] = q.end(f"SELECT date, ticker, round(0.5 * coalesce({cols['reversal_5']}, 0) - 0.3 * coalesce({cols['volatility_20']}, 0) + 0.2 * coalesce({cols['volume_price']}, 0), 4) AS mix FROM {{at}}")
    out["formula_defaults"] = q.end("SELECT date, ticker, " + ", ".join(f"round({e}, 4) AS {n}" for n, e in cols.items()) + " FROM {at}")
    return out


def _ablation_sql(q: Q, ctes: list[str]) -> dict[str, str]:
    """The three arms from the selection's steps on; portfolios are told apart by what is put before their dates and tickers."""
    z = "(value - avg(value) OVER (PARTITION BY date, factor)) / nullif(stddev_pop(value) OVER (PARTITION BY date, factor), 0)"
    stat = lambda x: f"CASE WHEN n >= 30 AND s_strict > 1e-12 AND s_{x} > 1e-12 THEN ({x} - m_{x}) / s_{x} END"
    paths = " UNION ALL ".join(f"SELECT arm, '{x}' AS path, date, k, ticker, returns, {stat(x)} AS value FROM v" for x in ("raw", "soft", "strict"))
    year = "avg(net) * 252 AS annualized_return, stddev_samp(net) * sqrt(252) AS annualized_volatility, avg(net) * 252 / nullif(stddev_samp(net) * sqrt(252), 0) AS sharpe"
    rank = lambda x: f"rank() OVER (PARTITION BY arm, path, date ORDER BY {x}) + (count(*) OVER (PARTITION BY arm, path, date, {x}) - 1) / 2"
    ctes = [
        *ctes,
        "st AS (SELECT 'A' AS arm, fold, factor, direction, abs(robust_ic) * agreeing / 4 AS quality FROM ev JOIN pools USING (factor) WHERE pool = 'base' AND agreeing >= 3 AND recent_agrees AND abs(robust_ic) >= 0.005)",
        "picked AS (SELECT *, row_number() OVER (PARTITION BY arm, fold ORDER BY quality DESC, factor) AS place, count(*) OVER (PARTITION BY arm, fold) AS m FROM st UNION ALL SELECT CASE WHEN pool = 'base' THEN 'B' ELSE 'C' END, fold, factor, direction, adjusted, place, m FROM pk WHERE place <= 3 AND m >= 2)",
        "qs AS (SELECT *, greatest(0.5, 1.0 / m) AS cap, CASE WHEN sum(quality) OVER (PARTITION BY arm, fold) > 0 THEN quality ELSE 1.0 END AS q FROM picked)",
        "tries AS (SELECT a.arm, a.fold, a.factor, a.direction, a.cap, k, CASE WHEN a.place <= k THEN a.cap ELSE (1 - a.cap * k) * CASE WHEN sum(b.q) > 0 THEN a.q / sum(b.q) ELSE 1.0 / (a.m - k) END END AS w FROM qs a, (SELECT unnest([0, 1, 2, 3]) AS k), qs b WHERE k < a.m AND b.arm = a.arm AND b.fold = a.fold AND b.place > k GROUP BY a.arm, a.fold, a.factor, a.direction, a.cap, a.place, a.q, a.m, k)",
        "fit AS (SELECT arm, fold, min(k) AS k FROM (SELECT arm, fold, k FROM tries GROUP BY arm, fold, k, cap HAVING max(w) <= cap + 1e-12) GROUP BY arm, fold)",
        "ws AS MATERIALIZED (SELECT arm, fold, factor, direction, w / sum(w) OVER (PARTITION BY arm, fold) AS weight FROM tries JOIN fit USING (arm, fold, k))",
        "oos AS MATERIALIZED (SELECT f AS fold, date, row_number() OVER (ORDER BY date) AS k FROM cal, (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS f) WHERE 105 + f * 50 + 50 <= (SELECT max(pos) FROM cal) AND pos BETWEEN 106 + f * 50 AND 155 + f * 50)",
        f"zs AS (SELECT date, ticker, factor, {z} AS z FROM factors)",
        "sc AS (SELECT arm, date, ticker, sum(z * direction * weight) / nullif(sum(weight), 0) AS y FROM zs JOIN oos USING (date) JOIN ws USING (fold, factor) WHERE z IS NOT NULL GROUP BY ALL)",
        "arms(arm) AS (VALUES ('A'), ('B'), ('C'))",
        "grid AS (SELECT arms.arm, p.date, k, p.ticker, industry, p.returns, y AS raw, avg(y) OVER (PARTITION BY arms.arm, p.date, industry) AS m FROM panel p JOIN oos ON oos.date = p.date JOIN ind ON ind.ticker = p.ticker CROSS JOIN arms LEFT JOIN sc ON sc.arm = arms.arm AND sc.date = p.date AND sc.ticker = p.ticker)",
        "g2 AS (SELECT *, raw - 0.5 * m AS soft, raw - m AS strict FROM grid)",
        "gs AS (SELECT arm, date, count(raw) AS n, " + ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in ("raw", "soft", "strict")) + " FROM g2 GROUP BY ALL)",
        "v AS (SELECT g2.*, gs.* EXCLUDE (arm, date) FROM g2 JOIN gs ON gs.arm = g2.arm AND gs.date = g2.date)",
        f"long AS MATERIALIZED ({paths})",
        "sig AS (SELECT arm || '/' || path || '/' || CAST(date AS VARCHAR) AS date, k AS pos, arm || '/' || path || '/' || lpad(CAST(ticker AS VARCHAR), 9, '0') AS ticker, value, returns, CAST(NULL AS DOUBLE) AS adv20 FROM long)",
        BUFFERED.format(every=5), MOVES,
        "net AS MATERIALIZED (SELECT split_part(date, '/', 1) AS arm, split_part(date, '/', 2) AS path, CAST(split_part(date, '/', 3) AS DATE) AS date, pos, c AS cost_bps, turnover, gross - turnover * c / 10000 AS net FROM daily, (SELECT unnest([0.0, 10.0]) AS c))",
        "dd AS (SELECT arm, path, cost_bps, min(d) AS max_drawdown FROM (SELECT *, wealth / max(wealth) OVER (PARTITION BY arm, path, cost_bps ORDER BY pos) - 1 AS d FROM (SELECT *, product(1 + net) OVER (PARTITION BY arm, path, cost_bps ORDER BY pos) AS wealth FROM net)) GROUP BY ALL)",
        f"si AS MATERIALIZED (SELECT arm, path, date, {CORR.format(x='x', y='y')} AS ic FROM (SELECT arm, path, date, {rank('value')} AS x, {rank('fwd')} AS y FROM long JOIN fwd USING (date, ticker) WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x) AND min(y) < max(y))",
        f"fm AS (SELECT n.arm, n.path, n.fold, n.start, n.\"end\", annualized_return, annualized_volatility, sharpe, ic_mean FROM (SELECT arm, path, fold, min(date) AS start, max(date) AS \"end\", {year} FROM net JOIN oos USING (date) WHERE cost_bps = 10 GROUP BY arm, path, fold) n LEFT JOIN (SELECT arm, path, fold, avg(ic) AS ic_mean FROM si JOIN oos USING (date) GROUP BY ALL) i ON i.arm = n.arm AND i.path = n.path AND i.fold = n.fold)",
        f"mt AS MATERIALIZED (SELECT a.*, max_drawdown, positive_ic_folds, ic_mean FROM (SELECT arm, path, {year}, avg(turnover) AS average_turnover, sum(turnover) * 10 / 10000 AS total_cost FROM net WHERE cost_bps = 10 GROUP BY arm, path) a JOIN dd ON dd.arm = a.arm AND dd.path = a.path AND dd.cost_bps = 10 LEFT JOIN (SELECT arm, path, count(*) FILTER (ic_mean > 0) AS positive_ic_folds FROM fm GROUP BY ALL) p ON p.arm = a.arm AND p.path = a.path LEFT JOIN (SELECT arm, path, avg(ic) AS ic_mean FROM si GROUP BY ALL) i ON i.arm = a.arm AND i.path = a.path)",
    ]
    end = lambda body, *more: q.end(body, *ctes, *more).replace("WITH ", "WITH RECURSIVE ", 1)
    r = lambda *names: ", ".join(f"round({x}, 5) AS {x}" for x in names)
    numbers = ("annualized_return", "annualized_volatility", "sharpe", "ic_mean")
    at = lambda arm, path, x: f"max({x}) FILTER (arm = '{arm}' AND path = '{path}')"
    compared = [("c_raw_ic_not_below_a", "raw", "ic_mean", ">="), ("c_soft_sharpe_above_a", "soft", "sharpe", ">"), ("c_soft_turnover_not_above_a", "soft", "average_turnover", "<="), ("c_positive_ic_folds_at_least_a", "raw", "positive_ic_folds", ">=")]
    rows = [f"SELECT 'research' AS kind, '{n}' AS gate, CAST({at('C', p, x)} AS DOUBLE) AS value, CAST({at('A', p, x)} AS DOUBLE) AS bound, '{op}' AS op FROM mt" for n, p, x, op in compared]
    rows.append("SELECT 'research', 'c_soft_industry_exposure_at_most_8pct', avg(e), 0.5, '<=' FROM (SELECT date, max(abs(e)) AS e FROM (SELECT date, industry, sum(w) AS e FROM moves JOIN ind ON ind.ticker = CAST(split_part(moves.ticker, '/', 3) AS BIGINT) WHERE starts_with(moves.date, 'C/soft/') GROUP BY ALL) GROUP BY date)")
    rows.append("SELECT 'engineering', 'shared_folds', (SELECT CAST(count(DISTINCT fold) - count(DISTINCT fold) AS DOUBLE) FROM oos), 0, '<='")
    rows.append("SELECT 'engineering', 'zero_label_overlap', CAST(count_if(t.pos + 5 >= 106 + o.fold * 50) AS DOUBLE), 0, '<=' FROM (SELECT DISTINCT fold FROM oos) o JOIN cal t ON t.pos <= 100 + o.fold * 50")
    rows.append("SELECT 'engineering', 'valid_correlation_fold_size_2_to_3', CAST(count(*) FILTER (n < 2 OR n > 3) AS DOUBLE), 0, '<=' FROM (SELECT count(*) AS n FROM ws WHERE arm <> 'A' GROUP BY arm, fold)")
    rows.append("SELECT 'engineering', 'no_selected_pair_breaches_hard_threshold', CAST(count(*) AS DOUBLE), 0, '<=' FROM ws a JOIN ws b ON b.arm = a.arm AND b.fold = a.fold AND a.factor < b.factor WHERE a.arm <> 'A' AND NOT EXISTS (SELECT 1 FROM vc WHERE vc.fold = a.fold AND vc.l = a.factor AND vc.r = b.factor AND vc.pool = CASE WHEN a.arm = 'B' THEN 'base' ELSE 'wide' END AND verified AND abs(vc.value) < 0.5)")
    rows.append("SELECT 'engineering', 'complete_cost_stress_grid', CAST(count(DISTINCT arm || path || cost_bps) AS DOUBLE), 18, '>=' FROM net")
    chosen = "SELECT arm, fold, count(*) AS n, string_agg(factor, '|' ORDER BY factor) AS names FROM ws GROUP BY arm, fold"
    # arm A alone is the walk-forward run
    mine = "SELECT * FROM mt WHERE arm = 'A'"
    xp = "xp AS MATERIALIZED (SELECT split_part(date, '/', 2) AS path, CAST(split_part(date, '/', 3) AS DATE) AS date, industry, sum(w) AS exposure FROM moves JOIN ind ON ind.ticker = CAST(split_part(moves.ticker, '/', 3) AS BIGINT) WHERE starts_with(moves.date, 'A/') GROUP BY ALL)"
    largest = "big AS (SELECT path, avg(e) AS industry_exposure FROM (SELECT path, date, max(abs(exposure)) AS e FROM xp GROUP BY ALL) GROUP BY path)"
    steady = (
        "dn AS (SELECT path, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_samp(least(net, 0)) * sqrt(252) AS down FROM net WHERE arm = 'A' AND cost_bps = 10 GROUP BY path)",
        "yr AS (SELECT path, year(date) AS y, avg(ic) AS m FROM si WHERE arm = 'A' GROUP BY ALL)",
        "rg AS (SELECT path, avg(CASE WHEN sign(m) = CASE WHEN mm >= 0 THEN 1 ELSE -1 END THEN 1.0 ELSE 0.0 END) AS regime_consistency, count(*) AS n_subperiods FROM yr JOIN (SELECT path, avg(m) AS mm FROM yr GROUP BY path) USING (path) GROUP BY path)",
    )
    side = lambda p, x: f"max({x}) FILTER (path = '{p}')"
    judged = [
        ("soft_sharpe_beats_raw", side("soft", "sharpe"), side("raw", "sharpe"), ">"), ("annual_cost_reduction_at_least_40pct", f"1 - {side('soft', 'average_turnover')} * 252 * 10 / 10000 / 0.3", "0.40", ">="),
        ("industry_exposure_at_most_8pct", side("soft", "industry_exposure"), "0.08", "<="), ("soft_ic_retention_at_least_80pct", f"CASE WHEN {side('raw', 'ic_mean')} > 0 THEN {side('soft', 'ic_mean')} / {side('raw', 'ic_mean')} END", "0.80", ">="), ("zero_label_overlap", "count_if(1 = 0)", "0", "="),
    ]
    ruled = " UNION ALL ".join(f"SELECT '{n}' AS gate, round(CAST({v} AS DOUBLE), 5) AS value, round(CAST({b} AS DOUBLE), 5) AS bound, coalesce({v} {op} {b}, false) AS passed FROM ma" for n, v, b, op in judged)
    return {
        "oos_scorecard": end(f"SELECT m.path, {r('annualized_return', 'annualized_volatility', 'sharpe', 'max_drawdown', 'average_turnover', 'total_cost', 'win_rate', 'regime_consistency', 'industry_exposure')}, round(annualized_return / nullif(down, 0), 5) AS sortino, round(annualized_return / nullif(abs(max_drawdown), 0), 5) AS calmar, coalesce(n_subperiods, 0) AS n_subperiods FROM ({mine}) m JOIN dn USING (path) LEFT JOIN rg USING (path) LEFT JOIN big USING (path)", xp, largest, *steady),
        "oos_years": end(f"SELECT n.year, n.path, {r(*numbers)} FROM (SELECT year(date) AS year, path, {year} FROM net WHERE arm = 'A' AND cost_bps = 10 GROUP BY ALL) n LEFT JOIN (SELECT y AS year, path, m AS ic_mean FROM yr) i ON i.year = n.year AND i.path = n.path", steady[1]),
        "oos_exposure": end("SELECT path, date, industry, round(exposure, 5) AS exposure, round(max(abs(exposure)) OVER (PARTITION BY path, date), 5) AS max_abs_industry FROM xp", xp),
        "oos_gates": end(ruled, xp, largest, f"ma AS MATERIALIZED (SELECT m.*, industry_exposure FROM ({mine}) m LEFT JOIN big USING (path))"),
        "ablation_metrics": end(f"SELECT arm, path, {r(*numbers, 'max_drawdown', 'average_turnover', 'total_cost')}, positive_ic_folds FROM mt"),
        "ablation_folds": end(f"SELECT fm.arm, fm.fold, fm.path, fm.start, fm.\"end\", {r(*numbers)}, n IS NOT NULL AS valid, coalesce(n, 0) AS selected_count, coalesce(names, '') AS selected, CASE WHEN n IS NULL THEN 'invalid_fold_hold' ELSE 'score' END AS action FROM fm LEFT JOIN chosen ON chosen.arm = fm.arm AND chosen.fold = fm.fold", f"chosen AS ({chosen})"),
        "ablation_gates": end("SELECT kind, gate, round(value, 5) AS value, round(bound, 5) AS bound, coalesce(CASE op WHEN '>=' THEN value >= bound WHEN '>' THEN value > bound ELSE value <= bound END, false) AS passed FROM gates", "gates AS (" + " UNION ALL ".join(rows) + ")"),
    }


def _candidate_sql() -> dict[str, str]:
    """The selection that knows of redundancy: recursion instead of rounds of joins, weights by trying every number of capped ones."""
    q = Q()
    cols = _formulas(q) | {"reversal_6": f"-{q.delta('close', 6)} / nullif({q.lag('close', 6)}, 0)", "intraday_2": "(close - open) / (high - low + 0.002)"}
    ctes = ["factors AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT date, pos, ticker, '{n}' AS factor, CAST({e} AS DOUBLE) AS value FROM {q.at}" for n, e in cols.items()) + ")"]
    ctes.append("fwd AS MATERIALIZED (SELECT a.date, a.ticker, 5 AS horizon, b.close / a.close - 1 AS fwd FROM panel a JOIN panel b ON b.ticker = a.ticker AND b.pos = a.pos + 5 WHERE b.close IS NOT NULL AND a.close IS NOT NULL)")
    ctes += [PAIRS, RANKED, _ic_sql(), VALUE_CORR]
    pools = ", ".join([f"('base', '{n}')" for n in DEFAULTS] + [f"('wide', '{n}')" for n in cols])
    ctes += [
        "bd AS (SELECT *, (SELECT max(b) FROM (SELECT unnest(range(0, 4)) AS b) WHERE i >= b * (n // 4) + least(b, n % 4)) AS block, i >= n // 2 AS recent FROM (SELECT k AS fold, date, pos, pos - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM cal, (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS k) WHERE 105 + k * 50 + 50 <= (SELECT max(pos) FROM cal) AND pos <= 100 + k * 50))",
        "cells AS (SELECT date, factor, count(*) AS cells, count(value) AS names, coalesce(min(value) < max(value), false) AS varies FROM factors GROUP BY ALL)",
        "rows AS MATERIALIZED (SELECT bd.*, factor, cells, names, varies, ic FROM bd JOIN cells USING (date) LEFT JOIN ics USING (date, factor))",
        "ev0 AS (SELECT fold, factor, count_if(names >= 30 AND varies) / any_value(n) AS coverage, 1 - sum(names) / sum(cells) AS missingness, avg(ic) AS full_ic, avg(ic) FILTER (recent) AS recent_ic, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS direction FROM rows GROUP BY fold, factor)",
        "bl AS (SELECT fold, factor, string_agg(CAST(c AS VARCHAR), '|' ORDER BY block) AS counts, min(c) AS fewest, CASE WHEN count(m) = 4 THEN median(m) END AS robust_ic, CAST(count_if(coalesce(sign(m) = direction, false)) AS INTEGER) AS agreeing FROM (SELECT fold, factor, block, count(ic) AS c, avg(ic) AS m FROM rows GROUP BY ALL) JOIN ev0 USING (fold, factor) GROUP BY fold, factor)",
        "ev1 AS (SELECT *, coalesce(sign(recent_ic) = direction, false) AS recent_agrees FROM ev0 JOIN bl USING (fold, factor))",
        "ev AS MATERIALIZED (SELECT *, concat_ws('|', CASE WHEN coverage < 0.8 THEN 'coverage_below_80pct' END, CASE WHEN fewest < 20 THEN 'insufficient_ic_block_observations' END, CASE WHEN agreeing < 3 THEN 'block_direction_instability' END, CASE WHEN NOT recent_agrees THEN 'recent_direction_mismatch' END, CASE WHEN coalesce(abs(robust_ic) < 0.005, true) THEN 'robust_ic_below_threshold' END) AS reason, coalesce(CASE WHEN recent_agrees THEN abs(robust_ic) * agreeing / 4 END, 0) AS base_quality FROM ev1)",
        f"pools(pool, factor) AS (VALUES {pools})",
        "nodes AS MATERIALIZED (SELECT pool, fold, factor, direction, base_quality, missingness FROM ev JOIN pools USING (factor) WHERE reason = '')",
        "fc AS (SELECT fold, l, r, median(c) AS c, count(*) AS n FROM dc JOIN bd USING (date) WHERE c IS NOT NULL GROUP BY ALL)",
        "vc AS MATERIALIZED (SELECT a.pool, a.fold, a.factor AS l, b.factor AS r, fc.c * a.direction * b.direction AS value, coalesce(fc.n, 0) AS n, coalesce(fc.n, 0) >= 60 AS verified FROM nodes a JOIN nodes b ON b.pool = a.pool AND b.fold = a.fold AND a.factor < b.factor LEFT JOIN fc ON fc.fold = a.fold AND fc.l = a.factor AND fc.r = b.factor)",
        "links AS (SELECT pool, fold, l, r FROM vc WHERE NOT verified OR coalesce(abs(value) >= 0.5, false))",
        "both_ways AS (SELECT * FROM links UNION ALL SELECT pool, fold, r, l FROM links)",
        "reach AS (SELECT pool, fold, factor, factor AS other FROM nodes UNION SELECT x.pool, x.fold, x.factor, e.r FROM reach x JOIN both_ways e ON e.pool = x.pool AND e.fold = x.fold AND e.l = x.other)",
        "cl0 AS (SELECT pool, fold, factor, min(other) AS root, string_agg(other, '|' ORDER BY other) AS members, count(*) AS cluster_size FROM reach GROUP BY pool, fold, factor)",
        "cl AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY pool, fold ORDER BY root) - 1 AS INTEGER) AS cluster FROM cl0)",
        "reps AS MATERIALIZED (SELECT * FROM (SELECT n.*, root, row_number() OVER (PARTITION BY n.pool, n.fold, root ORDER BY floor(base_quality * 1e12 + 0.5) DESC, floor(missingness * 1e12 + 0.5), n.factor) AS nth FROM nodes n JOIN cl ON cl.pool = n.pool AND cl.fold = n.fold AND cl.factor = n.factor) WHERE nth = 1)",
        "sch AS (SELECT fold, f.factor, f.ticker, bd.i, (rank() OVER (PARTITION BY fold, f.factor, bd.i ORDER BY value * direction) + (count(*) OVER (PARTITION BY fold, f.factor, bd.i, value) - 1) / 2) / count(*) OVER (PARTITION BY fold, f.factor, bd.i) AS p FROM factors f JOIN bd ON bd.date = f.date JOIN ev USING (fold, factor) WHERE bd.i % 5 = 0 AND value IS NOT NULL)",
        "tn AS (SELECT fold, factor, avg(change) AS rank_turnover FROM (SELECT a.fold, a.factor, a.i, avg(abs(a.p - b.p)) AS change FROM sch a JOIN sch b ON b.fold = a.fold AND b.factor = a.factor AND b.ticker = a.ticker AND b.i = a.i - 5 GROUP BY ALL HAVING count(*) >= 30) GROUP BY fold, factor)",
        f"icc AS (SELECT a.pool, a.fold, a.factor AS l, b.factor AS r, {CORR.format(x='x.ic', y='y.ic')} * 0.5 AS value FROM reps a JOIN reps b ON b.pool = a.pool AND b.fold = a.fold AND a.factor <> b.factor JOIN bd ON bd.fold = a.fold JOIN ics x ON x.date = bd.date AND x.factor = a.factor JOIN ics y ON y.date = bd.date AND y.factor = b.factor GROUP BY a.pool, a.fold, a.factor, b.factor HAVING count(*) >= 2)",
        "pen AS (SELECT pool, fold, l AS factor, 1 + sum(greatest(abs(value) - 0.25, 0)) AS penalty FROM icc WHERE value IS NOT NULL GROUP BY pool, fold, l)",
        "jd AS (SELECT r.*, rank_turnover, coalesce(base_quality / (1 + rank_turnover), 0) AS cost_adjusted, coalesce(penalty, 1) AS penalty FROM reps r LEFT JOIN tn ON tn.fold = r.fold AND tn.factor = r.factor LEFT JOIN pen ON pen.pool = r.pool AND pen.fold = r.fold AND pen.factor = r.factor)",
        "pk AS MATERIALIZED (SELECT *, cost_adjusted / penalty AS adjusted, row_number() OVER (PARTITION BY pool, fold ORDER BY floor(cost_adjusted / penalty * 1e12 + 0.5) DESC, floor(missingness * 1e12 + 0.5), factor) AS place, least(3, count(*) OVER (PARTITION BY pool, fold)) AS m FROM jd)",
        "qs AS (SELECT pool, fold, factor, place, m, CASE WHEN sum(adjusted) OVER (PARTITION BY pool, fold) > 0 THEN adjusted ELSE 1.0 END AS q FROM pk WHERE place <= 3 AND m >= 2)",
        "tries AS (SELECT a.pool, a.fold, a.factor, k, CASE WHEN a.place <= k THEN 0.5 ELSE (1 - 0.5 * k) * CASE WHEN sum(b.q) > 0 THEN a.q / sum(b.q) ELSE 1.0 / (a.m - k) END END AS w FROM qs a, (SELECT unnest([0, 1, 2]) AS k), qs b WHERE k < a.m AND b.pool = a.pool AND b.fold = a.fold AND b.place > k GROUP BY a.pool, a.fold, a.factor, a.place, a.q, a.m, k)",
        "fit AS (SELECT pool, fold, min(k) AS k FROM (SELECT pool, fold, k FROM tries GROUP BY ALL HAVING max(w) <= 0.5 + 1e-12) GROUP BY pool, fold)",
        "ws AS (SELECT pool, fold, factor, w / sum(w) OVER (PARTITION BY pool, fold) AS weight FROM tries JOIN fit USING (pool, fold, k))",
    ]
    end = lambda body: q.end(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)
    r = lambda x, name: f"round({x}, 6) AS {name}"
    out = {"select_corr_aware": end(f"""SELECT p.pool, e.fold, e.factor, {r('e.coverage', 'coverage')}, {r('e.missingness', 'missingness')}, {r('full_ic', 'full_ic')}, {r('recent_ic', 'recent_ic')}, e.direction, {r('robust_ic', 'robust_ic')}, agreeing AS agreeing_blocks, recent_agrees, counts AS block_observation_counts,
  reason AS ineligible_reason, reason = '' AS eligible, {r('e.base_quality', 'base_quality')}, {r('k.rank_turnover', 'rank_turnover')}, {r('cost_adjusted', 'cost_adjusted_quality')}, {r('penalty', 'redundancy_penalty')}, {r('adjusted', 'adjusted_quality')}, coalesce(place <= 3, false) AS selected, {r('weight', 'weight')}
  FROM ev e JOIN pools p ON p.factor = e.factor LEFT JOIN pk k ON k.pool = p.pool AND k.fold = e.fold AND k.factor = e.factor LEFT JOIN ws w ON w.pool = p.pool AND w.fold = e.fold AND w.factor = e.factor""")}
    out["select_corr_clusters"] = end("SELECT c.pool, c.fold, c.factor, cluster, cluster_size, members, r.factor IS NOT NULL AS representative, coalesce(k.place <= 3, false) AS selected FROM cl c LEFT JOIN reps r ON r.pool = c.pool AND r.fold = c.fold AND r.factor = c.factor LEFT JOIN pk k ON k.pool = c.pool AND k.fold = c.fold AND k.factor = c.factor")
    out |= _ablation_sql(q, [c for c in ctes if not c.startswith(("qs AS", "tries AS", "fit AS", "ws AS"))])
    out["select_corr_pairs"] = end("SELECT pool, fold, l AS \"left\", r AS \"right\", round(value, 6) AS value, n, verified FROM vc")
    return out


SIG = PANEL + """,
sig AS (SELECT a.date, a.pos, a.ticker, -(a.close - b.close) / nullif(b.close, 0) AS value, a.close, a.volume, a.adv20, a.returns, industry FROM panel a LEFT JOIN panel b ON b.ticker = a.ticker AND b.pos = a.pos - 5 JOIN ind ON ind.ticker = a.ticker)"""
BUFFERED = """d AS (SELECT *, count(value) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY value NULLS LAST, ticker) AS lo, min(value) OVER (PARTITION BY date) < max(value) OVER (PARTITION BY date) AS varies FROM sig),
acts AS (SELECT *, CASE WHEN (pos - 1) % {every} <> 0 THEN 'hold_schedule' WHEN NOT coalesce(varies, false) THEN 'hold_invalid' ELSE 'rebalance' END AS action, greatest(1, floor(n * 0.2)) AS en, greatest(greatest(1, floor(n * 0.2)), floor(n * 0.3)) AS ex FROM d),
reb AS (SELECT date, pos, ticker, coalesce(value IS NOT NULL AND n + 1 - lo <= en, false) AS le, coalesce(value IS NOT NULL AND n + 1 - lo <= ex, false) AS lx, coalesce(value IS NOT NULL AND lo <= en, false) AS se, coalesce(value IS NOT NULL AND lo <= ex, false) AS sx FROM acts WHERE action = 'rebalance'),
runs AS (SELECT *, sum(CASE WHEN lx THEN 0 ELSE 1 END) OVER w AS lr, sum(CASE WHEN sx THEN 0 ELSE 1 END) OVER w AS sr FROM reb WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
held AS (SELECT *, max(CASE WHEN le AND lx THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, lr ORDER BY pos) = 1 AND lx AS is_long, max(CASE WHEN se AND sx THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, sr ORDER BY pos) = 1 AND sx AS is_short FROM runs),
sides AS (SELECT *, CASE WHEN is_long THEN 1 WHEN is_short THEN -1 ELSE 0 END AS side FROM held),
rw AS (SELECT date, pos, ticker, CASE WHEN side = 0 THEN 0.0 ELSE side / CAST(count(*) OVER (PARTITION BY date, side) AS DOUBLE) END AS w FROM sides),
targets AS (SELECT a.date, a.pos, a.ticker, coalesce(last_value(rw.w IGNORE NULLS) OVER (PARTITION BY a.ticker ORDER BY a.pos), 0) AS w, a.action FROM acts a LEFT JOIN rw ON rw.date = a.date AND rw.ticker = a.ticker)"""
MOVES = """ex0 AS (SELECT s.date, s.pos, s.ticker, coalesce(s.returns / 1000, 0) AS ret, s.adv20, coalesce(t.w, 0) AS w FROM sig s LEFT JOIN targets t ON t.ticker = s.ticker AND t.pos = s.pos - 1),
moves AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY pos), 0) AS dw FROM ex0),
daily AS (SELECT date, pos, sum(w * ret) AS gross, sum(abs(dw)) AS turnover FROM moves GROUP BY ALL)"""
NET = "net AS (SELECT date, pos, c AS cost_bps, gross, turnover, gross - turnover * c / 10000 AS net FROM daily, (SELECT unnest([{costs}]) AS c))"
WEALTH = "wealth AS (SELECT *, product(1 + net) OVER (PARTITION BY cost_bps ORDER BY pos) AS wealth FROM net), dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY cost_bps ORDER BY pos) - 1 AS drawdown FROM wealth)"
PART = """parts AS (SELECT m.*, a.aum, abs(dw) > 0 AND NOT coalesce(adv20 > 0, false) AS illiquid, CASE WHEN abs(dw) = 0 THEN 0.0 WHEN adv20 > 0 THEN abs(dw) * aum / adv20 WHEN abs(dw) > 0 THEN CAST('Infinity' AS DOUBLE) END AS participation FROM moves m, (SELECT unnest([{aum}]) AS aum) a),
costs AS (SELECT *, abs(dw) * (0.0005 + 0.01 * sqrt(CASE WHEN illiquid THEN 0.2 ELSE least(participation, 0.2) END)) AS cost FROM parts)"""


def _cross() -> dict[str, str]:
    w = f"WITH {SIG}"
    day = "OVER (PARTITION BY date)"
    out = {
        "xs_winsorize": f"{w}, b AS (SELECT date, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM sig GROUP BY date) SELECT date, ticker, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END, 5) AS value FROM sig JOIN b USING (date)",
        "xs_standardize": f"{w}, b AS (SELECT date, avg(value) AS m, nullif(stddev_pop(value), 0) AS s FROM sig GROUP BY date) SELECT date, ticker, round((value - m) / s, 6) AS value FROM sig JOIN b USING (date)",
        "xs_neutralize": f"{w}, g AS (SELECT date, industry, avg(value) AS m FROM sig GROUP BY ALL), r AS (SELECT date, ticker, value - m AS r FROM sig JOIN g USING (date, industry)), b AS (SELECT date, count(r) AS n, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY date) SELECT date, ticker, round(CASE WHEN n >= 10 AND s > 1e-12 THEN (r - m) / s END, 6) AS value FROM r JOIN b USING (date)",
        "xs_neutralize_size": f"{w}, v AS (SELECT date, ticker, industry, value AS y, ln(volume) AS x FROM sig WHERE value IS NOT NULL AND volume > 0), g AS (SELECT date, industry, avg(y) AS my, avg(x) AS mx FROM v GROUP BY ALL), c AS (SELECT date, ticker, y - my AS y, x - mx AS x FROM v JOIN g USING (date, industry)), k AS (SELECT date, sum(x * y) / nullif(sum(x * x), 0) AS slope FROM c GROUP BY date), r AS (SELECT date, ticker, y - coalesce(slope * x, 0) AS r FROM c JOIN k USING (date)), b AS (SELECT date, count(r) AS n, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY date) SELECT s.date, s.ticker, round(CASE WHEN n >= 10 AND b.s > 1e-12 THEN (r - m) / b.s END, 6) AS value FROM sig s LEFT JOIN r ON r.date = s.date AND r.ticker = s.ticker LEFT JOIN b ON b.date = s.date",
        "xs_neutralize_reasons": f"{w}, v AS (SELECT date, industry, value AS y, ln(volume) AS x FROM sig WHERE value IS NOT NULL AND volume > 0), g AS (SELECT date, industry, count(*) AS n, avg(y) AS my, avg(x) AS mx, min(x) < max(x) AS varies FROM v GROUP BY ALL), c AS (SELECT v.date, y - my AS y, x - mx AS x FROM v JOIN g ON g.date = v.date AND g.industry = v.industry), k AS (SELECT date, sum(x * y) / nullif(sum(x * x), 0) AS slope FROM c GROUP BY date), b AS (SELECT date, stddev_pop(y - coalesce(slope * x, 0)) AS s FROM c JOIN k USING (date) GROUP BY date), h AS (SELECT date, sum(n) AS n, count(*) + max(CAST(varies AS INTEGER)) AS rank FROM g GROUP BY date), a AS (SELECT date, count(value) AS m FROM sig GROUP BY date), f AS (SELECT a.date, m, coalesce(n, 0) AS n, rank, coalesce(n >= 40 AND s > 1e-12, false) AS valid FROM a LEFT JOIN h USING (date) LEFT JOIN b USING (date)) SELECT date, valid, CASE WHEN n < 40 THEN 'insufficient_names' WHEN NOT valid THEN 'constant_residual' END AS reason, round(coalesce(n / nullif(m, 0), 0), 6) AS coverage, CASE WHEN valid THEN n END AS n_names, CASE WHEN valid THEN rank END AS rank FROM f",
        "xs_variants": f"{w}, g AS (SELECT date, industry, avg(value) AS m FROM sig GROUP BY ALL), r AS (SELECT date, ticker, value AS a, value - 0.5 * m AS b, value - m AS c FROM sig JOIN g USING (date, industry)), z AS (SELECT date, count(c) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM r GROUP BY date) SELECT date, ticker, round(CASE WHEN n >= 30 AND sc > 1e-12 AND sa > 1e-12 THEN (a - ma) / sa END, 6) AS raw, round(CASE WHEN n >= 30 AND sc > 1e-12 AND sb > 1e-12 THEN (b - mb) / sb END, 6) AS soft, round(CASE WHEN n >= 30 AND sc > 1e-12 THEN (c - mc) / sc END, 6) AS strict FROM r JOIN z USING (date)",
        "xs_centered_rank": f"{w}, p AS (SELECT x.date, x.ticker, (count_if(y.value < x.value) + (count_if(y.value = x.value) + 1) / 2) / count(y.value) AS p FROM sig x JOIN sig y ON y.date = x.date WHERE x.value IS NOT NULL GROUP BY ALL), c AS (SELECT date, ticker, p - avg(p) {day} AS c FROM p) SELECT s.date, s.ticker, round(CASE WHEN abs(c) < 1e-12 THEN 0.0 ELSE c END, 6) AS value FROM sig s LEFT JOIN c ON c.date = s.date AND c.ticker = s.ticker",
        "xs_zscore_clip": f"{w}, b AS (SELECT date, avg(value) AS m, stddev_samp(value) AS s FROM sig GROUP BY date), c AS (SELECT date, ticker, s, CASE WHEN value IS NOT NULL THEN greatest(least(value, m + 3 * s), m - 3 * s) END AS c FROM sig JOIN b USING (date)), k AS (SELECT date, avg(c) AS cm, stddev_samp(c) AS cs FROM c GROUP BY date) SELECT date, ticker, round(CASE WHEN coalesce(s, 0) <= 0 OR coalesce(cs, 0) <= 0 THEN 0.0 ELSE (c - cm) / cs END, 6) AS value FROM c JOIN k USING (date)",
        "xs_qcut": f"{w}, r AS (SELECT date, ticker, value, row_number() OVER (PARTITION BY date ORDER BY value NULLS LAST, ticker) AS nth, count(value) {day} AS n FROM sig) SELECT date, ticker, CASE WHEN value IS NOT NULL THEN CAST(greatest(1, CASE WHEN n > 1 THEN ((nth - 1) * 5 + n - 2) // (n - 1) ELSE 1 END) AS INTEGER) END AS bucket FROM r",
    }
    r = f"{w}, r AS (SELECT date, ticker, volume, row_number() OVER (PARTITION BY date ORDER BY volume DESC NULLS LAST, ticker) - 1 AS i, count(volume) {day} AS n FROM sig) SELECT date, ticker, volume IS NOT NULL AND "
    out |= {"xs_size_top": r + "i < 20 AS is_member FROM r", "xs_size_bottom": r + "i >= n - 20 AS is_member FROM r", "xs_size_band": r + "coalesce(1 - (i + 0.5) / nullif(n, 0), 0) BETWEEN 0.5 AND 1 AS is_member FROM r"}
    days = f"WITH {WEEK}, days AS (SELECT date, ticker, close FROM dense), supp AS (SELECT CAST(s_suppkey AS BIGINT) AS ticker FROM supplier)"
    member = "m AS (SELECT ticker, CASE WHEN ticker % 10 <> 0 THEN max(date) END AS since FROM bars WHERE ticker % 2 = 0 GROUP BY ticker), mem AS (SELECT d.date, d.ticker, m.ticker IS NOT NULL AND (m.since IS NULL OR d.date >= m.since) AS is_member, close FROM days d LEFT JOIN m ON m.ticker = d.ticker)"
    out |= {
        "pit_asof": f"{days}, cl AS (SELECT ticker, date AS since, CASE WHEN volume % 2 = 0 THEN 'even' ELSE 'odd' END AS sector FROM bars WHERE volume > 60) SELECT d.date, d.ticker, (SELECT sector FROM cl WHERE cl.ticker = d.ticker AND cl.since <= d.date ORDER BY since DESC LIMIT 1) AS sector FROM days d",
        "pit_reverse_changes": f"{days}, ev AS (SELECT ticker, date AS t, CASE WHEN volume > 95 THEN 'added' ELSE 'removed' END AS kind FROM bars WHERE volume > 95 OR volume < 2) SELECT d.date, d.ticker, coalesce((SELECT kind = 'removed' FROM ev WHERE ev.ticker = d.ticker AND ev.t > d.date ORDER BY t LIMIT 1), d.ticker % 3 = 0 AND d.ticker IN (SELECT ticker FROM supp)) AS is_member FROM days d",
        "pit_date_added": f"{days}, {member} SELECT date, ticker, is_member FROM mem",
        "pit_industry": f"{days}, {member} SELECT date, ticker, round(CASE WHEN is_member THEN close END, 6) AS value FROM mem",
        "pit_coverage": f"{days} SELECT date, count(*) AS names, round(count(close) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM days GROUP BY date",
    }
    cons = f"{days}, cons AS (SELECT i.ticker, CASE WHEN i.ticker % 7 <> 0 THEN industry END AS sector, CASE WHEN i.ticker % 5 <> 0 THEN (SELECT min(date) FROM bars WHERE bars.ticker = i.ticker) + CAST(i.ticker % 11 * 40 AS INTEGER) END AS since FROM (SELECT CAST(s_suppkey AS BIGINT) AS ticker, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) i WHERE i.ticker % 3 = 0)"
    ev = "ev AS (SELECT ticker, date AS t, volume < 2 AS left_it FROM bars WHERE volume > 95 OR volume < 2), nm AS (SELECT ticker FROM cons UNION SELECT ticker FROM ev)"
    rev = "rv AS MATERIALIZED (SELECT c.date, n.ticker, coalesce((SELECT left_it FROM ev WHERE ev.ticker = n.ticker AND ev.t > c.date ORDER BY t LIMIT 1), n.ticker IN (SELECT ticker FROM cons)) AS is_member FROM cal c CROSS JOIN nm n), mr AS (SELECT * FROM rv WHERE ticker IN (SELECT ticker FROM cons) OR ticker IN (SELECT ticker FROM rv WHERE is_member))"
    add = "ma AS (SELECT c.date, n.ticker, n.since IS NULL OR c.date >= n.since AS is_member FROM cal c CROSS JOIN cons n)"
    seen = lambda m: f"(SELECT d.date, d.ticker, coalesce(m.is_member, false) AS is_member, CASE WHEN m.is_member THEN sector END AS industry FROM days d LEFT JOIN {m} m ON m.date = d.date AND m.ticker = d.ticker LEFT JOIN cons ON cons.ticker = d.ticker)"
    meta = lambda m, basis, yes: f"SELECT '{basis}' AS universe_membership_basis, {yes} AS membership_point_in_time, false AS classification_point_in_time, (SELECT count_if(is_member) FROM {m} WHERE date = (SELECT min(date) FROM cal)) AS universe_size_start, (SELECT count_if(is_member) FROM {m} WHERE date = (SELECT max(date) FROM cal)) AS universe_size_end, round(coalesce((SELECT count_if(is_member AND industry IS NOT NULL) / nullif(count_if(is_member), 0) FROM {seen(m)}), 0), 6) AS classification_coverage"
    out |= {
        "pit_universe_changes": f"{cons}, {ev}, {rev} SELECT date, ticker, is_member FROM mr",
        "pit_universe_additions": f"{cons}, {add} SELECT date, ticker, is_member FROM ma",
        "pit_universe_metadata": f"{cons}, {ev}, {rev}, {add} {meta('mr', 'changes_reversed', 'true')} UNION ALL {meta('ma', 'date_added_additions_only', 'false')}",
        "pit_universe_industry": f"{cons}, {ev}, {rev} SELECT date, ticker, is_member, industry FROM {seen('mr')}",
    }
    return out


def _variants() -> dict[str, str]:
    """A factor as it is and neutral, each with its portfolio; a neutral side is scaled to 1 over all industries."""
    z = lambda x: f"rank() OVER (PARTITION BY variant, date ORDER BY {x}) + (count(*) OVER (PARTITION BY variant, date, {x}) - 1) / 2"
    w = f"""WITH {SIG},
wv AS (SELECT date, pos, ticker, industry, returns, CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END AS v FROM sig JOIN (SELECT date, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM sig GROUP BY date) USING (date)),
r0 AS MATERIALIZED (SELECT date, pos, ticker, industry, returns, (v - m) / s AS raw FROM wv JOIN (SELECT date, avg(v) AS m, nullif(stddev_pop(v), 0) AS s FROM wv GROUP BY date) USING (date)),
gm AS (SELECT *, raw - avg(raw) OVER (PARTITION BY date, industry) AS r FROM r0),
vs AS MATERIALIZED (SELECT 'raw' AS variant, date, pos, ticker, industry, returns, raw AS value FROM r0 UNION ALL SELECT 'neutralized', date, pos, ticker, industry, returns, CASE WHEN n >= 30 AND s > 1e-12 THEN (r - m) / s END FROM gm JOIN (SELECT date, count(r) AS n, avg(r) AS m, stddev_pop(r) AS s FROM gm GROUP BY date) USING (date)),
pr AS MATERIALIZED (SELECT v.variant, v.date, v.ticker, v.value, b.close / a.close - 1 AS fwd FROM vs v JOIN panel a ON a.date = v.date AND a.ticker = v.ticker JOIN panel b ON b.ticker = a.ticker AND b.pos = a.pos + 5 WHERE v.value IS NOT NULL AND b.close / a.close IS NOT NULL),
ic AS MATERIALIZED (SELECT variant, date, {CORR.format(x='x', y='y')} AS ic FROM (SELECT variant, date, {z('value')} AS x, {z('fwd')} AS y FROM pr) GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x) AND min(y) < max(y)),
qb AS (SELECT variant, date, greatest(1, ceil((nth - 1) * 5 / (n - 1))) AS b, fwd FROM (SELECT *, count(*) OVER (PARTITION BY variant, date) AS n, row_number() OVER (PARTITION BY variant, date ORDER BY value, ticker) AS nth, min(value) OVER (PARTITION BY variant, date) < max(value) OVER (PARTITION BY variant, date) AS varies FROM pr) WHERE n >= 30 AND varies),
sp AS (SELECT variant, avg(d) AS top_bottom_mean FROM (SELECT variant, date, avg(fwd) FILTER (b = 5) - avg(fwd) FILTER (b = 1) AS d FROM qb GROUP BY ALL) GROUP BY variant),
nd AS (SELECT *, CASE variant WHEN 'raw' THEN '' ELSE industry END AS grp FROM vs),
pl AS (SELECT *, count(value) OVER (PARTITION BY variant, date, grp) AS n, row_number() OVER (PARTITION BY variant, date, grp ORDER BY value NULLS LAST, ticker) AS i FROM nd),
sd AS (SELECT *, CASE WHEN value IS NULL OR n < 2 * k THEN 0.0 WHEN i <= k THEN -1 / k WHEN i > n - k THEN 1 / k ELSE 0.0 END AS w0 FROM (SELECT *, CAST(greatest(1, floor(n * 0.2)) AS DOUBLE) AS k FROM pl)),
sc AS (SELECT *, CASE WHEN variant = 'raw' OR w0 = 0 THEN w0 ELSE w0 / sum(abs(w0)) OVER (PARTITION BY variant, date, sign(w0)) END AS w1 FROM sd),
tg AS MATERIALIZED (SELECT variant, date, pos, ticker, returns, max(abs(w1)) OVER (PARTITION BY variant, date) > 0.1 + 1e-12 AS over, w1 FROM sc),
ex AS (SELECT variant, date, pos, ticker, coalesce(returns / 1000, 0) AS ret, coalesce(lag(CASE WHEN over THEN 0 ELSE w1 END) OVER (PARTITION BY variant, ticker ORDER BY pos), 0) AS w FROM tg),
dy AS MATERIALIZED (SELECT variant, pos, sum(w * ret) - sum(abs(dw)) * 10 / 10000 AS net, sum(abs(dw)) AS turnover FROM (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY variant, ticker ORDER BY pos), 0) AS dw FROM ex) GROUP BY ALL),
dd AS (SELECT variant, min(wealth / top - 1) AS max_drawdown FROM (SELECT *, max(wealth) OVER (PARTITION BY variant ORDER BY pos) AS top FROM (SELECT *, product(1 + net) OVER (PARTITION BY variant ORDER BY pos) AS wealth FROM dy)) GROUP BY variant),
pm AS (SELECT variant, avg(net) * 252 AS annualized_return, stddev_samp(net) * sqrt(252) AS annualized_volatility, avg(turnover) AS average_turnover, sum(turnover) * 10 / 10000 AS total_cost FROM dy GROUP BY variant),
bad AS (SELECT variant, count(DISTINCT date) FILTER (over) AS invalid_weight_dates FROM tg GROUP BY variant),
im AS (SELECT variant, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(*) AS ic_observations FROM ic GROUP BY variant)"""
    r = lambda *names: ", ".join(f"round({x}, 5) AS {x}" for x in names)
    gates = [
        ("classification_coverage", "(SELECT count(industry) / count(*) FROM sig)", "0.95", ">="), ("variants_present", "(SELECT count(DISTINCT variant) FROM ic)", "2", ">="),
        ("industry_exposure", "(SELECT max(abs(m)) FROM (SELECT avg(value) AS m FROM vs WHERE variant = 'neutralized' AND value IS NOT NULL GROUP BY date, industry))", "1e-8", "<="), ("label_overlap", "0", "0", "<="),
        ("neutralization_dates", "(SELECT coalesce(avg(CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END), 0) FROM (SELECT date, count(value) AS n FROM vs WHERE variant = 'raw' GROUP BY date) a JOIN (SELECT date, count(value) AS n FROM vs WHERE variant = 'neutralized' GROUP BY date) b USING (date) WHERE a.n > 0)", "0.95", ">="),
    ]
    return {
        "experiment_variants": f"{w} SELECT pm.variant, {r('ic_mean', 'ic_std', 'top_bottom_mean', 'annualized_return', 'annualized_volatility', 'max_drawdown', 'average_turnover', 'total_cost')}, coalesce(ic_observations, 0) AS ic_observations, round(annualized_return / nullif(annualized_volatility, 0), 5) AS sharpe, CASE pm.variant WHEN 'raw' THEN 'global' ELSE 'industry_neutral' END AS portfolio_mode, invalid_weight_dates FROM pm JOIN dd USING (variant) JOIN bad USING (variant) LEFT JOIN im USING (variant) LEFT JOIN sp USING (variant)",
        "experiment_gates": f"{w} SELECT gate, round(value, 5) AS value, round(bound, 5) AS bound, passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS gate, CAST({v} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS bound, coalesce({v} {op} {b}, false) AS passed" for n, v, b, op in gates) + ")",
        "xs_group_mean": f"WITH {SIG}, b AS (SELECT date, avg(value) AS m, nullif(stddev_pop(value), 0) AS s FROM sig GROUP BY date) SELECT date, round(max(abs(g)), 6) AS max_abs_mean FROM (SELECT date, industry, avg((value - m) / s) AS g FROM sig JOIN b USING (date) WHERE value IS NOT NULL AND s IS NOT NULL GROUP BY ALL) GROUP BY date",
    }


def _contracts() -> dict[str, str]:
    raw = """raw AS (SELECT CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_suppkey AS BIGINT) END AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CASE WHEN l_quantity = 7 THEN CAST('inf' AS DOUBLE) WHEN l_quantity = 9 THEN CAST('nan' AS DOUBLE) ELSE l_extendedprice END AS price, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_linenumber <= 2),
f AS (SELECT date, ticker, ticker IS NULL AS required, row_number() OVER (PARTITION BY date, ticker) > 1 AS once, isnan(price) OR isinf(price) AS finite, date < lag(date) OVER (PARTITION BY ticker ORDER BY seq, date) AS back FROM raw),
al AS (SELECT coalesce(f.date, b.date) AS date, coalesce(f.ticker, b.ticker) AS ticker, f.* EXCLUDE (date, ticker), f.date IS NULL OR b.date IS NULL AS apart FROM f FULL JOIN bars b ON b.date = f.date AND b.ticker = f.ticker)"""
    rules = {"required": "required", "unique": "once", "finite": "finite", "sorted": "back", "aligned": "apart"}
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, count_if(coalesce({c}, false)) AS violations, (SELECT date FROM al WHERE {c} ORDER BY date, ticker NULLS FIRST LIMIT 1) AS first_date, (SELECT ticker FROM al WHERE {c} ORDER BY date, ticker NULLS FIRST LIMIT 1) AS first_ticker FROM al" for r, c in rules.items())
    own = "own AS (SELECT 'close' AS factor, date, ticker, count(*) AS n FROM (SELECT date, ticker FROM bars UNION ALL SELECT date, ticker FROM bars WHERE volume > 50) GROUP BY ALL UNION ALL SELECT 'late', date + 1, ticker, 1 FROM bars WHERE ticker % 2 = 0)"
    q, base = _long()
    return {
        "contract_violations": f"WITH {WEEK}, {raw} {each}",
        "contract_alignment": f"WITH {WEEK}, {own} SELECT factor, (SELECT count(*) FROM dense) - count(d.date) AS missing, count_if(d.date IS NULL) AS surplus, count_if(n > 1) AS repeated FROM own LEFT JOIN dense d ON d.date = own.date AND d.ticker = own.ticker GROUP BY factor",
        "contract_feasibility": q.end("SELECT factor, CAST(floor(median(n)) AS BIGINT) AS names, 50 AS required, floor(median(n)) >= 50 AS feasible FROM (SELECT factor, date, count(value) AS n FROM factors GROUP BY ALL) GROUP BY factor", *base),
    }


def _portfolio() -> dict[str, str]:
    w = f"WITH {SIG}"
    b = BUFFERED.format(every=5)
    side = "row_number() OVER (PARTITION BY {g} ORDER BY value, ticker) AS up, row_number() OVER (PARTITION BY {g} ORDER BY value DESC, ticker DESC) AS down, greatest(1, floor(count(*) OVER (PARTITION BY {g}) * 0.2)) AS k, count(*) OVER (PARTITION BY {g}) AS n"
    pick = "CASE WHEN n < 2 * k THEN 0.0 WHEN up <= k THEN -1.0 / k WHEN down <= k THEN 1.0 / k ELSE 0.0 END"
    net, stress = NET.format(costs="10.0"), NET.format(costs="0.0, 5.0, 10.0, 20.0")
    perf = "avg(net) * 252 / nullif(stddev_samp(net) * sqrt(252), 0)"
    tradeoff = " UNION ALL ".join(f"SELECT * FROM ({w}, {BUFFERED.format(every=e)}, {MOVES}, {net} SELECT {e} AS every, round(avg(turnover), 6) AS average_turnover, round(avg(net), 6) AS mean_net FROM net)" for e in (5, 10, 21, 42))
    grid = PART.format(aum="1e6, 1e7, 1e8")
    return {
        "pf_long_short": f"{w}, r AS (SELECT date, ticker, {side.format(g='date')} FROM sig WHERE value IS NOT NULL) SELECT s.date, s.pos, s.ticker, round(coalesce({pick}, 0), 6) AS w FROM sig s LEFT JOIN r ON r.date = s.date AND r.ticker = s.ticker",
        "pf_long_short_industry": f"{w}, r AS (SELECT date, ticker, {side.format(g='date, industry')} FROM sig WHERE value IS NOT NULL), v AS (SELECT date, ticker, {pick} AS v FROM r), t AS (SELECT date, sum(greatest(v, 0)) AS up, sum(greatest(-v, 0)) AS down FROM v GROUP BY date) SELECT s.date, s.pos, s.ticker, round(coalesce(CASE WHEN v > 0 THEN v / up WHEN v < 0 THEN v / down ELSE 0.0 END, 0), 6) AS w FROM sig s LEFT JOIN v ON v.date = s.date AND v.ticker = s.ticker LEFT JOIN t ON t.date = s.date",
        "pf_buffered_targets": f"{w}, {b} SELECT date, pos, ticker, round(w, 6) AS w, action FROM targets",
        "pf_simulate": f"{w}, {b}, {MOVES}, {net} SELECT date, pos, round(gross, 6) AS gross, round(turnover, 6) AS turnover, cost_bps, round(net, 6) AS net FROM net",
        "pf_drawdown": f"{w}, {b}, {MOVES}, {net}, {WEALTH} SELECT date, pos, round(wealth, 5) AS wealth, round(drawdown, 5) AS drawdown FROM dd",
        "pf_cost_stress": f"{w}, {b}, {MOVES}, {stress}, {WEALTH} SELECT cost_bps, round(avg(net) * 252, 5) AS annualized_return, round(stddev_samp(net) * sqrt(252), 5) AS annualized_volatility, round({perf}, 5) AS sharpe, round(min(drawdown), 5) AS max_drawdown FROM dd GROUP BY cost_bps",
        "pf_sortino_calmar_winrate": f"{w}, {b}, {MOVES}, {net}, {WEALTH} SELECT cost_bps, round(avg(net) * 252 / nullif(stddev_samp(least(net, 0)) * sqrt(252), 0), 5) AS sortino, round(avg(net) * 252 / nullif(abs(min(drawdown)), 0), 5) AS calmar, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate, count(net) AS n FROM dd GROUP BY cost_bps",
        "subperiod_perf": f"{w}, {b}, {MOVES}, {net} SELECT CAST(year(date) AS VARCHAR) AS label, round(avg(net) * 252, 5) AS annualized_return, round(stddev_samp(net) * sqrt(252), 5) AS annualized_volatility, round({perf}, 5) AS sharpe FROM net GROUP BY year(date)",
        "pf_participation": f"{w}, {b}, {MOVES}, {PART.format(aum='1e7')} SELECT date, ticker, illiquid, round(CASE WHEN NOT illiquid THEN participation END, 5) AS participation FROM parts",
        "pf_liquidity_cost": f"{w}, {b}, {MOVES}, {grid} SELECT aum, date, round(sum(cost), 6) AS cost FROM costs GROUP BY ALL",
        "pf_capacity": f"{w}, {b}, {MOVES}, {grid}, dn AS (SELECT aum, date, sum(w * ret) - sum(cost) AS net, sum(cost) AS cost, max(participation) FILTER (abs(dw) > 0) AS p, count_if(illiquid OR coalesce(abs(dw) > 0 AND participation > 0.2, false)) AS br FROM costs GROUP BY ALL) SELECT aum, round(avg(net) * 252, 5) AS annualized_return, round(avg(cost), 5) AS average_daily_cost, round(CASE WHEN max(p) < 1e300 THEN max(p) END, 5) AS max_participation, coalesce(max(p) >= 1e300, false) AS unbounded, CAST(sum(br) AS BIGINT) AS capacity_breach_trades, round({perf}, 5) AS net_sharpe FROM dn GROUP BY aum",
        "pf_exposure": f"{w}, {b} SELECT date, industry, round(sum(w), 6) AS exposure FROM targets JOIN ind USING (ticker) GROUP BY ALL",
        "pf_max_exposure": f"{w}, {b} SELECT date, round(max(abs(e)), 6) AS max_abs_exposure FROM (SELECT date, industry, sum(w) AS e FROM targets JOIN ind USING (ticker) GROUP BY ALL) GROUP BY date",
        "pf_rebalance_tradeoff": tradeoff,
    }


def _rest() -> dict[str, str]:
    tests = "t AS (SELECT p_brand AS name, avg(p_retailprice) % 97 / 970 AS p FROM part GROUP BY p_brand)"
    score = f"""WITH {WEEK}, g AS (SELECT ticker, count(*) AS n, count_if(coalesce(open > high, false) OR coalesce(close < low, false) OR coalesce(volume <= 0, false)) AS bad, date_diff('day', max(date), DATE '1998-12-15') / 14 AS r FROM bars GROUP BY ticker),
s AS (SELECT ticker, n AS rows, 0.7 * least(100, 100.0 * n / 357) + 30 AS completeness, (n - bad) / CAST(n AS DOUBLE) * 100 AS validity, CASE WHEN r <= 1 THEN 100.0 WHEN r <= 1.5 THEN 100 - 100 * (r - 1) ELSE greatest(0, 50 - 25 * (r - 1.5)) END AS timeliness, 100.0 AS consistency FROM g),
o AS (SELECT *, 0.3 * completeness + 0.3 * validity + 0.2 * timeliness + 0.2 * consistency AS overall FROM s)"""
    bars = f"WITH {WEEK}"
    daily = f"WITH {BARS.format(grain='day')}, need AS (SELECT t.ticker, CAST(d AS DATE) AS date FROM (SELECT DISTINCT ticker FROM bars) t, (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.date = CAST(d AS DATE)))"

    def scored(name: str, volume: str, keep: str) -> str:
        label = "CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 80 THEN 'Good' WHEN overall >= 70 THEN 'Fair' WHEN overall >= 60 THEN 'Poor' ELSE 'Critical' END AS label"
        parts = score.removeprefix(f"WITH {WEEK}, ").replace("coalesce(volume <= 0, false)", f"coalesce({volume} <= 0, false)").replace("FROM bars GROUP BY ticker)", f"FROM bars LEFT JOIN med USING (ticker) WHERE {keep} GROUP BY ticker)")
        for t in ("g", "s", "o"):
            parts = parts.replace(f"{t} AS (SELECT", f"{name}{t} AS (SELECT", 1).replace(f"FROM {t})", f"FROM {name}{t})")
        return f"{parts}, {name} AS (SELECT *, {label} FROM {name}o)"

    sides = ("overall", "completeness", "validity", "timeliness", "consistency")
    compared = f"WITH {WEEK}, med AS (SELECT ticker, median(volume) AS m FROM bars WHERE volume >= 20 GROUP BY ticker), {scored('x', 'CASE WHEN volume >= 20 THEN volume ELSE 0 END', 'ticker % 10 <> 3')}, {scored('y', 'CASE WHEN volume >= 20 THEN volume ELSE m END', 'ticker % 10 <> 4')} SELECT coalesce(x.ticker, y.ticker) AS ticker, " + ", ".join(f"round(x.{c}, 5) AS {c}_before, round(y.{c}, 5) AS {c}_after, round(y.{c} - x.{c}, 5) AS {c}_delta" for c in sides) + ", x.label AS label_before, y.label AS label_after, CASE WHEN x.overall IS NULL THEN 'added' WHEN y.overall IS NULL THEN 'removed' WHEN y.overall - x.overall > 5e-10 THEN 'improved' WHEN y.overall - x.overall < -5e-10 THEN 'worsened' ELSE 'unchanged' END AS status FROM x FULL JOIN y ON x.ticker = y.ticker"
    clip = lambda c: f"greatest(least({c}, q3_{c} + 0.5 * (q3_{c} - q1_{c})), q1_{c} - 0.5 * (q3_{c} - q1_{c}))"
    quart = lambda *cs: "q AS (SELECT ticker, " + ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cs) + " FROM bars GROUP BY ticker)"
    prices = ("open", "high", "low", "close")
    known = "(SELECT {c} FROM dense b WHERE b.ticker = a.ticker AND b.{c} IS NOT NULL AND b.date {op} a.date ORDER BY b.date {dir} LIMIT 1)"
    prev, nxt = (lambda c: known.format(c=c, op="<=", dir="DESC")), (lambda c: known.format(c=c, op=">=", dir="ASC"))
    return {
        "stat_bonferroni": f"WITH {tests} SELECT name, round(p, 6) AS p, round(least(1, p * (SELECT count(*) FROM t)), 6) AS p_bonferroni FROM t",
        "stat_bh": f"WITH {tests}, k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k FROM t) SELECT a.name, round(a.p, 6) AS p, round(least(1, (SELECT min(b.p * (SELECT count(*) FROM t) / b.k) FROM k b WHERE b.k >= a.k)), 6) AS p_bh FROM k a",
        "stat_outlier_iqr": f"{bars}, q AS (SELECT ticker, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS b FROM bars GROUP BY ticker) SELECT date, ticker, close < a - 1.5 * (b - a) OR close > b + 1.5 * (b - a) AS outlier FROM bars JOIN q USING (ticker)",
        "stat_outlier_z": f"{bars}, q AS (SELECT ticker, avg(close) AS m, stddev_samp(close) AS s FROM bars GROUP BY ticker) SELECT date, ticker, coalesce(abs(close - m) / nullif(s, 0) > 2, false) AS outlier FROM bars JOIN q USING (ticker)",
        "stat_outlier_dbscan": f"{bars}, q AS (SELECT ticker, avg(close) AS m, nullif(stddev_pop(close), 0) AS s FROM bars GROUP BY ticker), z AS (SELECT date, ticker, (close - m) / s AS z FROM bars JOIN q USING (ticker)), core AS (SELECT a.ticker, a.date, a.z FROM z a JOIN z b ON b.ticker = a.ticker AND b.z BETWEEN a.z - 0.05 AND a.z + 0.05 GROUP BY ALL HAVING count(*) >= 5) SELECT date, ticker, z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM core c WHERE c.ticker = z.ticker AND c.z BETWEEN z.z - 0.05 AND z.z + 0.05) AS outlier FROM z",
        "dq_scores": score + " SELECT ticker, rows, round(completeness, 5) AS completeness, round(validity, 5) AS validity, round(timeliness, 5) AS timeliness, consistency, round(overall, 5) AS overall, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 80 THEN 'Good' WHEN overall >= 70 THEN 'Fair' WHEN overall >= 60 THEN 'Poor' ELSE 'Critical' END AS label FROM o",
        "dq_alert_counts": score + " SELECT CASE WHEN v < 50 THEN 'critical' ELSE 'warning' END AS severity, count(*) AS alerts, count(DISTINCT ticker) AS tickers FROM (SELECT ticker, unnest([completeness, validity, timeliness, overall]) AS v FROM o) WHERE v < 100 GROUP BY 1",
        "dq_alerts": score + " SELECT ticker, c || ' is low' AS message, CASE WHEN v < 50 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT ticker, unnest(['completeness', 'validity', 'timeliness', 'overall']) AS c, unnest([completeness, validity, timeliness, overall]) AS v FROM o) WHERE v < 100",
        "dq_missing_days": f"{daily} SELECT ticker, date FROM need",
        "dq_completeness": f"{daily}, w AS (SELECT ticker, count_if(gap > 20) AS large_gaps FROM (SELECT ticker, date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS gap FROM bars) GROUP BY ticker), c AS (SELECT b.ticker, b.bars, missing_values, coalesce(missing_days, 0) AS missing_days, large_gaps FROM (SELECT ticker, count(*) AS bars, count_if(volume >= 45) AS missing_values FROM bars GROUP BY ticker) b JOIN w ON w.ticker = b.ticker LEFT JOIN (SELECT ticker, count(*) AS missing_days FROM need GROUP BY ticker) m ON m.ticker = b.ticker) SELECT *, nullif(concat_ws(', ', CASE WHEN missing_values > 0 THEN missing_values || ' missing values' END, CASE WHEN missing_days > 0 THEN missing_days || ' missing days' END, CASE WHEN large_gaps > 0 THEN large_gaps || ' large gaps' END), '') AS message FROM c",
        "dq_comparison": compared,
        "dq_gaps": f"{bars} SELECT ticker, date, CAST(gap AS INTEGER) AS gap_days FROM (SELECT a.ticker, a.date, date_diff('day', max(b.date), a.date) AS gap FROM bars a JOIN bars b ON b.ticker = a.ticker AND b.date < a.date GROUP BY a.ticker, a.date) WHERE gap > 14",
        "dq_consistency": f"{bars}, {quart(*prices, 'volume')}, m AS (SELECT ticker, " + ", ".join(f"abs(avg({c}) - avg({clip(c)})) AS d_{c}" for c in (*prices, "volume")) + " FROM bars JOIN q USING (ticker) GROUP BY ticker) SELECT ticker, c AS \"column\", round(d, 4) AS difference FROM (SELECT ticker, unnest(['open', 'high', 'low', 'close', 'volume']) AS c, unnest([d_open, d_high, d_low, d_close, d_volume]) AS d FROM m) WHERE d > 0.01",
        "clean_ohlc": f"{bars} SELECT ticker, date, round(open, 6) AS open, round(greatest(open, close), 6) AS high, round(least(open, close, low), 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM (SELECT ticker, date, open, open AS high, close AS low, close, volume FROM bars)",
        "clean_volume": f"{bars}, m AS (SELECT ticker, median(volume) AS m FROM bars WHERE volume >= 20 GROUP BY ticker) SELECT date, ticker, round(CASE WHEN volume >= 20 THEN volume ELSE m END, 6) AS volume FROM bars LEFT JOIN m USING (ticker)",
        "clean_fill": f"{bars} SELECT a.date, a.ticker, round(coalesce({prev('close')}, {nxt('close')}), 6) AS close, round(coalesce({prev('volume')}, {nxt('volume')}), 6) AS volume FROM dense a",
        "clean_interpolate": f"{bars}, k AS (SELECT *, (SELECT max(pos) FROM dense b WHERE b.ticker = a.ticker AND b.pos <= a.pos AND b.close IS NOT NULL) AS lo, (SELECT min(pos) FROM dense b WHERE b.ticker = a.ticker AND b.pos >= a.pos AND b.close IS NOT NULL) AS hi FROM dense a) SELECT k.date, k.ticker, round(CASE WHEN k.hi > k.lo THEN x.close + (y.close - x.close) * (k.pos - k.lo) / (k.hi - k.lo) ELSE x.close END, 4) AS close FROM k LEFT JOIN dense x ON x.ticker = k.ticker AND x.pos = k.lo LEFT JOIN dense y ON y.ticker = k.ticker AND y.pos = k.hi",
        "clean_winsor": f"{bars}, {quart('close', 'volume')} SELECT date, ticker, round({clip('close')}, 5) AS close, round({clip('volume')}, 5) AS volume FROM bars JOIN q USING (ticker)",
        "clean_shift": f"{bars}, s AS (SELECT ticker, greatest(0, date_diff('day', max(date), DATE '1998-11-25')) AS late FROM bars GROUP BY ticker) SELECT CAST(date + CAST(late AS INTEGER) AS DATE) AS date, ticker, round(close, 6) AS close FROM bars JOIN s USING (ticker)",
        "clean_calendar": f"{bars}, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker), dd AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s), wd AS (SELECT * FROM dd WHERE isodow(date) < 6) SELECT w.date, w.ticker, round(b.close, 6) AS close FROM wd w ASOF JOIN bars b ON b.ticker = w.ticker AND w.date >= b.date",
        "sanitize": """WITH r AS (SELECT CAST(l_suppkey AS BIGINT) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice * (1 - l_discount) AS open, l_extendedprice AS high, l_extendedprice * (1 - l_tax) AS low, l_extendedprice * 0.97 AS close, CAST(l_quantity - 10 AS DOUBLE) AS volume, row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS nth FROM lineitem WHERE l_quantity > 0),
x AS (SELECT *, NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high)) AS bad FROM r WHERE nth = 1)
SELECT ticker, date, """ + ", ".join(f"round(CASE WHEN NOT bad THEN {c} END, 4) AS {c}" for c in ("open", "high", "low", "close")) + ", round(CASE WHEN volume > 0 THEN volume END, 4) AS volume FROM x",
        "panel_metadata": f"{bars} SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker",
    }


def _decimal(sql: str) -> str:
    """Every round(e, n) taken over seven decimals first, as the Spark side does: exact halves then round alike."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            comma = j if c == "," and depth == 1 else comma
            j += 1
        out += sql[at:i] + f"CAST(round(CAST({_decimal(sql[i + 6 : comma])} AS DECIMAL(38, 7)), {sql[comma + 1 : j - 1].strip()}) AS DOUBLE)"
        at = j
    return out + sql[at:]


_SQL: dict[str, str] = _ops() | _alphas() | _technical() | _fundamental() | _evaluation() | _candidate_sql() | _cross() | _contracts() | _variants() | _portfolio() | _rest()
_SQL["factor_families"] = " UNION ALL ".join(f"SELECT '{n}' AS factor, '{f}' AS family, count(value) AS values FROM ({_SQL[f'fac_{n}']})" for n, f in families() if f"fac_{n}" in _SQL)
SQL = {k: _decimal(v) for k, v in _SQL.items()}
