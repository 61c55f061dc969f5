"""The registered queries of the factor library. Each takes (spark, sf_dir); the SQL of each is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.functions import alphas, technical
from factorloom.operators import crosssection as xs
from factorloom.operators import evaluation as ev
from factorloom.operators import contracts, pit, quality, redundancy
from factorloom.operators import portfolio as pf
from factorloom.operators import selection as sel
from factorloom.operators import statistics as st
from factorloom.operators.timeseries import Frame, modulo
from factorloom.plans import ablation, experiment, formula, inputs, oos
from factorloom.sources import market
from factorloom.sources.shared import keep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Names on a date below which it has no cross-section, as the panel has about 80 names a week at sf0.01.
NAMES, HORIZONS = 30, (1, 5, 10)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(c: Column | str, digits: int = 6) -> Column:
    """c to so many digits, by way of seven: halves that differ in the last bit then round alike."""
    return F.round(F.round(c, 7), digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that engines which add in another order agree."""
    return df.select(*(_r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- operators of formulas: name, digits, what it is

_OPS: dict[str, tuple[int, Callable[[Frame], Column]]] = {
    "op_rank": (6, lambda f: f.rank(f["close"])),
    "op_delay": (6, lambda f: f.delay(f["close"], 3)),
    "op_delta": (6, lambda f: f.delta(f["close"], 2)),
    "op_ts_sum": (2, lambda f: f.ts_sum(f["volume"], 5)),
    "op_ts_min": (6, lambda f: f.ts_min(f["low"], 10)),
    "op_ts_max": (6, lambda f: f.ts_max(f["high"], 10)),
    "op_stddev": (4, lambda f: f.stddev(f["close"], 8)),
    "op_ts_rank": (6, lambda f: f.ts_rank(f["close"], 10)),
    "op_correlation": (6, lambda f: f.correlation(f["close"], f["volume"], 6)),
    "op_covariance": (6, lambda f: f.covariance(f["close"] / 1000, f["reported_volume"], 6)),
    "op_sign": (6, lambda f: f.sign(f.delta(f["close"], 1))),
    "op_signed_power": (4, lambda f: f.signed_power(f["returns"], 0.5)),
    "op_safe_divide": (6, lambda f: f.safe_divide(f["close"], f["reported_volume"] - 25)),
    "op_where": (6, lambda f: f.where(f["close"] > f["open"], f["high"], f["low"])),
    "op_adv": (2, lambda f: f.adv(f["close"], f["reported_volume"], 5)),
    "op_log": (6, lambda f: f.log(f["close"] - 1000)),
    "op_abs": (6, lambda f: f.abs(f.delta(f["close"], 1))),
    "op_modulo": (4, lambda f: modulo(f["close"] - f["open"], F.lit(7.0))),
}


def _op(name: str, digits: int, build: Callable[[Frame], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Frame(market.panel(spark, sf_dir))
        c = f.put(market.finite(build(f)))
        return f.df.select("date", "ticker", _r(c, digits).alias("value"))

    QUERIES[name] = run


for _name, (_digits, _build) in _OPS.items():
    _op(_name, _digits, _build)


def _alpha(a: alphas.Alpha) -> None:
    QUERIES[a.name] = lambda spark, sf_dir: alphas.build(market.panel(spark, sf_dir), (a.number,)).select("date", "ticker", _r(a.name, 5).alias("value"))


for _a in alphas.ALPHAS:
    _alpha(_a)

FACTORS = tuple(n for family in ("reversal", "momentum") for n in technical.FAMILIES[family])


def _fac(name: str) -> None:
    QUERIES[f"fac_{name}"] = lambda spark, sf_dir: technical.technical(market.lineitem_bars(spark, sf_dir), names=(name,)).select("date", "ticker", _r(name, 5).alias("value"))


for _name in FACTORS:
    _fac(_name)


@query
def fac_winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(technical.technical(market.lineitem_bars(spark, sf_dir), winsorize=True, names=("reversal_5d", "momentum_63d")).select("date", "ticker", "reversal_5d", "momentum_63d"), 5)


def fundamental_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items made of order lines, on the monthly calendar: running sums stand for balances and twelve-month sums for flows."""
    p = market.densify(market.lineitem_bars(spark, sf_dir, "month"))
    w = Window.partitionBy("ticker").orderBy("pos")
    year, past = w.rowsBetween(-11, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return p.select("date", "pos", "ticker", "close", F.sum("open").over(year).alias("net_income_ttm"), F.sum("high").over(year).alias("gross_profit_ttm"), F.sum("volume").over(past).alias("equity"), (F.sum("close").over(past) + F.sum("volume").over(past)).alias("assets"), (F.sum("volume").over(year)).alias("shares"))


FUNDAMENTALS = technical.FAMILIES["value"]


def _fund(name: str) -> None:
    QUERIES[f"fund_{name}"] = lambda spark, sf_dir: technical.fundamental(fundamental_items(spark, sf_dir), year=12).select("date", "ticker", _r(name, 5).alias("value"))


for _name in FUNDAMENTALS:
    _fund(_name)


# ---- formulas

@query
def formula_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formula.evaluate(market.panel(spark, sf_dir), formula.DEFAULTS).drop("pos")
    return _rounded(out, 4)


@query
def factor_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each technical factor's family, and how many values the bars give."""
    names = spark.createDataFrame([(n, f) for n, f in technical.families() if n in FACTORS], "factor string, family string")
    counts = technical.technical(market.lineitem_bars(spark, sf_dir)).agg(*(F.count(n).alias(n) for n in FACTORS))
    values = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("values")) for n in FACTORS))).alias("_v")).select("_v.*")
    return names.join(values, "factor", "left").fillna(0, ["values"])


@query
def inputs_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over a calendar that begins in 1998, from a panel that begins just early enough."""
    return _rounded(inputs.extended(market.lineitem_bars(spark, sf_dir), "1998-01-01", formula.DEFAULTS, least=3).factors, 4)


# ---- cross-section

def _reversal(f: Frame, lag: int = 5) -> Column:
    return f.put(market.finite(-F.try_divide(f.delta(f["close"], lag), f.delay(f["close"], lag))))


def _signal(spark: SparkSession, sf_dir: str, lag: int = 5) -> DataFrame:
    """date, pos, ticker, value (a five-row reversal), close, volume, industry."""
    f = Frame(market.panel(spark, sf_dir))
    v = _reversal(f, lag)
    rows = f.df.select("date", "pos", "ticker", v.alias("value"), "close", "volume", "adv20", "returns")
    return rows.join(market.supplier_industry(spark, sf_dir), "ticker")


@query
def xs_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.winsorize(_signal(spark, sf_dir), lo=0.05, hi=0.95).select("date", "ticker", "value"), 5)


@query
def xs_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.standardize(_signal(spark, sf_dir)).select("date", "ticker", "value"))


@query
def xs_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.neutralize(_signal(spark, sf_dir)))


@query
def xs_neutralize_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.neutralize(_signal(spark, sf_dir), size="volume"))


@query
def xs_neutralize_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    return _rounded(xs.neutralize_reasons(s, xs.neutralize(s, size="volume", min_names=40), size="volume", min_names=40))


@query
def xs_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.industry_variants(_signal(spark, sf_dir)))


@query
def xs_centered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.centered_rank(_signal(spark, sf_dir)).select("date", "ticker", "value"))


@query
def xs_zscore_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(xs.zscore_clip(_signal(spark, sf_dir)).select("date", "ticker", "value"))


@query
def xs_qcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.buckets(_signal(spark, sf_dir)).select("date", "ticker", "bucket")


@query
def xs_size_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.size_members(_signal(spark, sf_dir), "volume", "top", 20)


@query
def xs_size_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.size_members(_signal(spark, sf_dir), "volume", "bottom", 20)


@query
def xs_size_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.named_bucket(_signal(spark, sf_dir), "volume", "larger_half")


# ---- point in time

def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.densify(market.lineitem_bars(spark, sf_dir)).select("date", "ticker", "close")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated classes made from the bars: at each bar whose volume is above 60, the class is by its parity."""
    b = market.lineitem_bars(spark, sf_dir).filter("volume > 60")
    return b.select("ticker", F.col("date").alias("effective_date"), F.when(F.col("volume") % 2 == 0, "even").otherwise("odd").alias("sector"))


@query
def pit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.asof(_days(spark, sf_dir).select("date", "ticker"), _classes(spark, sf_dir), "sector")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index changes made from the bars: a bar with volume above 95 adds its ticker, one with less than 2 removes it."""
    b = market.lineitem_bars(spark, sf_dir)
    return b.filter("volume > 95 or volume < 2").select(F.col("date").alias("effective_date"), F.when(F.col("volume") > 95, F.col("ticker")).alias("added"), F.when(F.col("volume") < 2, F.col("ticker")).alias("removed"))


@query
def pit_reverse_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = market.supplier_industry(spark, sf_dir).filter("ticker % 3 = 0").select("ticker")
    return pit.reverse_changes(_days(spark, sf_dir), current, _changes(spark, sf_dir))


@query
def pit_date_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = market.lineitem_bars(spark, sf_dir).filter("ticker % 2 = 0").groupBy("ticker").agg(F.max("date").alias("date_added"))
    members = members.withColumn("date_added", F.when(F.col("ticker") % 10 != 0, F.col("date_added")))
    return pit.additions_only(_days(spark, sf_dir), members)


@query
def pit_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pit_date_added(spark, sf_dir)
    return _rounded(pit.mask(_days(spark, sf_dir).withColumnRenamed("close", "value"), m))


@query
def pit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pit.coverage(_days(spark, sf_dir), "close"))


def _constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's members: suppliers by a rule, with a sector for most and the date of their first order line as date_added for most."""
    first = market.lineitem_bars(spark, sf_dir).groupBy("ticker").agg(F.min("date").alias("first"))
    s = market.supplier_industry(spark, sf_dir).filter("ticker % 3 = 0").join(first, "ticker", "left")
    return s.select("ticker", F.when(F.col("ticker") % 7 != 0, F.col("industry")).alias("sector"), F.when(F.col("ticker") % 5 != 0, F.date_add("first", (F.col("ticker") % 11 * 40).cast("int"))).alias("date_added"))


def _universe(spark: SparkSession, sf_dir: str, log: bool) -> pit.Universe:
    changes = _changes(spark, sf_dir)
    return pit.universe(market.lineitem_bars(spark, sf_dir).select("date").distinct(), _constituents(spark, sf_dir), changes if log else changes.limit(0))


@query
def pit_universe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir, True).membership


@query
def pit_universe_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir, False).membership


@query
def pit_universe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each basis, with the coverage of member cells."""
    out, changes = None, _changes(spark, sf_dir)
    for log in (changes, None):
        row = pit.context(_days(spark, sf_dir), _constituents(spark, sf_dir), log)[2]
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


@query
def pit_universe_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.context(_days(spark, sf_dir), _constituents(spark, sf_dir), _changes(spark, sf_dir))[0]


# ---- contracts of inputs

@query
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw rows: repeats, missing keys, infinite unit prices, an order of arrival, and the weekly bars' keys as reference."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber <= 2")
    raw = lines.select(F.when(F.col("l_partkey") % 50 != 0, F.col("l_suppkey").cast("long")).alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.when(F.col("l_quantity") == 7, float("inf")).when(F.col("l_quantity") == 9, float("nan")).otherwise(F.col("l_extendedprice")).alias("price"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return contracts.violations(raw, ("price",), _bars(spark, sf_dir), "seq")


@query
def contract_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors over the bars' own dates against the dense panel."""
    b = _bars(spark, sf_dir)
    f = b.select("date", "ticker", F.lit("close").alias("factor")).unionByName(b.filter("ticker % 2 = 0").select(F.date_add("date", 1).alias("date"), "ticker", F.lit("late").alias("factor"))).unionByName(b.filter("volume > 50").select("date", "ticker", F.lit("close").alias("factor")))
    return contracts.factor_alignment(f, market.densify(b))


@query
def contract_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.feasibility(_factors(spark, sf_dir)[1], 0.2, 0.1)


# ---- evaluation

def _factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel, and four formulas as long factors."""
    p = market.panel(spark, sf_dir)
    return p, ev.unpivot(formula.evaluate(p, formula.DEFAULTS), tuple(formula.DEFAULTS))


def _wide(spark: SparkSession, sf_dir: str, formulas: dict[str, str] = formula.DEFAULTS) -> ev.Wide:
    """The panel's rows with a column a formula."""
    rows = market.line_count(spark, sf_dir)
    return ev.Wide(formula.evaluate(market.panel(spark, sf_dir), formulas, ("close", "returns"), rows, "ticker"), {n: n for n in formulas}, rows=rows)


def _ics(spark: SparkSession, sf_dir: str, method: str = "spearman", horizons: tuple[int, ...] = (1,)) -> DataFrame:
    return _wide(spark, sf_dir).ic(horizons, method, NAMES)


@query
def ic_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ics(spark, sf_dir))


@query
def ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ics(spark, sf_dir, "pearson"), 5)


@query
def ic_horizon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ics(spark, sf_dir, horizons=HORIZONS).groupBy("factor", "horizon").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n")))


@query
def ic_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _factors(spark, sf_dir)
    return _rounded(ev.ic(f, ev.sanitize_returns(ev.forward_returns(p), most=5.0), "pearson", 20), 5)


@query
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.ic_summary(_ics(spark, sf_dir), 52.0))


@query
def ic_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.ic_t_test(_ics(spark, sf_dir)).drop("p", "significant", "ci_lower", "ci_upper"))


@query
def ic_t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.ic_t_test(_ics(spark, sf_dir)))


def _groups(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    p, f = _factors(spark, sf_dir)
    return ev.quantile_groups(f, ev.forward_returns(p, horizons), 5, NAMES)


@query
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.quantile_returns(_groups(spark, sf_dir)), 5)


@query
def stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.stratification(_groups(spark, sf_dir)), 5)


@query
def group_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _factors(spark, sf_dir)
    fwd = ev.forward_returns(p, (5,)).withColumn("fwd", F.col("fwd") / 1000)
    return _rounded(ev.group_backtest(ev.quantile_groups(f, fwd, 5, NAMES), p, 5, 52.0), 5)


@query
def regime_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.ic_by_label(_ics(spark, sf_dir), F.year("date").cast("string")))


@query
def regime_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = ev.span_label(F.col("date"), ("1994-01-01", "1996-07-01"), ("early", "middle", "late"))
    return _rounded(ev.ic_by_label(_ics(spark, sf_dir), label))


@query
def regime_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.stability(ev.ic_by_label(_ics(spark, sf_dir), F.year("date").cast("string"))))


@query
def rank_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _factors(spark, sf_dir)
    return _rounded(ev.rank_turnover(f, p, 5, NAMES))


@query
def factor_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _wide(spark, sf_dir)
    wide = ev.Wide(keep(made.df), made.names)
    f = wide.long()
    cover = f.groupBy("factor").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    card = ev.factor_scorecard(keep(wide.ic((5,), "spearman", NAMES)), wide.ic((5,), "pearson", NAMES), ev.stratification(wide.groups(5, 5, NAMES)), ev.rank_turnover(f, wide.df, 5, NAMES), cover, 52.0)
    return _rounded(card, 5)


# ---- selection

@query
def corr_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.value_correlation(None, NAMES, 60, _wide(spark, sf_dir)))


@query
def corr_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.ic_correlation(_ics(spark, sf_dir)))


@query
def corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas are nodes wherever the panel has a row; so the panel isn't made for their names."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0 and l_shipdate is not null").limit(1)
    names = lines.select(F.explode(F.array(*map(F.lit, formula.DEFAULTS))).alias("factor"))
    return sel.clusters(keep(names), keep(sel.value_correlation(None, NAMES, 60, _wide(spark, sf_dir))), 0.5)


@query
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.purged_folds(market.panel(spark, sf_dir), 100, 50, 50, 5, embargo=2)


@query
def fold_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.label_overlaps(folds(spark, sf_dir), 5)


@query
def fold_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ics(spark, sf_dir).join(folds(spark, sf_dir).select("date", "fold", "role"), "date")
    return _rounded(rows.groupBy("fold", "role", "factor").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n")))


@query
def select_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.stable_factors(_ics(spark, sf_dir)))


#: Two more formulas, near copies of default ones, so that there is something to find redundant.
CANDIDATES = formula.DEFAULTS | {"reversal_6": "-delta(close, 6) / delay(close, 6)", "intraday_2": "(close - open) / ((high - low) + 0.002)"}
RULES = redundancy.Rules(min_names=NAMES, hard=0.5, min_factors=2, max_factors=3, cap=0.5)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[ev.Wide, DataFrame, DataFrame, DataFrame]:
    """factors, ics (of five rows), the folds' training rows, and two pools: the default formulas, and all."""
    made = _wide(spark, sf_dir, CANDIDATES)
    wide = ev.Wide(keep(made.df.withColumn("_ahead", ev.forward(5))), made.names, {5: "_ahead"}, made.rows)  # where rows go by ticker anyway
    ics = keep(wide.ic((5,), min_names=NAMES))
    train = sel.purged_folds(wide.df, 100, 50, 50, 5).filter("role = 'train'")
    pools = spark.createDataFrame([("base", n) for n in formula.DEFAULTS] + [("wide", n) for n in CANDIDATES], "pool string, factor string")
    return wide, ics, train, pools


def _selection(spark: SparkSession, sf_dir: str) -> redundancy.Selection:
    wide, ics, train, pools = _candidates(spark, sf_dir)
    return redundancy.correlation_aware(wide.long(), ics, train, pools, RULES, wide=wide)


@query
def select_corr_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate, quality and weight of each candidate, in each pool and fold."""
    found = _selection(spark, sf_dir)
    return _rounded(found.diagnostics.join(found.selected.drop("direction"), ["pool", "fold", "factor"], "left"))


@query
def select_corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).clusters


@query
def select_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_selection(spark, sf_dir).value_correlation)


ABLATION = ablation.Ablation(experiment.WalkForward(5, 100, 50, 50, min_names=NAMES, cost_bps=(0.0, 10.0)), RULES, max_exposure=0.5)


def _ablation(spark: SparkSession, sf_dir: str) -> tuple[ablation.Arms, dict[str, DataFrame]]:
    """The default formulas against these with two near copies; returns are scaled down, as the unit prices are random."""
    rows, h, industry = market.line_count(spark, sf_dir), ABLATION.walk.horizon, market.supplier_industry(spark, sf_dir)
    p = market.panel(spark, sf_dir).withColumn("returns", F.col("returns") / 1000)
    made = formula.evaluate(p, CANDIDATES, ("close", "returns"), rows, "ticker").withColumn("_ahead", ev.forward(h)).drop("close").join(industry, "ticker", "left")  # where rows go by ticker anyway
    wide = ev.Wide(keep(made), {n: n for n in CANDIDATES}, {h: "_ahead"}, rows)
    factors, known = wide.long(), F.col("factor").isin(*formula.DEFAULTS)
    arms = ablation.run_arms(wide.df, factors.filter(known), factors.filter(~known), industry, ABLATION, wide)
    return arms, ablation.report(arms, wide.df, industry, ABLATION)


@query
def ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ablation(spark, sf_dir)[1]["ablation_metrics"], 5)


@query
def ablation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each arm does in each fold; in an invalid one the last valid targets are held."""
    _, tables = _ablation(spark, sf_dir)
    return _rounded(tables["fold_metrics"].join(tables["fold_diagnostics"], ["arm", "fold"]), 5)


@query
def ablation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ablation.gates(*_ablation(spark, sf_dir), ABLATION), 5)


def _oos(spark: SparkSession, sf_dir: str) -> oos.Report:
    """The report of the walk-forward run over the default formulas; what it may save is measured against a yearly cost of 30 %."""
    p, h = market.panel(spark, sf_dir).withColumn("returns", F.col("returns") / 1000), ABLATION.walk.horizon
    industry = market.supplier_industry(spark, sf_dir)
    made = formula.evaluate(p, formula.DEFAULTS, ("close", "returns")).withColumn("_ahead", ev.forward(h)).join(industry, "ticker", "left")  # where rows go by ticker anyway
    wide = ev.Wide(keep(made), {n: n for n in formula.DEFAULTS}, {h: "_ahead"})
    return oos.report(experiment.walk_forward(wide.df, wide.long(), industry, ABLATION.walk, wide), wide.df, industry, ABLATION.walk, baseline_annual_cost=0.3)


@query
def oos_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_oos(spark, sf_dir).tables["portfolio_scorecard"], 5)


@query
def oos_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_oos(spark, sf_dir).tables["year_metrics"], 5)


@query
def oos_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_oos(spark, sf_dir).tables["industry_exposure"], 5)


@query
def oos_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_oos(spark, sf_dir).gates, 5)


def _variants(spark: SparkSession, sf_dir: str) -> oos.Report:
    """The reversal against its neutral form; a name may have a tenth of a side, which thin dates break."""
    f, rules = Frame(market.panel(spark, sf_dir)), oos.Experiment(max_weight=0.1)
    v = _reversal(f).alias("value")
    rows = f.df.select("date", "pos", "ticker", v, (F.col("returns") / 1000).alias("returns"), ev.forward(rules.horizon).alias("fwd"))
    known = market.supplier_industry(spark, sf_dir).withColumn("_known", F.lit(True))
    rows = rows.join(known, "ticker", "left").withColumn("value", F.when(F.col("_known"), F.col("value"))).drop("_known")  # as ``_signal``, names of no supplier have no value
    return oos.variants(rows, None, None, rules)


@query
def experiment_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _variants(spark, sf_dir).tables
    return _rounded(tables["factor_diagnostics"].join(tables["portfolio_metrics"], "variant"), 5)


@query
def experiment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_variants(spark, sf_dir).gates, 5)


@query
def xs_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest absolute mean of an industry on each date, before it is neutralised away."""
    return _rounded(oos.max_group_mean(xs.standardize(_signal(spark, sf_dir)).drop("industry"), market.supplier_industry(spark, sf_dir)))


WEIGHTS = {"reversal_5": (1, 0.5), "volatility_20": (-1, 0.3), "volume_price": (1, 0.2)}


@query
def compose_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = formula.evaluate(market.panel(spark, sf_dir), formula.DEFAULTS)
    return wide.select("date", "ticker", *WEIGHTS).transform(lambda t: sel.mix(t, {n: d * w for n, (d, w) in WEIGHTS.items()})).select("date", "ticker", _r("mix", 4).alias("mix"))


@query
def compose_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.composite(_factors(spark, sf_dir)[1], WEIGHTS), 5)


# ---- portfolio

@query
def pf_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.long_short(_signal(spark, sf_dir)))


@query
def pf_long_short_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.long_short(_signal(spark, sf_dir), by="industry"))


def _targets(spark: SparkSession, sf_dir: str, every: int = 5) -> tuple[DataFrame, DataFrame]:
    s = _signal(spark, sf_dir)
    return s, pf.buffered_targets(s, every=every)


@query
def pf_buffered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_targets(spark, sf_dir)[1])


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel (returns scaled down, as the unit prices are random) and its executed weights."""
    s = _signal(spark, sf_dir)
    t = pf.buffered_targets(s.withColumn("returns", F.col("returns") / 1000), every=5, also=("returns",))
    return s, pf.executed_targets(t)


@query
def pf_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.simulate(_moves(spark, sf_dir)[1]))


@query
def pf_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.drawdowns(pf.simulate(_moves(spark, sf_dir)[1])).select("date", "pos", "wealth", "drawdown"), 5)


@query
def pf_cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pf.simulate(_moves(spark, sf_dir)[1], (0.0, 5.0, 10.0, 20.0))
    return _rounded(pf.performance(d).select("cost_bps", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown"), 5)


@query
def pf_sortino_calmar_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.performance(pf.simulate(_moves(spark, sf_dir)[1])).select("cost_bps", "sortino", "calmar", "win_rate", "n"), 5)


@query
def subperiod_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pf.simulate(_moves(spark, sf_dir)[1]).withColumn("label", F.year("date").cast("string"))
    return _rounded(pf.performance(d, by=("label",)).select("label", "annualized_return", "annualized_volatility", "sharpe"), 5)


AUM = (1e6, 1e7, 1e8)


@query
def pf_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = _moves(spark, sf_dir)
    parts = pf.participation(m, s, (1e7,))  # of illiquid trades infinite: here null, as the flag says it
    return _rounded(parts.select("date", "ticker", "illiquid", F.when(~F.col("illiquid"), F.col("participation")).alias("participation")), 5)


@query
def pf_liquidity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = _moves(spark, sf_dir)
    c = pf.liquidity_costs(pf.participation(m, s, AUM))
    return _rounded(c.groupBy("aum", "date").agg(F.sum("cost").alias("cost")))


@query
def pf_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = _moves(spark, sf_dir)
    rows = pf.capacity(pf.participation(m, s, AUM))
    unbounded = F.coalesce(F.col("max_participation") == float("inf"), F.lit(False))
    return _rounded(rows.withColumns({"unbounded": unbounded, "max_participation": F.when(~unbounded, F.col("max_participation"))}), 5)


@query
def pf_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.exposure(_targets(spark, sf_dir)[1], market.supplier_industry(spark, sf_dir)))


@query
def pf_max_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pf.max_exposure(pf.exposure(_targets(spark, sf_dir)[1], market.supplier_industry(spark, sf_dir))))


@query
def pf_rebalance_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = None, keep(_signal(spark, sf_dir).select("date", "pos", "ticker", "value", (F.col("returns") / 1000).alias("returns")))
    for every in (5, 10, 21, 42):
        d = pf.simulate(pf.executed_targets(pf.buffered_targets(s, every=every, also=("returns",))))
        row = d.groupBy().agg(F.lit(every).alias("every"), F.avg("turnover").alias("average_turnover"), F.avg("net").alias("mean_net"))
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


# ---- statistics

def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up p-values, one a part brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy(F.col("p_brand").alias("name")).agg((F.avg("p_retailprice") % 97 / 970).alias("p"))


@query
def stat_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.bonferroni(_tests(spark, sf_dir)))


@query
def stat_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.benjamini_hochberg(_tests(spark, sf_dir)))


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """i (0-based row of the dates that any IC has), factor, horizon, ic; and how many rows there are."""
    ics = keep(_ics(spark, sf_dir, horizons=HORIZONS))
    days = ics.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    return keep(ics.join(days, "date").select("i", "factor", "horizon", "ic")), max(1, days.count())


BLOCKS = {h: st.block_length(h) for h in HORIZONS}


@query
def stat_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.grid_null(*_numbered(spark, sf_dir), BLOCKS, 200, draws="hash"))


@query
def stat_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics, n = _numbered(spark, sf_dir)
    return _rounded(st.evidence(ics, keep(st.grid_null(ics, n, BLOCKS, 200, draws="hash")), BLOCKS))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.lineitem_bars(spark, sf_dir)


@query
def stat_outlier_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.iqr_outliers(_bars(spark, sf_dir), "close", "ticker").select("date", "ticker", "outlier")


@query
def stat_outlier_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.z_outliers(_bars(spark, sf_dir), "close", "ticker", 2.0).select("date", "ticker", "outlier")


@query
def stat_outlier_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.density_outliers(_bars(spark, sf_dir), "close", "ticker", 0.05, 5).select("date", "ticker", "outlier")


# ---- data quality

@query
def dq_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.scores(_bars(spark, sf_dir), 357, "1998-12-15", 14.0), 5)


@query
def dq_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_days(market.lineitem_bars(spark, sf_dir, "day"), "1996-01-01", "1997-12-31")


@query
def dq_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.lineitem_bars(spark, sf_dir, "day")
    return quality.completeness(b.withColumn("volume", F.when(F.col("volume") < 45, F.col("volume"))), "1996-01-01", "1997-12-31", 20)


@query
def dq_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with holes in the volume against their repair, which lacks some tickers and has some that were held back before."""
    holes = _bars(spark, sf_dir).withColumn("volume", F.when(F.col("volume") >= 20, F.col("volume")).otherwise(0.0))
    score = lambda df: quality.scores(df, 357, "1998-12-15", 14.0)
    return _rounded(quality.compare(score(holes.filter("ticker % 10 <> 3")), score(quality.repair_volume(holes).filter("ticker % 10 <> 4"))), 5)


@query
def dq_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alerts(quality.scores(_bars(spark, sf_dir), 357, "1998-12-15", 14.0), 100.0)


@query
def dq_alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alert_counts(dq_alerts(spark, sf_dir))


@query
def dq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps(_bars(spark, sf_dir), 14)


@query
def dq_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    return _rounded(quality.mean_differences(b, quality.clip_outliers(b, k=0.5)), 4)


@query
def clean_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = _bars(spark, sf_dir).withColumns({"high": F.col("open"), "low": F.col("close")})
    return _rounded(quality.repair_ohlc(swapped))


@query
def clean_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = _bars(spark, sf_dir).withColumn("volume", F.when(F.col("volume") >= 20, F.col("volume")).otherwise(0.0))
    return _rounded(quality.repair_volume(holes).select("date", "ticker", "volume"))


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.densify(_bars(spark, sf_dir)).drop("pos")


@query
def clean_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.fill(_holes(spark, sf_dir)).select("date", "ticker", "close", "volume"))


@query
def clean_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.fill(_holes(spark, sf_dir), ("close",), "interpolate").select("date", "ticker", "close"), 4)


@query
def clean_winsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.clip_outliers(_bars(spark, sf_dir), ("close", "volume"), k=0.5).select("date", "ticker", "close", "volume"), 5)


@query
def clean_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.fill_calendar(_bars(spark, sf_dir)).select("date", "ticker", "close"))


@query
def clean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers whose last bar is older than the given day are moved up to it; others stay."""
    return _rounded(quality.shift_dates(_bars(spark, sf_dir), "1998-11-25").select("date", "ticker", "close"))


@query
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines taken as raw bars with repeats: the last of a supplier's week, by a total order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0")
    raw = lines.select(F.col("l_suppkey").cast("long").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("open"), F.col("l_extendedprice").alias("high"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("low"), (F.col("l_extendedprice") * 0.97).alias("close"), (F.col("l_quantity") - 10).cast("double").alias("volume"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return _rounded(market.sanitize(raw), 4)


@query
def panel_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.load_metadata(_bars(spark, sf_dir))
