"""Experiments: a formula's validation, and walk-forward selection out of sample. Each is a set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.operators import crosssection as xs
from factorloom.operators import evaluation as ev
from factorloom.operators import portfolio as pf
from factorloom.operators import redundancy as rd
from factorloom.operators import selection as sel
from factorloom.operators import statistics as st
from factorloom.plans import formula
from factorloom.sources.shared import deal, keep


@dataclass(frozen=True)
class WalkForward:
    """Sizes of the folds and rules of selection and trading; checked when made."""

    horizon: int = 5
    min_train: int = 100
    test_size: int = 50
    step: int = 50
    embargo: int = 0
    min_names: int = 30
    every: int = 5
    min_abs_ic: float = 0.005
    weight_cap: float = 0.5
    cost_bps: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0)
    soft_strength: float = 0.5
    entry: float = 0.20
    exit_: float = 0.30
    name_cap: float | None = None

    def __post_init__(self) -> None:
        if min(self.horizon, self.min_train, self.test_size, self.step, self.every, self.min_names) < 1 or self.embargo < 0:
            raise ValueError("sizes are positive")
        if not 0 < self.weight_cap <= 1 or not self.cost_bps or min(self.cost_bps) < 0:
            raise ValueError("the cap is within (0, 1] and costs aren't negative")
        if self.step + self.embargo < self.test_size:
            raise ValueError("the folds' test dates overlap")

    def rules(self) -> rd.Rules:
        """The gates of stability; those of coverage and redundancy aren't used with them."""
        return rd.Rules(min_abs_ic=self.min_abs_ic, min_names=self.min_names, every=self.every)

    @classmethod
    def from_yaml(cls, text: str) -> WalkForward:
        import yaml

        given = yaml.safe_load(text) or {}
        if "cost_bps" in given:
            given["cost_bps"] = tuple(map(float, given["cost_bps"]))
        return cls(**given)


@dataclass
class Result:
    """Tables and gates; a walk-forward run has its trades too."""

    tables: dict[str, DataFrame]
    gates: dict[str, bool] = field(default_factory=dict)
    trades: Trades | None = None


def validate_formula(panel: DataFrame, text: str, horizons: tuple[int, ...] = formula.HORIZONS, min_names: int = 30, boot: int = 200, industry: DataFrame | None = None, membership: DataFrame | None = None, benchmarks: dict[str, str] = formula.BENCHMARKS) -> Result:
    """Everything about one formula: ICs, evidence, groups, turnover, portfolio, costs and periods; neutral too if industries are given.

    The benchmark formulas take part in the evidence only, where a verdict is by the largest statistic of all.
    """
    from factorloom.operators import pit

    values = formula.evaluate(panel, {"value": text})
    if membership is not None:
        values = pit.mask(values, membership)
    values = xs.standardize(values).select("date", "ticker", F.lit("formula").alias("factor"), "value")
    if industry is not None:
        neutral = xs.neutralize(values.join(industry, "ticker"), min_names=min_names)
        values = values.unionByName(neutral.select("date", "ticker", F.lit("neutral").alias("factor"), "value"))
    fwd = ev.forward_returns(panel, horizons)
    ics = keep(ev.ic(values, fwd, min_names=min_names))  # every table below starts from it
    groups = ev.quantile_groups(values, fwd, 5, min_names)
    days = ics.select("date").distinct()
    numbered = days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = numbered.count()
    out = {"ic": ics, "summary": ev.ic_summary(ics), "t_test": ev.ic_t_test(ics), "groups": ev.stratification(groups), "turnover": ev.rank_turnover(values, panel, 5, min_names), "years": ev.ic_by_label(ics, F.year("date").cast("string"))}
    if n:
        others = ev.ic(ev.unpivot(formula.evaluate(panel, benchmarks), tuple(benchmarks)), fwd, min_names=min_names) if benchmarks else ics.limit(0)
        grid = keep(ics.unionByName(others).join(numbered, "date").select("i", "factor", "horizon", "ic"))
        blocks = {h: st.block_length(h) for h in horizons}
        out["evidence"] = st.evidence(grid, keep(st.grid_null(grid, n, blocks, boot)), blocks).orderBy("p_global", F.col("z").desc())
    scored = values.filter("factor = 'formula'").join(panel.select("date", "pos", "ticker", "returns", "adv20"), ["date", "ticker"])
    moves = pf.executed(pf.buffered_targets(scored), scored)
    out |= {"performance": pf.performance(pf.simulate(moves, (0.0, 10.0))), "capacity": pf.capacity(pf.participation(moves, scored, (1e6, 1e7, 1e8)))}
    return Result(out)


PATHS = ("raw", "soft", "strict")


@dataclass
class Trades:
    """Out-of-sample tables of each pool and path; pos counts the test rows from 1. scores, targets and moves have a row for every name on every test row; they are made only if they are read.

    ics (pool, date, factor: the path, horizon, n, ic) are the scores' own, exposures (pool, path, date, industry, exposure) net weights of the known industries.
    """

    scores: DataFrame
    targets: DataFrame
    moves: DataFrame
    daily: DataFrame
    ics: DataFrame
    exposures: DataFrame


def _composite(wide: ev.Wide, days: DataFrame, weights: DataFrame, pools: tuple[str, ...]) -> DataFrame:
    """The rows of the days with a column for each pool (``_y`` and its number): the weighted mean of the date's standardised factors by the frozen weights of its fold.

    Means and deviations of a date and weights of a fold are small tables that are broadcast: no row is shuffled.
    """
    c = list(wide.names.values())
    some = F.broadcast(days.select("date"))
    stats = wide.df.join(some, "date").groupBy("date").agg(F.count("*").alias("_n"), *(f(x).alias(n + x) for x in c for n, f in (("_m", F.avg), ("_s", F.stddev_pop))))
    of = lambda p, n, v: F.max(F.when((F.col("pool") == p) & (F.col("factor") == n), v))
    each = [(i, p, n, x) for i, p in enumerate(pools) for n, x in wide.names.items()]
    frozen = weights.groupBy("fold").agg(F.count("*").alias("_k"), *(of(p, n, F.col("direction") * F.col("weight")).alias(f"_d{i}{x}") for i, p, n, x in each), *(of(p, n, F.col("weight")).alias(f"_w{i}{x}") for i, p, n, x in each))
    known = keep(days.join(stats, "date").join(frozen, "fold", "left"))  # a row a date
    rows = wide.df.drop("pos").join(F.broadcast(known), "date").withColumns({"_z" + x: F.try_divide(F.col(x) - F.col("_m" + x), F.col("_s" + x)) for x in c})
    none = F.lit(0.0)

    def value(i: int) -> Column:
        part = {x: F.col("_z" + x) * F.col(f"_d{i}{x}") for x in c}
        top, size = sum((F.coalesce(p, none) for p in part.values()), none), sum((F.when(p.isNotNull(), F.col(f"_w{i}{x}")).otherwise(none) for x, p in part.items()), none)
        return F.try_divide(top, size)

    return rows.withColumns({f"_y{i}": value(i) for i in range(len(pools))})


def _judged(rows: DataFrame, pools: tuple[str, ...], spec: WalkForward, size: int | None) -> DataFrame:
    """date, due, i (numbers a pool's path), n and ic of its scores, and on due dates the marks of scores that vary (``pf.marks``). A task holds the names of one date.

    A score is ``_y`` less the path's part of ``_m``; it isn't standardised, as that changes no rank.
    """
    types, parts = dict(rows.dtypes), (0.0, spec.soft_strength, 1.0)
    name = f"struct<x: double, t: {types['ticker']}>"
    schema = f"date {types['date']}, due boolean, i int, n long, ic double, marks struct<{', '.join(f'{m}: {name}' for m in pf.MARKS)}>"

    def one(key: tuple, t: pa.Table) -> pa.Table:
        fwd, out = ev.column(t, "fwd"), []
        for i in range(len(pools)):
            y, m = ev.column(t, f"_y{i}"), ev.column(t, f"_m{i}")
            known = ~(np.isnan(y) | np.isnan(m))
            y, m, f, tickers = y[known], m[known], fwd[known], t.column("ticker").filter(pa.array(known))
            both = ~np.isnan(f)
            n, ok = int(both.sum()), len(y) >= spec.min_names and (y - m).std() > xs.TINY
            for k, part in enumerate(parts):
                x = y - part * m
                varies = ok and x.std() > xs.TINY
                ic = ev.correlation(ev.mean_ranks(x[both]), ev.mean_ranks(f[both])) if varies and n >= spec.min_names else None
                out.append((i * len(parts) + k, n, ic, pf.marks(x, tickers, spec.entry, spec.exit_) if varies and key[1].as_py() else None))
        mark = pa.struct([("x", pa.float64()), ("t", t.schema.field("ticker").type)])
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.struct([(m, mark) for m in pf.MARKS]))
        return pa.table({"date": pa.array([key[0].as_py()] * len(out), key[0].type), "due": pa.array([key[1].as_py()] * len(out), pa.bool_())} | {c: pa.array([r[j] for r in out], kinds[j]) for j, c in enumerate(("i", "n", "ic", "marks"))})

    sent = [c for i in range(len(pools)) for c in (f"_y{i}", f"_m{i}")]
    return deal(rows.select("date", "due", "ticker", "fwd", *sent), size, "date").groupBy("date", "due").applyInArrow(one, schema)


def trade(panel: DataFrame, factors: DataFrame, industry: DataFrame, folds: DataFrame, weights: DataFrame, pools: tuple[str, ...], spec: WalkForward, wide: ev.Wide | None = None) -> Trades:
    """Scores of the folds' frozen weights (pool, fold, factor, direction, weight) on their test rows, three paths of them, and their portfolios.

    All pools, folds and paths are one job. A fold without weights has no scores, so its portfolios hold what they have.
    ``wide`` are the factors as columns of the panel's rows, made of the long ones and kept if it isn't given. Pools and paths are columns too: the test rows
    go by date once, which leaves ICs and the marks of the portfolios, and by ticker once, which leaves what rows that hold alike sum to.
    """
    pf.check_buffer(spec.every, spec.entry, spec.exit_)
    wide = ev.Wide.of(panel, factors).kept() if wide is None else wide
    by = ("pool", "path")
    test = folds.filter("role = 'test'").select("fold", "date")
    days = keep(test.withColumn("pos", F.row_number().over(Window.orderBy("date"))))  # a row a date
    mine = ["industry"] if "industry" in wide.df.columns else []  # of each row already, so that rows need no join
    ahead = ev.Wide(wide.df.select("date", "pos", "ticker", "returns", *wide.names.values(), (wide.forward(spec.horizon) if spec.horizon in wide.ahead or "close" in wide.df.columns else F.lit(None).cast("double")).alias("fwd"), *mine), wide.names)
    y, m = ([f"_{c}{i}" for i in range(len(pools))] for c in "ym")
    rows = _composite(ahead, days, weights, pools)
    rows = (rows if mine else rows.join(industry, "ticker", "left")).select("date", "pos", "ticker", "returns", "industry", "fwd", *y)
    each = F.inline(F.array(*(F.struct(F.lit(p).alias("pool"), F.col(c).alias("value")) for p, c in zip(pools, y, strict=True))))
    scores = xs.industry_variants(rows.select("*", each), strength=spec.soft_strength, min_names=spec.min_names, by=("pool",), also=("pos", "returns")).unpivot(["pool", "date", "pos", "ticker", "returns"], list(PATHS), "path", "value")
    means = keep(rows.filter("industry is not null").groupBy("date", "industry").agg(*(F.avg(c).alias(d) for c, d in zip(y, m, strict=True))))  # a row a date and industry
    rows = rows.join(F.broadcast(means), ["date", "industry"], "left").withColumn("due", (F.col("pos") - 1) % spec.every == 0)
    judged = keep(_judged(rows, pools, spec, wide.rows))  # a row a date, pool and path
    marks = judged.filter("due").groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "marks"))), lambda x: x["marks"]).alias("marks"))
    values = F.array(*(F.col(c) - part * F.col(d) for c, d in zip(y, m, strict=True) for part in (0.0, spec.soft_strength, 1.0)))
    zones = F.zip_with(values, "marks", lambda x, k: pf.zone(x, F.col("ticker"), k))
    placed = rows.join(F.broadcast(marks), "date", "left").select("date", "pos", "ticker", "industry", "due", F.coalesce("returns", F.lit(0.0)).alias("ret"), zones.alias("zones"))
    held = pf.held(deal(placed, wide.rows, "ticker"), len(pools) * len(PATHS))
    kinds = keep(held.groupBy("i", "date", "pos", "industry", "now", "last", "before").agg(F.count("*").alias("n"), F.sum("ret").alias("ret")))  # a row for what is held alike
    of = lambda texts, i: F.element_at(F.array(*map(F.lit, texts)), (i + 1).cast("int"))
    group = (of(pools, F.floor(F.col("i") / len(PATHS))).alias("pool"), of(PATHS, F.col("i") % len(PATHS)).alias("path"))
    w = pf.held_weights(kinds, spec.name_cap)
    now, moved = pf.weighed(held, w, "now"), pf.weighed(held, w, "last", "before")
    action = F.when(~F.col("due"), "hold_schedule").when(F.col("zone").isNull(), "hold_invalid").otherwise("rebalance")
    targets = now.select(*group, "date", "pos", "ticker", F.col("w_now").alias("w"), action.alias("action"))
    change = F.col("w_last") - F.col("w_before")
    moves = moved.select(*group, "date", "pos", "ticker", "ret", F.col("w_last").alias("w"), change.alias("dw"))
    sums = pf.weighed(kinds, w, "last", "before").groupBy(*group, "date", "pos", "industry").agg(F.sum(F.col("w_last") * F.col("ret")).alias("gross"), F.sum(F.abs(change) * F.col("n")).alias("turnover"), F.sum(F.col("w_last") * F.col("n")).alias("exposure"))
    daily = keep(pf.costed(sums.groupBy(*by, "date", "pos").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover")), spec.cost_bps))
    ics = judged.filter("ic is not null").select(group[0], "date", group[1].alias("factor"), F.lit(spec.horizon).alias("horizon"), "n", "ic")
    return Trades(scores, targets, moves, daily, ics, sums.filter("industry is not null").select(*by, "date", "industry", "exposure"))


def walk_forward(panel: DataFrame, factors: DataFrame, industry: DataFrame, spec: WalkForward, wide: ev.Wide | None = None) -> Result:
    """Out-of-sample scores and portfolios: each fold selects and weighs factors by its training dates only.

    ICs don't depend on the fold: they are made once. All folds select in one job over them, and trade in one more.
    """
    folds = keep(sel.purged_folds(panel, spec.min_train, spec.test_size, spec.step, spec.horizon, embargo=spec.embargo))
    wide = ev.Wide.of(panel, factors).kept() if wide is None else wide
    ics = keep(wide.ic((spec.horizon,), min_names=spec.min_names))
    pools = factors.select(F.lit("all").alias("pool"), "factor").distinct()
    evidence = keep(rd.fold_evidence(factors, ics, folds.filter("role = 'train'"), spec.rules()))
    weights = keep(rd.stable_selection(evidence, pools, spec.weight_cap))
    t = trade(panel, factors, industry, folds, weights, ("all",), spec, wide)
    overlaps = sel.label_overlaps(folds, spec.horizon)
    picked = evidence.select("fold", "factor", "direction", "full_ic", "recent_ic", "robust_ic", "agreeing_blocks", F.col("stable").alias("eligible"))
    tables = {"folds": folds, "overlaps": overlaps, "selection": picked, "weights": weights.drop("pool"), "scores": t.scores.select("date", "ticker", "path", "value"), "daily": t.daily.drop("pool"), "performance": pf.performance(t.daily, by=("path", "cost_bps"))}
    selects = folds.select("fold").distinct().join(weights, "fold", "left_anti").isEmpty()
    return Result(tables, {"no_label_overlap": overlaps.filter("overlaps > 0").isEmpty(), "every_fold_selects": selects}, t)
