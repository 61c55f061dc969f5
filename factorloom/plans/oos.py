"""The out-of-sample report of a walk-forward run, and the experiment of a factor's raw and neutral variant: tables, gates, files.

All paths, folds and costs of a report are groups of one table of daily returns, and all ICs one table. Only gates and what is
written as a report come to the driver: a row a gate, path, fold, year or cost.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom import reports
from factorloom.operators import crosssection as xs
from factorloom.operators import evaluation as ev
from factorloom.operators import portfolio as pf
from factorloom.operators import selection as sel
from factorloom.plans.ablation import oos_gates, returns_of
from factorloom.plans.experiment import Result, WalkForward
from factorloom.sources.shared import keep

#: The tables that are as long as the period has dates; the others are small.
LONG = ("industry_exposure",)


@dataclass
class Report:
    tables: dict[str, DataFrame]
    gates: DataFrame
    quality: dict[str, float | int | None]


def exposures(moves: DataFrame, industry: DataFrame) -> DataFrame:
    """path, date, industry, exposure, max_abs_industry: net weights of each industry, and the date's largest."""
    rows = moves.join(industry.filter("industry is not null"), "ticker").groupBy("path", "date", "industry").agg(F.sum("w").alias("exposure"))
    return rows.withColumn("max_abs_industry", F.max(F.abs("exposure")).over(Window.partitionBy("path", "date")))


def scorecard(daily: DataFrame, ics: DataFrame, exposure: DataFrame) -> DataFrame:
    """A row for each path: returns, risk, drawdown, costs, how steady the sign of the yearly IC is, mean largest exposure. ``daily`` is at one cost; ICs have the path as their factor."""
    used = daily.groupBy("path").agg(F.avg("turnover").alias("average_turnover"), F.sum(F.col("turnover") * F.col("cost_bps") / 10_000).alias("total_cost"))
    years = ev.ic_by_label(ics, F.year("date").cast("string"))
    steady = ev.stability(years).select(F.col("factor").alias("path"), F.col("consistency").alias("regime_consistency"))
    count = years.groupBy(F.col("factor").alias("path")).agg(F.count("*").alias("n_subperiods"))
    largest = exposure.select("path", "date", "max_abs_industry").distinct().groupBy("path").agg(F.avg("max_abs_industry").alias("industry_exposure"))
    rows = pf.performance(daily, by=("path",)).drop("n").join(used, "path")
    return rows.join(steady, "path", "left").join(count, "path", "left").join(largest, "path", "left").withColumn("n_subperiods", F.coalesce("n_subperiods", F.lit(0).cast("long")))


def gate_rows(spark, gates: dict[str, tuple[float | None, float, bool]]) -> DataFrame:
    """gate, value, bound, passed."""
    number = lambda x: None if x is None or x != x else float(x)
    return spark.createDataFrame([(k, number(v), number(b), ok) for k, (v, b, ok) in gates.items()], "gate string, value double, bound double, passed boolean")


def report(result: Result, panel: DataFrame, industry: DataFrame, spec: WalkForward, baseline_annual_cost: float, cost_bps: float = 10.0, adv: DataFrame | None = None, aum: tuple[float, ...] = (1e6, 1e7, 1e8, 1e9), groups: int = 5) -> Report:
    """Tables of folds, years, costs, exposures, steadiness, groups (and capacity, if ``adv``: date, ticker, adv20, is given), and the gates at ``cost_bps``."""
    if cost_bps not in spec.cost_bps:
        raise ValueError("the judged cost is one of the run's costs")
    t = result.trades
    scores = t.scores.select("date", "ticker", F.col("path").alias("factor"), "value")
    fwd = ev.forward_returns(panel, (spec.horizon,))
    ics = keep(t.ics.drop("pool"))
    judged = t.daily.filter(F.col("cost_bps") == cost_bps)

    def over(days: DataFrame, name: str) -> DataFrame:
        net = judged.join(days, "date").groupBy(name, "path").agg(F.min("date").alias("start"), F.max("date").alias("end"), *returns_of())
        mean = ics.join(days, "date").groupBy(name, F.col("factor").alias("path")).agg(F.avg("ic").alias("ic_mean"))
        return net.join(mean, [name, "path"], "left")

    test = result.tables["folds"].filter("role = 'test'").select("date", "fold")
    exposure = keep(t.exposures.drop("pool").withColumn("max_abs_industry", F.max(F.abs("exposure")).over(Window.partitionBy("path", "date"))))
    card = keep(scorecard(judged, ics, exposure))
    stress = pf.performance(t.daily, by=("path", "cost_bps")).drop("n")
    used = t.daily.groupBy("path", "cost_bps").agg(F.avg("turnover").alias("average_turnover"), F.sum(F.col("turnover") * F.col("cost_bps") / 10_000).alias("total_cost"))
    years = ev.ic_by_label(ics, F.year("date").cast("string"))
    tables = {
        "fold_metrics": over(test, "fold"), "year_metrics": over(test.select("date", F.year("date").alias("year")), "year").drop("start", "end"), "cost_stress": stress.join(used, ["path", "cost_bps"]),
        "industry_exposure": exposure, "regime_stability": ev.stability(years).drop("horizon").withColumnRenamed("factor", "path"),
        "group_stratification": ev.stratification(ev.quantile_groups(scores, fwd, groups, spec.min_names), groups).drop("horizon").withColumnRenamed("factor", "path"), "portfolio_scorecard": card,
    }
    if adv is not None:
        tables["capacity"] = pf.capacity(pf.participation(t.moves, adv, aum), by=("path",))
    mean = {r["factor"]: r["ic"] for r in ics.groupBy("factor").agg(F.avg("ic").alias("ic")).collect()}  # a row a path
    rows = {r["path"]: r for r in card.collect()}
    overlaps = result.tables["overlaps"].agg(F.coalesce(F.sum("overlaps"), F.lit(0))).first()[0]
    of = lambda p, c: rows[p][c] if p in rows else None
    turnover = of("soft", "average_turnover")
    raw = {"sharpe": of("raw", "sharpe"), "ic": mean.get("raw")}
    soft = {"sharpe": of("soft", "sharpe"), "ic": mean.get("soft"), "annual_cost": None if turnover is None else turnover * pf.YEAR * cost_bps / 10_000, "exposure": of("soft", "industry_exposure")}
    gates = oos_gates(raw, soft, baseline_annual_cost, int(overlaps))
    quality = {"raw_ic": raw["ic"], "soft_ic": soft["ic"], "soft_ic_retention": gates["soft_ic_retention_at_least_80pct"][0], "baseline_annual_cost": baseline_annual_cost, "soft_annual_cost": soft["annual_cost"], "soft_average_max_industry_exposure": soft["exposure"], "label_overlap_count": int(overlaps)}
    return Report(tables, gate_rows(panel.sparkSession, gates), quality)


@dataclass(frozen=True)
class Experiment:
    """Rules of the experiment of variants; the last three are what its gates ask for."""

    horizon: int = 5
    min_names: int = 30
    groups: int = 5
    quantile: float = 0.2
    max_weight: float = 0.05
    cost_bps: float = 10.0
    coverage: float = 0.95
    neutral_dates: float = 0.95
    max_exposure: float = 1e-8

    def __post_init__(self) -> None:
        if not 0 < self.quantile <= 0.5 or not 0 < self.max_weight <= 1:
            raise ValueError("quantile is within (0, 0.5] and max_weight within (0, 1]")
        if min(self.horizon, self.groups) < 1 or self.min_names < 2 or self.cost_bps < 0:
            raise ValueError("sizes are positive and costs aren't negative")


def max_group_mean(values: DataFrame, industry: DataFrame | None = None) -> DataFrame:
    """date, max_abs_mean: the largest absolute mean value of an industry (a column of values, if it isn't given); dates without a classified value are left out."""
    rows = values.filter("value is not null")
    rows = rows.filter("industry is not null") if industry is None else rows.join(industry.filter("industry is not null"), "ticker")
    rows = rows.groupBy("date", "industry").agg(F.avg("value").alias("m"))
    return rows.groupBy("date").agg(F.max(F.abs("m")).alias("max_abs_mean"))


def neutralization_quality(raw: DataFrame, neutral: DataFrame) -> DataFrame:
    """One row: the share of dates with a raw value, and of these the share whose neutralisation has a result; 0 where there is no date."""
    a = raw.groupBy("date").agg((F.count("value") > 0).alias("eligible"))
    b = xs.neutralize_diagnostics(neutral).select("date", "valid")
    both = a.join(b, "date", "left")
    none = F.lit(0.0)
    return both.agg(F.coalesce(F.avg(F.col("eligible").cast("double")), none).alias("raw_usable_date_ratio"), F.coalesce(F.avg(F.when(F.col("eligible"), F.coalesce("valid", F.lit(False)).cast("double"))), none).alias("neutralization_success_on_eligible_dates"))


def capped_targets(rows: DataFrame, spec: Experiment, by: str | None = None, x: str = "value", also: tuple[str, ...] = ()) -> DataFrame:
    """date, pos, ticker, also, w, feasible: long-short weights; a date where one is over the cap holds nothing and isn't feasible."""
    w = pf.long_short(rows, x, spec.quantile, by, also)
    over = F.max(F.abs("w")).over(Window.partitionBy("date")) > spec.max_weight + 1e-12
    return w.withColumn("feasible", ~over).withColumn("w", F.when(F.col("feasible"), F.col("w")).otherwise(0.0))


def variants(panel: DataFrame, factor: DataFrame | None, industry: DataFrame | None, spec: Experiment = Experiment(), folds: DataFrame | None = None) -> Report:
    """A factor (date, ticker, value) as it is, winsorised and standardised, against its neutral form: factor_diagnostics, portfolio_metrics, quality and gates.

    The raw variant trades all names at once, the neutral one within industries. ``industry`` is ticker, industry; a panel whose rows have value,
    industry or fwd (of the horizon) already needs no factor, no industry and no close, and nothing is joined.
    Label overlap is counted over ``folds``; by default the folds that fit the dates with a value.
    """
    fwd = F.col("fwd") if "fwd" in panel.columns else ev.forward(spec.horizon)
    cells = panel.select("date", "pos", "ticker", "returns", fwd.alias("fwd"), *(c for c, given in (("industry", industry), ("value", factor)) if given is None))
    if industry is not None:
        cells = cells.join(industry, "ticker", "left")
    if factor is not None:
        cells = cells.join(factor.select("date", "ticker", "value"), ["date", "ticker"], "left")
    raw = xs.standardize(xs.winsorize(cells.withColumn("seen", F.col("value").isNotNull()))).withColumn("raw", F.col("value"))
    both = keep(xs.neutralize(raw, min_names=spec.min_names, also=("pos", "returns", "industry", "fwd", "seen", "raw")).withColumnRenamed("value", "neutralized"))  # all of it by date: one shuffle
    wide = ev.Wide(both, {"raw": "raw", "neutralized": "neutralized"}, {spec.horizon: "fwd"})
    raw, neutral = (both.select("date", "ticker", "industry", F.col(n).alias("value")) for n in wide.names)
    ics = keep(wide.ic((spec.horizon,), min_names=spec.min_names))
    spread = ev.quantile_returns(wide.groups(spec.horizon, spec.groups, spec.min_names), spec.groups)
    names = panel.sparkSession.createDataFrame([("raw", "global"), ("neutralized", "industry_neutral")], "variant string, portfolio_mode string")
    seen = ics.groupBy(F.col("factor").alias("variant")).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("ic_observations"))
    tops = spread.groupBy(F.col("factor").alias("variant")).agg(F.avg("top_bottom").alias("top_bottom_mean"))
    diagnostics = names.select("variant").join(seen, "variant", "left").join(tops, "variant", "left").fillna(0, ["ic_observations"])
    parts = [capped_targets(both, spec, by, n, ("returns",)).withColumn("variant", F.lit(n)) for n, by in (("raw", None), ("neutralized", "industry"))]
    moves = pf.executed_targets(parts[0].unionByName(parts[1]), ("variant",), ("feasible",))
    sums = keep(moves.groupBy("variant", "date", "pos").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"), F.sum(F.abs("dw")).alias("turnover"), F.bool_and("feasible").alias("feasible")))
    daily = pf.costed(sums.drop("feasible"), (spec.cost_bps,))
    used = daily.groupBy("variant").agg(F.avg("turnover").alias("average_turnover"), F.sum(F.col("turnover") * F.col("cost_bps") / 10_000).alias("total_cost"))
    bad = sums.filter(~F.col("feasible")).groupBy("variant").agg(F.countDistinct("date").alias("invalid_weight_dates"))
    traded = pf.performance(daily, by=("variant",)).select("variant", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown")
    metrics = names.join(traded, "variant").join(used, "variant").join(bad, "variant", "left").fillna(0, ["invalid_weight_dates"])
    if folds is None:
        days = both.filter("seen").select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
        n = days.count()
        test = min(50, max(10, n // 10))
        folds = sel.purged_folds(days, min(300, max(30, n // 3)), test, test, spec.horizon)
    folds = keep(folds)
    overlaps = sel.label_overlaps(folds, spec.horizon).agg(F.coalesce(F.sum("overlaps"), F.lit(0)).cast("long").alias("label_overlap_count"), F.count("*").alias("fold_count"))
    covered = both.agg(F.coalesce(F.avg(F.col("industry").isNotNull().cast("double")), F.lit(0.0)).alias("classification_coverage"))
    exposed = max_group_mean(neutral).agg(F.max("max_abs_mean").alias("max_abs_industry_exposure"))
    q = {}
    for one in (covered, exposed, overlaps, neutralization_quality(raw, neutral)):  # a row each
        q |= one.first().asDict()
    within, least = (lambda v, b: v is not None and v <= b), (lambda v, b: v >= b)
    rules = {
        "classification_coverage": (q["classification_coverage"], spec.coverage, least), "variants_present": (float(ics.select("factor").distinct().count()), 2.0, least), "industry_exposure": (q["max_abs_industry_exposure"], spec.max_exposure, within),
        "label_overlap": (q["label_overlap_count"], 0, within), "neutralization_dates": (q["neutralization_success_on_eligible_dates"], spec.neutral_dates, least),
    }
    return Report({"factor_diagnostics": diagnostics, "portfolio_metrics": metrics}, gate_rows(panel.sparkSession, {k: (v, b, bool(f(v, b))) for k, (v, b, f) in rules.items()}), q)


def write(found: Report, metadata: dict, folder: str, title: str = "Out-of-sample report") -> list[str]:
    """Each table as a CSV (those in LONG as a folder of them), quality_report.json, metadata.json and report.md; each file appears whole or not at all."""
    out = Path(folder)
    paths, small = [], {}

    def put(name: str, text: str) -> None:
        reports.write_text(out / name, text)
        paths.append(str(out / name))

    for name in sorted(found.tables):
        if name in LONG:
            reports.write_table(found.tables[name], str(out / name))
            paths.append(str(out / name))
            continue
        first = [c for c in ("fold", "year", "variant", "path", "cost_bps", "aum") if c in found.tables[name].columns]
        small[name] = reports.small(found.tables[name], *first)
        put(f"{name}.csv", small[name].to_csv(index=False))
    gates = [r.asDict() for r in found.gates.collect()]
    put("quality_report.json", json.dumps(found.quality | {"gates": {g["gate"]: g["passed"] for g in gates}}, indent=2, sort_keys=True))
    put("metadata.json", json.dumps(metadata, indent=2, sort_keys=True, default=str))
    lines = [f"# {title}", "", "## Gates", "", *(f"- {'PASS' if g['passed'] else 'FAIL'}: `{g['gate']}` ({g['value']} against {g['bound']})" for g in gates)]
    lines += ["", "## Quality", "", *(f"- {k}: {v}" for k, v in found.quality.items())]
    for name, pdf in small.items():
        lines += ["", f"## {name.replace('_', ' ').capitalize()}", "", reports.markdown(pdf) if len(pdf) else "None."]
    put("report.md", "\n".join(lines) + "\n")
    return paths
