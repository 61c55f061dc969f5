"""What knowing about redundancy is worth: three arms over the same folds, their tables and gates.

Arm A selects stable factors of the base pool, B is the redundancy-aware selection of it, C that of the pool with the new
factors. A fold that selects too few factors is invalid: its scores are missing and its portfolio holds what the last
valid fold left (nothing, before the first). Evidence, correlations and ranks are made once for all arms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators import evaluation as ev
from factorloom.operators import portfolio as pf
from factorloom.operators import redundancy as rd
from factorloom.operators import selection as sel
from factorloom.plans.experiment import PATHS, Trades, WalkForward, trade
from factorloom.sources.shared import keep

ARMS = ("A", "B", "C")
#: The order in which the tables are written.
TABLES = ("factor_value_correlation", "ic_correlation", "correlation_clusters", "factor_selection_by_fold", "candidate_coverage", "ablation_metrics", "fold_metrics", "year_metrics", "cost_stress", "industry_exposure")
KEYS = ("arm", "fold", "year", "path", "cost_bps", "factor", "left", "right", "date")


@dataclass(frozen=True)
class Ablation:
    """Sizes and trading rules (``walk``), gates of the selection (``rules``), the cost that is judged and the most exposure to an industry."""

    walk: WalkForward = field(default_factory=WalkForward)
    rules: rd.Rules = field(default_factory=rd.Rules)
    cost_bps: float = 10.0
    max_exposure: float = 0.08

    def __post_init__(self) -> None:
        if self.cost_bps not in self.walk.cost_bps:
            raise ValueError("the judged cost is one of the walk's costs")
        if self.rules.min_names != self.walk.min_names or self.rules.every != self.walk.every:
            raise ValueError("selection and trading have the same least number of names and the same interval")

    @classmethod
    def from_yaml(cls, text: str) -> Ablation:
        """Sections oos (fields of WalkForward) and correlation (fields of Rules); names, interval and least IC are taken from oos."""
        import yaml

        given = yaml.safe_load(text)
        given = {} if given is None else given
        if not isinstance(given, dict):
            raise TypeError("the configuration is a mapping")
        oos, correlation = given.get("oos") or {}, given.get("correlation") or {}
        if not isinstance(oos, dict) or not isinstance(correlation, dict):
            raise TypeError("the sections oos and correlation are mappings")
        walk = WalkForward.from_yaml(yaml.safe_dump(oos))
        same = {"min_names": walk.min_names, "every": walk.every, "min_abs_ic": walk.min_abs_ic}
        unknown = set(correlation) - {f.name for f in fields(rd.Rules)}
        if unknown:
            raise TypeError(f"unknown fields: {sorted(unknown)}")
        return cls(walk, rd.Rules(**same | correlation), **{k: v for k, v in given.items() if k not in ("oos", "correlation")})


@dataclass
class Arms:
    folds: DataFrame
    overlaps: DataFrame
    evidence: DataFrame
    selection: rd.Selection
    weights: DataFrame
    fold_table: DataFrame
    trades: Trades


def run_arms(panel: DataFrame, base: DataFrame, new: DataFrame, industry: DataFrame, spec: Ablation, wide: ev.Wide | None = None) -> Arms:
    """All arms at once; ``base`` and ``new`` are long factors of the same panel, with different names.

    ``wide`` are both as columns of the panel's rows; it is what all steps start from, so it should be kept. It is made and kept if it isn't given.
    """
    twice = base.select("factor").distinct().join(new.select("factor").distinct(), "factor").orderBy("factor").limit(5).collect()
    if twice:
        raise ValueError(f"names in both pools: {[r['factor'] for r in twice]}")
    walk = spec.walk
    if wide is None:
        wide = ev.Wide.of(panel, base.select("date", "ticker", "factor", "value").unionByName(new.select("date", "ticker", "factor", "value"))).kept()
    factors = wide.long()
    folds = keep(sel.purged_folds(panel, walk.min_train, walk.test_size, walk.step, walk.horizon, embargo=walk.embargo))
    if folds.isEmpty():
        raise ValueError("not enough dates for a fold")
    train = folds.filter("role = 'train'").select("fold", "date", "pos")
    ics, daily = rd.daily_evidence(wide, walk.horizon, walk.min_names)
    evidence = keep(rd.fold_evidence(factors, ics, train, spec.rules))
    known = base.select("factor").distinct()
    of = lambda arm, names: names.select(F.lit(arm).alias("pool"), "factor")
    pools = keep(of("B", known).unionByName(of("C", factors.select("factor").distinct())))
    aware = rd.correlation_aware(factors, ics, train, pools, spec.rules, evidence, wide, daily)
    stable = keep(rd.stable_selection(evidence, of("A", known), walk.weight_cap))
    weights = keep(stable.unionByName(aware.selected))
    plain = stable.groupBy("pool", "fold").agg(F.lit(True).alias("valid"), F.count("*").alias("selected_count"), F.array_join(F.sort_array(F.collect_list("factor")), "|").alias("selected"))
    mine = folds.select(F.lit("A").alias("pool"), "fold").distinct().join(plain, ["pool", "fold"], "left").select("pool", "fold", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("selected_count", F.lit(0).cast("long")).alias("selected_count"), F.coalesce("selected", F.lit("")).alias("selected"))
    every = mine.unionByName(aware.folds).withColumn("action", F.when(F.col("valid"), "score").otherwise("invalid_fold_hold"))
    return Arms(folds, sel.label_overlaps(folds, walk.horizon), evidence, aware, weights, keep(every.withColumnRenamed("pool", "arm")), trade(panel, factors, industry, folds, weights, ARMS, walk, wide))


def returns_of(x: str = "net") -> list[Column]:
    year, risk = F.avg(x) * pf.YEAR, F.stddev_samp(x) * math.sqrt(pf.YEAR)
    return [year.alias("annualized_return"), risk.alias("annualized_volatility"), F.try_divide(year, risk).alias("sharpe")]


def report(arms: Arms, panel: DataFrame, industry: DataFrame, spec: Ablation) -> dict[str, DataFrame]:
    """The tables by name (those of TABLES, and fold_diagnostics)."""
    t = arms.trades
    ics = keep(t.ics.select(F.col("pool").alias("arm"), F.col("factor").alias("path"), "date", "ic"))
    test = arms.folds.filter("role = 'test'").select("fold", "date")
    daily = t.daily.withColumnRenamed("pool", "arm")
    judged = daily.filter(F.col("cost_bps") == spec.cost_bps)

    def over(label: Column, name: str, days: DataFrame) -> DataFrame:
        """Mean IC and returns of each label (a fold or a year) of the test rows."""
        net = judged.join(days, "date").groupBy("arm", "path", label.alias(name)).agg(F.min("date").alias("start"), F.max("date").alias("end"), *returns_of())
        mean = ics.join(days, "date").groupBy("arm", "path", label.alias(name)).agg(F.avg("ic").alias("ic_mean"))
        return net.join(mean, ["arm", "path", name], "left")

    by_fold = keep(over(F.col("fold"), "fold", test))
    by_year = over(F.year("date"), "year", test.select("date")).drop("start", "end")
    cost = pf.performance(daily, by=("arm", "path", "cost_bps")).select("arm", "path", "cost_bps", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown")
    used = daily.groupBy("arm", "path", "cost_bps").agg(F.avg("turnover").alias("average_turnover"), F.sum(F.col("turnover") * F.col("cost_bps") / 10_000).alias("total_cost"))
    stress = keep(cost.join(used, ["arm", "path", "cost_bps"]))
    whole = ics.groupBy("arm", "path").agg(F.avg("ic").alias("ic_mean"))
    positive = by_fold.groupBy("arm", "path").agg(F.count_if(F.col("ic_mean") > 0).alias("positive_ic_folds"))
    metrics = stress.filter(F.col("cost_bps") == spec.cost_bps).drop("cost_bps").join(positive, ["arm", "path"], "left").join(whole, ["arm", "path"], "left")
    weights = t.exposures.withColumnRenamed("pool", "arm")
    largest = weights.withColumn("max_abs_industry", F.max(F.abs("exposure")).over(pf.Window.partitionBy("arm", "path", "date")))
    pool = lambda df: df.withColumnRenamed("pool", "arm")
    base = arms.evidence.join(arms.selection.diagnostics.filter("pool = 'B'").select("fold", "factor"), ["fold", "factor"]).select(F.lit("A").alias("arm"), "fold", "factor", "coverage", "missingness", "full_ic", "recent_ic", "direction", "robust_ic", "agreeing_blocks", "block_observation_counts", "recent_agrees", F.col("stable").alias("eligible"))
    return {
        "factor_value_correlation": pool(arms.selection.value_correlation), "ic_correlation": pool(arms.selection.ic_correlation), "correlation_clusters": pool(arms.selection.clusters),
        "factor_selection_by_fold": pool(arms.weights), "candidate_coverage": pool(arms.selection.diagnostics).unionByName(base, allowMissingColumns=True), "ablation_metrics": keep(metrics),
        "fold_metrics": by_fold, "year_metrics": by_year, "cost_stress": stress, "industry_exposure": largest, "fold_diagnostics": arms.fold_table,
    }


def hard_pairs(arms: Arms, threshold: float) -> DataFrame:
    """arm, fold, left, right: pairs that were selected together though no verified correlation below the threshold says they may (an anti-join)."""
    w = arms.weights.filter("pool <> 'A'").select("pool", "fold", "factor")
    pairs = w.withColumnRenamed("factor", "left").join(w.withColumnRenamed("factor", "right"), ["pool", "fold"]).filter("left < right")
    fine = arms.selection.value_correlation.filter(F.col("verified") & (F.abs("value") < threshold))
    return pairs.join(fine, ["pool", "fold", "left", "right"], "left_anti").withColumnRenamed("pool", "arm")


def gates(arms: Arms, tables: dict[str, DataFrame], spec: Ablation) -> DataFrame:
    """kind, gate, value, bound, passed: a row a gate; a missing value doesn't pass."""
    m, rules = tables["ablation_metrics"], spec.rules
    exposure = tables["industry_exposure"].select("arm", "path", "date", "max_abs_industry").distinct().groupBy("arm", "path").agg(F.avg("max_abs_industry").alias("exposure"))
    row = m.join(exposure, ["arm", "path"], "left")
    at = lambda arm, path, c: F.max(F.when((F.col("arm") == arm) & (F.col("path") == path), F.col(c).cast("double")))

    def gate(kind: str, name: str, value: Column, bound: Column, holds) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("gate"), value.cast("double").alias("value"), bound.cast("double").alias("bound"), F.coalesce(holds(value, bound), F.lit(False)).alias("passed"))

    least, most, more = (lambda v, b: v >= b), (lambda v, b: v <= b), (lambda v, b: v > b)
    research = row.agg(F.array(
        gate("research", "c_raw_ic_not_below_a", at("C", "raw", "ic_mean"), at("A", "raw", "ic_mean"), least),
        gate("research", "c_soft_sharpe_above_a", at("C", "soft", "sharpe"), at("A", "soft", "sharpe"), more),
        gate("research", "c_soft_turnover_not_above_a", at("C", "soft", "average_turnover"), at("A", "soft", "average_turnover"), most),
        gate("research", "c_positive_ic_folds_at_least_a", at("C", "raw", "positive_ic_folds"), at("A", "raw", "positive_ic_folds"), least),
        gate("research", "c_soft_industry_exposure_at_most_8pct", at("C", "soft", "exposure"), F.lit(spec.max_exposure), most),
    ).alias("g"))
    none = F.lit(0)
    one = lambda df, name, count, bound=none, holds=most: df.agg(F.array(gate("engineering", name, count, bound, holds)).alias("g"))
    folds = F.countDistinct("fold")
    shared = tables["fold_diagnostics"].groupBy("arm").agg(folds.alias("n"))
    sizes = tables["fold_diagnostics"].filter("arm <> 'A' and valid")
    engineering = [
        one(shared, "shared_folds", F.max("n") - F.min("n") + len(ARMS) - F.count("*")),
        one(arms.overlaps, "zero_label_overlap", F.sum("overlaps")),
        one(sizes, f"valid_correlation_fold_size_{rules.min_factors}_to_{rules.max_factors}", F.count_if(~F.col("selected_count").between(rules.min_factors, rules.max_factors))),
        one(hard_pairs(arms, rules.hard), "no_selected_pair_breaches_hard_threshold", F.count("*")),
        one(tables["cost_stress"].select("arm", "path", "cost_bps").distinct(), "complete_cost_stress_grid", F.count("*"), F.lit(len(ARMS) * len(PATHS) * len(set(spec.walk.cost_bps))), least),
    ]
    out = research
    for e in engineering:
        out = out.unionByName(e)
    return out.select(F.inline("g"))


def oos_gates(raw: dict[str, float], soft: dict[str, float], baseline_cost: float, overlaps: int) -> dict[str, tuple[float | None, float, bool]]:
    """The gates of one experiment: name: (value, bound, passed). raw and soft have sharpe and ic, soft also annual_cost and exposure.

    Fixed values: costs fall by 40 %, exposure to an industry is at most 8 %, 80 % of the IC is kept, no label overlaps.
    """
    nan = lambda x: x is None or x != x
    saved = 1 - soft["annual_cost"] / baseline_cost if baseline_cost > 0 and not nan(soft["annual_cost"]) else None
    kept = soft["ic"] / raw["ic"] if not nan(raw["ic"]) and not nan(soft["ic"]) and raw["ic"] > 0 else None
    rows = {
        "soft_sharpe_beats_raw": (soft["sharpe"], raw["sharpe"], lambda v, b: v > b), "annual_cost_reduction_at_least_40pct": (saved, 0.40, lambda v, b: v >= b),
        "industry_exposure_at_most_8pct": (soft["exposure"], 0.08, lambda v, b: v <= b), "soft_ic_retention_at_least_80pct": (kept, 0.80, lambda v, b: v >= b), "zero_label_overlap": (overlaps, 0, lambda v, b: v == b),
    }
    return {k: (v, b, not nan(v) and not nan(b) and bool(f(v, b))) for k, (v, b, f) in rows.items()}


def write(tables: dict[str, DataFrame], judged: DataFrame, metadata: dict, folder: str) -> list[str]:
    """Each table of TABLES as a CSV in the order of KEYS (that of exposures as a folder of them), gates and metadata as JSON, and a summary; each file appears whole or not at all."""
    import json
    from pathlib import Path

    from factorloom import reports

    out, paths = Path(folder), []
    out.mkdir(parents=True, exist_ok=True)

    def put(name: str, text: str) -> None:
        reports.write_text(out / name, text)
        paths.append(str(out / name))

    small = {n: reports.small(tables[n], *(k for k in KEYS if k in tables[n].columns)) for n in TABLES if n != "industry_exposure"}
    for n in TABLES:
        if n in small:
            put(f"{n}.csv", small[n].to_csv(index=False))
        else:  # a row for each date and industry: files that Spark writes
            reports.write_table(tables[n], str(out / n))
            paths.append(str(out / n))
    found = [r.asDict() for r in judged.collect()]  # a row a gate
    passed = {k: all(g["passed"] for g in found if g["kind"] == k) for k in ("research", "engineering")}
    put("quality_report.json", json.dumps({"gates": found, "research_pass": passed["research"], "engineering_pass": passed["engineering"]}, indent=2, sort_keys=True))
    put("metadata.json", json.dumps(metadata, indent=2, sort_keys=True, default=str))
    lines = ["# Ablation of redundancy-aware selection", ""]
    for kind in ("engineering", "research"):
        lines += [f"## {kind.capitalize()} gates", "", *(f"- {'PASS' if g['passed'] else 'FAIL'}: `{g['gate']}` ({g['value']} against {g['bound']})" for g in found if g["kind"] == kind), ""]
    redundant = small["correlation_clusters"]
    redundant = redundant[redundant["cluster_size"] > 1] if len(redundant) else redundant
    for title, table in (("Arms", small["ablation_metrics"]), ("Selected factors", small["factor_selection_by_fold"]), ("Redundant clusters", redundant)):
        lines += [f"## {title}", "", reports.markdown(table) if len(table) else "None.", ""]
    lines += ["A research gate that fails is a result; it is no reason to change parameters out of sample.", ""]
    put("report.md", "\n".join(lines))
    return paths
