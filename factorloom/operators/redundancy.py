"""Selection that knows which factors say the same: gates, clusters, penalties and capped weights, for all folds and pools in one job.

Tables: ``factors`` (date, ticker, factor, value; dense, a missing value is null), ``ics`` (date, factor, ic; one horizon),
``train`` (fold, date, pos; the consecutive rows of the calendar a fold learns from) and ``pools`` (pool, factor; the
candidates of each arm of an experiment). What doesn't depend on folds (ranks, correlations of a date, changes of
ranks) is made once and then aggregated by fold; what doesn't depend on the pool is made once by fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.operators.crosssection import mean_rank
from factorloom.operators.evaluation import Wide, column, correlation, mean_ranks, pearson
from factorloom.sources.shared import deal, keep


@dataclass(frozen=True)
class Rules:
    """Gates and limits of the selection; checked when made. The defaults are fixed values."""

    min_abs_ic: float = 0.005
    min_coverage: float = 0.80
    min_names: int = 30
    blocks: int = 4
    agreeing: int = 3
    block_observations: int = 20
    hard: float = 0.75
    pair_dates: int = 60
    shrinkage: float = 0.5
    soft: float = 0.25
    every: int = 5
    min_factors: int = 5
    max_factors: int = 6
    cap: float = 0.20

    def __post_init__(self) -> None:
        if not 0 < self.min_coverage <= 1:
            raise ValueError("min_coverage is within (0, 1]")
        if self.min_factors < 1 or self.max_factors < self.min_factors:
            raise ValueError("invalid limits of the number of factors")
        if self.min_factors * self.cap < 1 - 1e-12:
            raise ValueError("the least number of factors is infeasible for the weight cap")
        if self.blocks < 2 or not 1 <= self.agreeing <= self.blocks:
            raise ValueError("at least 2 blocks, of which 1 to all agree")
        if not (0 <= self.shrinkage <= 1 and 0 <= self.hard <= 1) or self.every < 1:
            raise ValueError("shrinkage and threshold are within [0, 1], the interval is positive")


#: Why a factor isn't eligible, in the order in which reasons are joined.
REASONS = ("coverage_below_80pct", "insufficient_ic_block_observations", "block_direction_instability", "recent_direction_mismatch", "robust_ic_below_threshold")


def _level(c: str) -> Column:
    """c in whole units of 1e-12: what differs by less, by the order of a sum, is a tie, which names decide."""
    return F.floor(F.col(c) * 1e12 + 0.5)


def training_days(train: DataFrame, blocks: int) -> DataFrame:
    """fold, date, pos, block (of even counts, the first ones larger by one), recent (the later half)."""
    w = Window.partitionBy("fold")
    days = train.select("fold", "date", "pos").distinct().withColumns({"i": F.row_number().over(w.orderBy("date")) - 1, "n": F.count("*").over(w)})
    size, more = F.floor(F.col("n") / blocks), F.col("n") % blocks
    block = F.when(F.col("i") < more * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return days.select("fold", "date", "pos", block.cast("int").alias("block"), (F.col("i") >= F.floor(F.col("n") / 2)).alias("recent"), "n")


def _median(values: Column, n: int) -> Column:
    """Of an array of n values."""
    s = F.sort_array(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def fold_evidence(factors: DataFrame, ics: DataFrame, train: DataFrame, rules: Rules) -> DataFrame:
    """For each fold and factor: coverage, missingness, ICs by block and lately, eligible with the reasons against it, base_quality."""
    days = training_days(train, rules.blocks)
    cells = factors.groupBy("date", "factor").agg(F.count("*").alias("cells"), F.count("value").alias("names"), F.coalesce(F.min("value") < F.max("value"), F.lit(False)).alias("varies"))
    rows = days.join(cells, "date").join(ics.select("date", "factor", "ic"), ["date", "factor"], "left")
    each = range(rules.blocks)
    full = rows.groupBy("fold", "factor").agg(
        (F.count_if((F.col("names") >= rules.min_names) & F.col("varies")) / F.max("n")).alias("coverage"), (1 - F.sum("names") / F.sum("cells")).alias("missingness"),
        F.avg("ic").alias("full_ic"), F.avg(F.when(F.col("recent"), F.col("ic"))).alias("recent_ic"),
        F.array(*(F.count(F.when(F.col("block") == b, F.col("ic"))) for b in each)).alias("_counts"), F.array(*(F.avg(F.when(F.col("block") == b, F.col("ic"))) for b in each)).alias("_means"),
    )
    out = full.withColumn("direction", F.when(F.col("full_ic") < 0, -1).otherwise(1))
    agrees = lambda c: F.coalesce(F.signum(c) == F.col("direction"), F.lit(False))
    whole = ~F.exists("_means", lambda m: m.isNull())
    out = out.withColumns({
        "robust_ic": F.when(whole, _median(F.col("_means"), rules.blocks)), "agreeing_blocks": F.size(F.filter("_means", agrees)), "recent_agrees": agrees(F.col("recent_ic")),
        "block_observation_counts": F.array_join(F.transform("_counts", lambda c: c.cast("string")), "|"),
    })
    against = (
        F.col("coverage") < rules.min_coverage, F.exists("_counts", lambda c: c < rules.block_observations), F.col("agreeing_blocks") < rules.agreeing, ~F.col("recent_agrees"),
        F.coalesce(F.abs("robust_ic") < rules.min_abs_ic, F.lit(True)),
    )
    out = out.withColumn("ineligible_reason", F.concat_ws("|", *(F.when(c, r) for c, r in zip(against, REASONS, strict=True))))
    share = F.abs("robust_ic") * F.col("agreeing_blocks") / rules.blocks
    return out.withColumns({
        "eligible": F.col("ineligible_reason") == "", "base_quality": F.coalesce(F.when(F.col("recent_agrees"), share), F.lit(0.0)),
        "stable": whole & (F.col("agreeing_blocks") >= rules.agreeing) & F.col("recent_agrees") & F.coalesce(F.abs("robust_ic") >= rules.min_abs_ic, F.lit(False)), "stable_quality": share,
    }).drop("_counts", "_means")


def daily_correlation(factors: DataFrame, min_names: int, wide: Wide | None = None) -> DataFrame:
    """date, left, right, c: Spearman's on each date over the names that have both, ranked among these; left < right.

    A date's rows are shuffled once, with a column a factor (``wide``, or made of the long factors), and a task ranks the names of one date.
    """
    if wide is None:
        wide = Wide.of(factors.select("date", "ticker").distinct(), factors)
    names = sorted(wide.names)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        v = {n: column(t, wide_names[n]) for n in names}
        has = {n: ~np.isnan(a) for n, a in v.items()}
        rows, whole = [], {}
        for i, left in enumerate(names):
            for right in names[i + 1:]:
                both = has[left] & has[right]
                n = int(both.sum())
                if n < max(min_names, 1):
                    continue
                ranks = []
                for x in (left, right):
                    if n == has[x].sum():  # ranked among all it has: once for all such pairs
                        if x not in whole:
                            whole[x] = mean_ranks(v[x][both])
                        ranks.append(whole[x])
                    else:
                        ranks.append(mean_ranks(v[x][both]))
                c = correlation(*ranks)
                if c is not None:
                    rows.append((left, right, c))
        return pa.table({"date": pa.array([key[0].as_py()] * len(rows), key[0].type), "left": pa.array([r[0] for r in rows], pa.string()), "right": pa.array([r[1] for r in rows], pa.string()), "c": pa.array([r[2] for r in rows], pa.float64())})

    wide_names, kind = wide.names, dict(wide.df.dtypes)["date"]
    return deal(wide.df.select("date", *wide_names.values()), wide.rows, "date").groupBy("date").applyInArrow(one, f"date {kind}, left string, right string, c double")


def daily_evidence(wide: Wide, horizon: int, min_names: int) -> tuple[DataFrame, DataFrame]:
    """ICs (date, factor, ic) and the pairs of ``daily_correlation``, kept: the forward return is one more column of these, so a date's rows are shuffled once for both."""
    ahead = Wide(wide.df.withColumn("_ahead_", wide.forward(horizon)), wide.names | {"": "_ahead_"}, rows=wide.rows)  # no factor is named so, and it is first
    found = keep(daily_correlation(None, min_names, ahead))
    return found.filter("left = ''").select("date", F.col("right").alias("factor"), F.col("c").alias("ic")), found.filter("left <> ''")


def _pairs(nodes: DataFrame) -> DataFrame:
    """pool, fold, left, right (left < right), sign (of the product of their directions) of the nodes of each pool and fold."""
    a = nodes.select("pool", "fold", F.col("factor").alias("left"), F.col("direction").alias("_a"))
    b = nodes.select("pool", "fold", F.col("factor").alias("right"), F.col("direction").alias("_b"))
    return a.join(b, ["pool", "fold"]).filter("left < right").select("pool", "fold", "left", "right", (F.col("_a") * F.col("_b")).alias("sign"))


def fold_correlation(daily: DataFrame, train: DataFrame, nodes: DataFrame, min_dates: int) -> DataFrame:
    """pool, fold, left, right, value (median over the training dates, by directions), n, verified: all pairs of nodes."""
    by_fold = daily.join(train.select("fold", "date"), "date").groupBy("fold", "left", "right").agg(F.percentile("c", F.lit(0.5)).alias("c"), F.count("*").alias("n"))
    rows = _pairs(nodes).join(by_fold, ["fold", "left", "right"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select("pool", "fold", "left", "right", (F.col("c") * F.col("sign")).alias("value"), n.alias("n"), (n >= min_dates).alias("verified"))


def fold_ic_correlation(ics: DataFrame, train: DataFrame, nodes: DataFrame, shrinkage: float) -> DataFrame:
    """pool, fold, left, right, value (Pearson's of the ICs by directions, times ``shrinkage``), n, verified: all pairs of nodes."""
    rows = ics.select("date", "factor", "ic")
    two = rows.select("date", F.col("factor").alias("left"), F.col("ic").alias("x")).join(rows.select("date", F.col("factor").alias("right"), F.col("ic").alias("y")), "date").filter("left < right and x is not null and y is not null")
    by_fold = two.join(train.select("fold", "date"), "date").groupBy("fold", "left", "right").agg(F.count("*").alias("n"), pearson("x", "y").alias("c"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    out = _pairs(nodes).join(by_fold, ["fold", "left", "right"], "left")
    return out.select("pool", "fold", "left", "right", (F.when(n >= 2, F.col("c")) * F.col("sign") * shrinkage).alias("value"), n.alias("n"), (n >= 2).alias("verified"))


def components(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("pool", "fold")) -> DataFrame:
    """by, factor, root: the least name that edges (by, left, right) lead to. All groups at once, in rounds of joins.

    A round takes the least label among the neighbours and then that label's own; it is kept, so plans don't grow. Rounds grow
    with the logarithm of the longest chain in most shapes, and are at most its length.
    """
    both = keep(edges.select(*by, "left", "right").unionByName(edges.select(*by, F.col("right").alias("left"), F.col("left").alias("right"))))
    label = keep(nodes.select(*by, "factor").distinct().withColumn("root", F.col("factor")))
    while True:
        near = both.join(label.withColumnRenamed("factor", "right"), [*by, "right"]).groupBy(*by, F.col("left").alias("factor")).agg(F.min("root").alias("_near"))
        least = label.join(near, [*by, "factor"], "left").select(*by, "factor", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        of = least.select(*by, F.col("factor").alias("_new"), F.col("_new").alias("root"))
        after = keep(least.join(of, [*by, "_new"]).select(*by, "factor", "_old", "root"))
        label = after.drop("_old")
        if after.filter("root < _old").isEmpty():
            return label


def clusters(nodes: DataFrame, correlation: DataFrame, threshold: float = 0.75, by: tuple[str, ...] = ("pool", "fold")) -> DataFrame:
    """by, factor, cluster (numbered by the least names), cluster_size, members: linked are pairs that are unverified or correlate at the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is within [0, 1]")
    edge = ~F.coalesce("verified", F.lit(False)) | F.coalesce(F.abs("value") >= threshold, F.lit(False))
    found = components(nodes, correlation.filter(edge), by)
    group = Window.partitionBy(*by, "root")
    names = F.sort_array(F.collect_list("factor").over(group))
    rows = found.withColumns({"cluster": F.dense_rank().over(Window.partitionBy(*by).orderBy("root")) - 1, "cluster_size": F.count("*").over(group), "members": F.array_join(names, "|")})
    return rows.drop("root")


def rank_changes(factors: DataFrame, calendar: DataFrame, train: DataFrame, every: int, min_names: int, rows: int | None = None) -> DataFrame:
    """fold, factor, up, down: the mean change of rank shares from one scheduled row (each ``every``-th of the fold) to the next, of the factor and of its negative.

    Folds that begin at rows with one remainder share their schedule, so changes are made for each remainder, not each fold.
    ``rows`` is about how many are ranked.
    """
    if every < 1:
        raise ValueError("the interval is positive")
    starts = train.groupBy("fold").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last")).withColumn("offset", F.col("_first") % every)
    offsets = F.broadcast(starts.select("offset").distinct())  # at most ``every`` rows
    n = F.count("value").over(Window.partitionBy("date", "factor"))
    due = calendar.select("date", "pos").distinct().withColumn("offset", F.col("pos") % every).join(offsets, "offset")
    ranked = deal(factors.filter("value is not null").join(F.broadcast(due), "date"), rows, "date", "factor").withColumns({"n": n, "p": mean_rank(F.col("value"), ("date", "factor")) / n})  # only dates that some fold schedules are ranked
    before = Window.partitionBy("factor", "ticker", "offset").orderBy("pos")
    moved = deal(ranked, rows, "factor", "ticker", "offset").withColumns({"_p": F.lag("p").over(before), "_n": F.lag("n").over(before), "_k": F.lag("pos").over(before)}).filter(F.col("_k") == F.col("pos") - every)
    change = F.col("p") - F.col("_p")
    daily = moved.groupBy("factor", "offset", "pos").agg(F.count("*").alias("names"), F.avg(F.abs(change)).alias("up"), F.avg(F.abs(1 / F.col("n") - 1 / F.col("_n") - change)).alias("down")).filter(F.col("names") >= min_names)
    mine = starts.join(daily, "offset").filter((F.col("pos") - every >= F.col("_first")) & (F.col("pos") <= F.col("_last")))
    return mine.groupBy("fold", "factor").agg(F.avg("up").alias("up"), F.avg("down").alias("down"))


def capped(rows: DataFrame, quality: str, cap: float, by: tuple[str, ...], name: str = "factor", relax: bool = False) -> DataFrame:
    """rows with weight: in proportion to quality, summing to 1 within ``by``, none above the cap; all alike if all qualities are 0.

    Sorted by quality the first k are at the cap, for the least k with which the rest, sharing what is left, stay under it.
    Too few rows for the cap are an error, or, with ``relax``, get equal weights.
    """
    if not 0 < cap <= 1:
        raise ValueError("the cap is within (0, 1]")
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col("_q").desc(), name)
    given = F.greatest(F.coalesce(F.nanvl(F.col(quality).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    out = rows.withColumn("_q", given).withColumn("_q", F.when(F.sum("_q").over(group) > 0, F.col("_q")).otherwise(1.0))
    out = out.withColumns({"_j": F.row_number().over(order), "_m": F.count("*").over(group), "_rest": F.sum("_q").over(order.rowsBetween(0, Window.unboundedFollowing))})
    most = F.greatest(F.lit(cap), 1 / F.col("_m")) if relax else F.lit(cap)
    left = lambda k: 1 - most * k
    first = left(F.col("_j") - 1) * F.when(F.col("_rest") > 0, F.col("_q") / F.col("_rest")).otherwise(1 / (F.col("_m") - F.col("_j") + 1))
    out = out.withColumn("_k", F.min(F.when(first <= most + 1e-12, F.col("_j") - 1)).over(group))
    out = out.withColumn("_r", F.max(F.when(F.col("_j") == F.col("_k") + 1, F.col("_rest"))).over(group))
    share = left(F.col("_k")) * F.when(F.col("_r") > 0, F.col("_q") / F.col("_r")).otherwise(1 / (F.col("_m") - F.col("_k")))
    weight = F.when(F.col("_m") * most < 1 - 1e-12, F.raise_error(F.lit("the cap is infeasible for so few factors"))).when(F.col("_j") <= F.col("_k"), most).otherwise(share)
    out = out.withColumn("weight", weight)
    return out.withColumn("weight", F.col("weight") / F.sum("weight").over(group)).drop("_q", "_j", "_m", "_rest", "_k", "_r")


def stable_selection(evidence: DataFrame, pools: DataFrame, cap: float) -> DataFrame:
    """pool, fold, factor, direction, weight: factors whose ICs are stable, by |robust IC| and the share of blocks that agree.

    The cap gives way where a fold has too few of them.
    """
    rows = evidence.filter("stable").join(pools, "factor")
    return capped(rows, "stable_quality", cap, ("pool", "fold"), relax=True).select("pool", "fold", "factor", "direction", "weight")


@dataclass
class Selection:
    """diagnostics: a row for each pool, fold and factor. folds: one for each pool and fold. selected: with direction and weight, of valid folds."""

    diagnostics: DataFrame
    value_correlation: DataFrame
    ic_correlation: DataFrame
    clusters: DataFrame
    folds: DataFrame
    selected: DataFrame


def correlation_aware(factors: DataFrame, ics: DataFrame, train: DataFrame, pools: DataFrame, rules: Rules = Rules(), evidence: DataFrame | None = None, wide: Wide | None = None, daily: DataFrame | None = None) -> Selection:
    """Of each pool and fold: eligible factors, one a cluster of correlated ones, the best by cost- and redundancy-adjusted quality, with capped weights.

    A fold with fewer than ``min_factors`` of these is invalid and has no weights. ``daily`` are correlations of a date that are made already.
    """
    key = ["pool", "fold"]
    evidence = keep(fold_evidence(factors, ics, train, rules)) if evidence is None else evidence
    nodes = keep(evidence.filter("eligible").join(pools, "factor").select(*key, "factor", "direction", "base_quality", "missingness"))
    used = factors.join(nodes.select("factor").distinct(), "factor", "left_semi")
    if wide is not None:
        eligible = {r["factor"] for r in nodes.select("factor").distinct().collect()}  # a row a factor
        wide = Wide(wide.df, {n: c for n, c in wide.names.items() if n in eligible}, rows=wide.rows)
        used = wide.long()
    daily = daily_correlation(used, rules.min_names, wide) if daily is None else daily
    value = keep(fold_correlation(daily, train, nodes, rules.pair_dates))
    groups = clusters(nodes, value, rules.hard)
    best = Window.partitionBy(*key, "cluster").orderBy(_level("base_quality").desc(), _level("missingness"), "factor")
    placed = nodes.join(groups, [*key, "factor"]).withColumn("representative", F.row_number().over(best) == 1)
    due = None if wide is None or wide.rows is None else wide.rows * len(wide.names) // rules.every  # of one schedule, as folds from one start share
    turnover = rank_changes(used, train.select("date", "pos"), train, rules.every, rules.min_names, due)
    reps = placed.filter("representative").join(turnover, ["fold", "factor"], "left")
    reps = reps.withColumn("rank_turnover", F.when(F.col("direction") > 0, F.col("up")).otherwise(F.col("down"))).drop("up", "down")
    reps = keep(reps.withColumn("cost_adjusted_quality", F.coalesce(F.col("base_quality") / (1 + F.col("rank_turnover")), F.lit(0.0))))
    ic_corr = keep(fold_ic_correlation(ics, train, reps, rules.shrinkage))
    over = ic_corr.select(*key, F.explode(F.array("left", "right")).alias("factor"), F.greatest(F.abs("value") - rules.soft, F.lit(0.0)).alias("over"))
    penalty = over.groupBy(*key, "factor").agg((1 + F.sum(F.coalesce("over", F.lit(0.0)))).alias("redundancy_penalty"))
    judged = reps.join(penalty, [*key, "factor"], "left").withColumn("redundancy_penalty", F.coalesce("redundancy_penalty", F.lit(1.0)))
    judged = judged.withColumn("adjusted_quality", F.col("cost_adjusted_quality") / F.col("redundancy_penalty"))
    first = Window.partitionBy(*key).orderBy(_level("adjusted_quality").desc(), _level("missingness"), "factor")
    judged = judged.withColumn("selected", F.row_number().over(first) <= rules.max_factors)
    judged = keep(judged.withColumn("valid", F.count_if("selected").over(Window.partitionBy(*key)) >= rules.min_factors))
    chosen = capped(judged.filter("selected and valid"), "adjusted_quality", rules.cap, tuple(key)).select(*key, "factor", "direction", "weight")
    more = judged.select(*key, "factor", "rank_turnover", "cost_adjusted_quality", "redundancy_penalty", "adjusted_quality", "selected")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    table = groups.join(judged.select(*key, "factor", "representative", "selected"), [*key, "factor"], "left").select(*groups.columns, no("representative"), no("selected"))
    diagnostics = evidence.drop("stable", "stable_quality").join(pools, "factor").join(more, [*key, "factor"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    picked = judged.filter("selected").groupBy(*key).agg(F.max("valid").alias("valid"), F.count("*").alias("selected_count"), F.array_join(F.sort_array(F.collect_list("factor")), "|").alias("names"))
    every = evidence.select("fold", "factor").join(pools, "factor").select(*key).distinct()
    folds = every.join(picked, key, "left").select(*key, F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("selected_count", F.lit(0).cast("long")).alias("selected_count"), F.coalesce("names", F.lit("")).alias("selected"))
    return Selection(diagnostics, value, ic_corr, table, folds, chosen)
