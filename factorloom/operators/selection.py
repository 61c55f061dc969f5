"""Correlation of factors, purged folds, selection, weights and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.operators import redundancy
from factorloom.operators.crosssection import mean_rank
from factorloom.operators.evaluation import Wide, pearson


def value_correlation(factors: DataFrame | None, min_names: int = 30, min_dates: int = 60, wide: Wide | None = None) -> DataFrame:
    """left, right, value, n, verified: the median over dates of the pair's Spearman correlation.

    A date counts if ``min_names`` names have both; ranks are taken among these names. One row per pair, left < right.
    """
    daily = redundancy.daily_correlation(factors, min_names, wide)
    out = daily.groupBy("left", "right").agg(F.percentile("c", F.lit(0.5)).alias("value"), F.count("*").alias("n"))
    return out.withColumn("verified", F.col("n") >= min_dates)


def ic_correlation(ics: DataFrame, keep: float = 0.5) -> DataFrame:
    """left, right, value, n: Pearson's of two factors' ICs over their common dates, times ``keep``. left < right."""
    a = ics.select("date", F.col("factor").alias("left"), F.col("ic").alias("x"))
    b = ics.select("date", F.col("factor").alias("right"), F.col("ic").alias("y"))
    rows = a.join(b, "date").filter("left < right").groupBy("left", "right").agg(F.count("*").alias("n"), pearson("x", "y").alias("c"))
    return rows.filter("n >= 2").select("left", "right", (F.col("c") * keep).alias("value"), "n")


def clusters(names: DataFrame, corr: DataFrame, threshold: float = 0.75) -> DataFrame:
    """factor, cluster, cluster_size, members: components of pairs that are unverified or correlate at the threshold."""
    both = names.select(F.col("factor").alias("left")).join(names.select(F.col("factor").alias("right")), F.col("left") < F.col("right"))
    return redundancy.clusters(names, both.join(corr, ["left", "right"], "left"), threshold, ()).select("factor", "cluster", "cluster_size", "members")


def purged_folds(calendar: DataFrame, min_train: int, test_size: int, step: int, horizon: int, purge: int | None = None, embargo: int = 0, max_train: int | None = None) -> DataFrame:
    """fold, role ("train" or "test"), date, pos. Training ends ``purge`` rows before its test begins."""
    purge = horizon if purge is None else purge
    if min(min_train, test_size, step, horizon) < 1 or purge < horizon or embargo < 0:
        raise ValueError("sizes are positive, purge is at least the horizon, embargo isn't negative")
    days = calendar.select("date", "pos").distinct()
    n = F.max("pos").over(Window.partitionBy())
    first = min_train + purge
    days = days.withColumn("n", n)
    # rows from 0; fold k tests [first + k * (step + embargo), + test_size)
    i = F.col("pos") - 1
    stride = step + embargo
    last = F.floor((F.col("n") - test_size - first) / stride)
    rows = days.withColumn("fold", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))))
    start = first + F.col("fold") * stride
    train = (i < start - purge) & (i >= (start - purge - max_train if max_train else F.lit(0)))
    test = (i >= start) & (i < start + test_size)
    return rows.withColumn("role", F.when(train, "train").when(test, "test")).filter("role is not null").select("fold", "role", "date", "pos")


def label_overlaps(folds: DataFrame, horizon: int) -> DataFrame:
    """For each fold, the training rows whose labels reach its test."""
    start = folds.filter("role = 'test'").groupBy("fold").agg(F.min("pos").alias("start"))
    return folds.filter("role = 'train'").join(start, "fold").groupBy("fold").agg(F.count_if(F.col("pos") + horizon >= F.col("start")).alias("overlaps"))


def stable_factors(ics: DataFrame, min_abs_ic: float = 0.005, blocks: int = 4, agreeing: int = 3) -> DataFrame:
    """For each factor: full_ic, direction, robust_ic (median of block means), agreeing_blocks, recent_ic, eligible.

    The dates that any factor has are cut into blocks of rows; the first n mod blocks have one more.
    """
    if blocks < 2 or not 1 <= agreeing <= blocks:
        raise ValueError("at least 2 blocks, of which 1 to all agree")
    days = ics.select("date").distinct()
    days = days.withColumns({"i": F.row_number().over(Window.orderBy("date")) - 1, "n": F.count("*").over(Window.partitionBy())})
    size, more = F.floor(F.col("n") / blocks), F.col("n") % blocks
    block = F.when(F.col("i") < more * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(more + F.floor((F.col("i") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    rows = ics.join(days.withColumns({"block": block, "recent": F.col("i") >= F.floor(F.col("n") / 2)}), "date")
    by_block = rows.groupBy("factor", "block").agg(F.avg("ic").alias("m"))
    whole = rows.groupBy("factor").agg(F.avg("ic").alias("full_ic"), F.avg(F.when(F.col("recent"), F.col("ic"))).alias("recent_ic")).withColumn("direction", F.when(F.col("full_ic") >= 0, 1).otherwise(-1))
    seen = by_block.join(whole.select("factor", "direction"), "factor").groupBy("factor").agg(F.count("m").alias("n_blocks"), F.percentile("m", F.lit(0.5)).alias("robust_ic"), F.count_if(F.signum("m") == F.col("direction")).alias("agreeing_blocks"))
    out = whole.join(seen, "factor")
    recent = F.coalesce(F.signum("recent_ic") == F.col("direction"), F.lit(False))
    ok = (F.col("n_blocks") == blocks) & (F.col("agreeing_blocks") >= agreeing) & recent & (F.abs("robust_ic") >= min_abs_ic)
    return out.withColumns({"recent_agrees": recent, "eligible": F.coalesce(ok, F.lit(False))}).drop("n_blocks")


def mix(table: DataFrame, weights: dict[str, float], name: str = "mix") -> DataFrame:
    """table with one more column: the weighted sum of its factor columns, of which a missing value counts as 0."""
    missing = sorted(set(weights) - set(table.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return table.withColumn(name, sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)))


def capped_weights(quality: dict[str, float], cap: float = 0.20) -> dict[str, float]:
    """Weights in proportion to quality that sum to 1, none above the cap; a handful of factors, on the driver."""
    clean = {k: max(0.0, v if v == v and v is not None else 0.0) for k, v in quality.items()}
    if not clean:
        return {}
    if not 0 < cap <= 1 or len(clean) * cap < 1 - 1e-12:
        raise ValueError("the cap is infeasible")
    if not sum(clean.values()):
        clean = dict.fromkeys(clean, 1.0)
    # sorted by size, the first k are at the cap for the least k that lets the rest stay under it
    order = sorted(clean, key=lambda k: -clean[k])
    for k in range(len(order) + 1):
        rest = order[k:]
        total = sum(clean[n] for n in rest)
        share = {n: (1 - cap * k) * (clean[n] / total if total else 1 / len(rest)) for n in rest}
        if all(w <= cap + 1e-12 for w in share.values()):
            out = dict.fromkeys(order[:k], cap) | share
            norm = sum(out.values())
            return {n: out[n] / norm for n in clean}
    raise AssertionError


def ir_weights(summary: dict[str, float], corr: dict[tuple[str, str], float] | None = None, intensity: float = 0.5) -> dict[str, float]:
    """IC ratios as weights of absolute sum 1, after the inverse of their correlations drawn to the identity by ``intensity``."""
    import numpy as np

    names = sorted(summary)
    v = np.array([summary[n] for n in names], float)
    if corr:
        c = np.eye(len(names))
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if i != j:
                    c[i, j] = corr.get((min(a, b), max(a, b)), 0.0)
        v = np.linalg.solve((1 - intensity) * c + intensity * np.eye(len(names)), v)
    total = float(np.abs(v).sum())
    if not total:
        raise ValueError("all weights are 0")
    return {n: float(x / total) for n, x in zip(names, v, strict=True)}


def composite(factors: DataFrame, weights: dict[str, tuple[int, float]]) -> DataFrame:
    """date, ticker, value: the weighted mean of the date's standardised values by (direction, weight), over those that are there."""
    spec = F.create_map(*(F.lit(x) for k, (d, w) in sorted(weights.items()) for x in (k, float(d * w))))
    size = F.create_map(*(F.lit(x) for k, (_, w) in sorted(weights.items()) for x in (k, float(w))))
    w = Window.partitionBy("date", "factor")
    rows = factors.filter(F.col("factor").isin(sorted(weights))).withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))
    rows = rows.filter("z is not null")
    return rows.groupBy("date", "ticker").agg(F.try_divide(F.sum(F.col("z") * F.element_at(spec, F.col("factor"))), F.sum(F.element_at(size, F.col("factor")))).alias("value"))


def representatives(quality: DataFrame) -> DataFrame:
    """For each cluster the factor with the highest quality, then the least missingness, then the first name."""
    w = Window.partitionBy("cluster").orderBy(F.col("quality").desc_nulls_last(), F.col("missingness").asc_nulls_last(), "factor")
    return quality.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def t_test_selection(tests: DataFrame, n: int = 10, positive: bool = True, significant: bool = False) -> DataFrame:
    """The n factors with the best 0.45 * rank share of the mean + 0.45 * rank share of |t| + 0.10 if significant.

    Only factors with a positive mean take part (unless ``positive`` is off), ranked by their mean; where there are fewer than n of these,
    all take part, ranked by |mean|. With ``significant`` the others are left out after the ranking. Ties go by |mean|, |t|, name.
    """
    if n <= 0:
        raise ValueError("n is positive")
    every = Window.partitionBy()  # a row a factor
    fits = (F.col("mean") > 0) if positive else F.lit(True)
    rows = tests.withColumn("_enough", F.count_if(fits).over(every) >= n).filter(~F.col("_enough") | fits)
    rows = rows.withColumns({"_by": F.when(F.col("_enough"), F.col("mean")).otherwise(F.abs("mean")), "_t": F.abs("t")})
    share = lambda c: mean_rank(F.col(c), ()) / F.count(c).over(every)
    rows = rows.withColumn("score", 0.45 * share("_by") + 0.45 * share("_t") + 0.10 * F.col("significant").cast("double"))
    if significant:
        rows = rows.filter("significant")
    return rows.orderBy(F.col("score").desc(), F.abs("mean").desc(), F.abs("t").desc(), "factor").limit(n).drop("_enough", "_by", "_t")
