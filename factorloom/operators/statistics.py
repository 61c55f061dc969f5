"""Multiple testing, block bootstrap, outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bonferroni(tests: DataFrame, p: str = "p") -> DataFrame:
    return tests.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.count("*").over(Window.partitionBy())))


def benjamini_hochberg(tests: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """Step-up adjusted p-values: the least of p*n/rank over this and all greater ones, at most 1."""
    order = Window.orderBy(p, name)
    rows = tests.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy())})
    after = Window.orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("p_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(after))).drop("_k", "_n")


def block_length(horizon: int) -> int:
    return max(10, 2 * horizon)


def block_starts(n: int, block: int, boot: int, seed: int = 42) -> list[tuple[int, int, int]]:
    """(draw, block number, start): the same draws for all columns, in numpy's order."""
    rng, blocks = np.random.default_rng(seed), -(-n // block)
    return [(b, k, int(s)) for b in range(boot) for k, s in enumerate(rng.integers(0, n, size=blocks))]


def draw_starts(spark: SparkSession, n: int, blocks: dict[int, int], boot: int, seed: int = 42, draws: str = "numpy") -> DataFrame:
    """horizon, draw, i, to: the blocks [i, to) of each draw over n rows in a circle, of which the last is cut to n rows in all.

    ``draws`` is numpy (its generator, anew for each horizon) or hash (made of seed, draw and block number, on the executors).
    """
    if n < 1 or boot < 1 or min(blocks.values()) < 1 or draws not in ("numpy", "hash"):
        raise ValueError("rows, draws and blocks are positive, and draws are numpy or hash")
    out = None
    for h, block in sorted(blocks.items()):  # a few horizons
        count = -(-n // block)
        if draws == "numpy":
            rows = spark.createDataFrame(block_starts(n, block, boot, seed), "draw int, k int, i int")
        else:
            drawn = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("k").cast("string"))), 1, 13), 16, 10).cast("long")
            rows = spark.range(boot).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")).withColumn("i", (drawn % n).cast("int"))
        size = F.when(F.col("k") == count - 1, n - (count - 1) * block).otherwise(block)
        rows = rows.select(F.lit(h).alias("horizon"), "draw", "i", (F.col("i") + size).alias("to"))
        out = rows if out is None else out.unionByName(rows)
    return out


def grid_null(ics: DataFrame, n: int, blocks: dict[int, int], boot: int = 500, seed: int = 42, draws: str = "numpy") -> DataFrame:
    """horizon, draw, factor, mean: means of centred ICs over circular blocks of rows. ics has i (0-based row), factor, horizon, ic.

    Sums up to each row are made once, over the rows laid out twice; a block is the difference of two of them.
    """
    key = ("horizon", "factor")
    centred = ics.withColumn("x", F.col("ic") - F.avg("ic").over(Window.partitionBy(*key)))
    twice = centred.withColumn("i", F.explode(F.array(F.col("i"), F.col("i") + n))).select(*key, "i", "x")
    grid = ics.select(*key).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * n))))
    before = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = grid.join(twice, [*key, "i"], "left").select(*key, "i", F.coalesce(F.sum("x").over(before), F.lit(0.0)).alias("s"), F.count("x").over(before).alias("c"))
    rows = draw_starts(ics.sparkSession, n, blocks, boot, seed, draws).join(upto, ["horizon", "i"])
    rows = rows.join(upto.select(*key, F.col("i").alias("to"), F.col("s").alias("s2"), F.col("c").alias("c2")), [*key, "to"])
    return rows.groupBy("horizon", "draw", "factor").agg(F.try_divide(F.sum(F.col("s2") - F.col("s")), F.sum(F.col("c2") - F.col("c"))).alias("mean"))


def bootstrap_null(ics: DataFrame, calendar_size: int, block: int, boot: int = 500, seed: int = 42, draws: str = "numpy") -> DataFrame:
    """draw, factor, mean of one horizon. ics has i (0-based row), factor, ic."""
    return grid_null(ics.withColumn("horizon", F.lit(0)), calendar_size, {0: block}, boot, seed, draws).drop("horizon")


def evidence(ics: DataFrame, null: DataFrame, blocks: dict[int, int], level: float = 0.05) -> DataFrame:
    """For each factor and horizon: n, mean, se (of the null), z, n_eff, naive_t, p (own null), p_family (largest |z| of each draw of the
    horizon), p_global (p_family times the number of horizons), critical_z, block, the verdicts by p_family and by p_global, within_10_percent.

    Bounds are strict: a p that equals the level is no pass. A z that isn't finite has p-values of 1.
    """
    if not 0 < level < 1:
        raise ValueError("the level is within (0, 1)")
    key = ["factor", "horizon"]
    se = null.groupBy(*key).agg(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("se"))
    real = ics.groupBy(*key).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    z = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).when(F.col("mean") != 0, F.signum("mean") * float("inf")).otherwise(0.0)
    rows = real.join(se, key).withColumns({"z": z, "n_eff": F.col("n") / F.col("horizon")})
    rows = rows.withColumn("naive_t", F.try_divide("mean", "sd") * F.sqrt("n_eff")).drop("sd")
    zs = null.filter("mean is not null").join(se, key).withColumn("z0", F.when(F.col("se") > 0, F.abs("mean") / F.col("se")).otherwise(0.0))
    most = zs.groupBy("horizon", "draw").agg(F.max("z0").alias("z0"))
    critical = most.groupBy("horizon").agg(F.percentile("z0", F.lit(0.95)).alias("critical_z"))
    share = lambda name: ((1 + F.count_if(F.col("z0") >= F.abs("z"))) / (1 + F.count("z0"))).alias(name)
    own = rows.select(*key, "z").join(zs.select(*key, "z0"), key).groupBy(*key).agg(share("p"))
    family = rows.select(*key, "z").join(most, "horizon").groupBy(*key).agg(share("p_family"))
    out = rows.join(own, key).join(family, key).join(critical, "horizon")
    endless = F.abs("z") == float("inf")
    out = out.withColumns({p: F.when(endless, 1.0).otherwise(F.col(p)) for p in ("p", "p_family")})
    length = F.create_map(*(F.lit(x) for h, b in sorted(blocks.items()) for x in (h, b)))
    out = out.withColumns({"p_global": F.least(F.lit(1.0), F.col("p_family") * len(blocks)), "block": F.element_at(length, F.col("horizon"))})
    verdict = lambda p: F.when(F.col(p) < level, "PASS").otherwise("REJECT")
    return out.withColumns({"verdict_horizon": verdict("p_family"), "verdict": verdict("p_global"), "within_10_percent": F.col("p_global") < 0.10}).select(*key, *(c for c in out.columns if c not in key), "verdict_horizon", "verdict", "within_10_percent")


def z_outliers(df: DataFrame, x: str, by: str, k: float = 3.0) -> DataFrame:
    w = Window.partitionBy(by)
    z = F.try_divide(F.abs(F.col(x) - F.avg(x).over(w)), F.stddev_samp(x).over(w))
    return df.withColumn("outlier", F.coalesce(z > k, F.lit(False)))


def iqr_outliers(df: DataFrame, x: str, by: str, k: float = 1.5) -> DataFrame:
    w = Window.partitionBy(by)
    rows = df.withColumn("_q", F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(w))
    reach = k * (F.col("_q")[1] - F.col("_q")[0])
    return rows.withColumn("outlier", F.coalesce((F.col(x) < F.col("_q")[0] - reach) | (F.col(x) > F.col("_q")[1] + reach), F.lit(False))).drop("_q")


def density_outliers(df: DataFrame, x: str, by: str, eps: float = 0.5, least: int = 5) -> DataFrame:
    """Outliers of DBSCAN in one dimension: standardised values with no core point within eps.

    A core point has ``least`` points (itself included) within eps; whether one is near is a range window.
    """
    w = Window.partitionBy(by)
    rows = df.withColumn("_z", F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w)))
    near = f"OVER (PARTITION BY `{by}` ORDER BY _z RANGE BETWEEN {eps!r}D PRECEDING AND {eps!r}D FOLLOWING)"
    rows = rows.withColumn("_core", (F.expr(f"count(_z) {near}") >= least).cast("int"))
    return rows.withColumn("outlier", F.col("_z").isNotNull() & (F.expr(f"max(_core) {near}") == 0)).drop("_z", "_core")
