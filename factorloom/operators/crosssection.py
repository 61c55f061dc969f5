"""Operators on one date's names: clipping, scaling, neutralising, ranks and buckets. One shuffle by date each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TINY = 1e-12


def day(by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by, "date")


def winsorize(df: DataFrame, x: str = "value", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """x clipped to the date's (interpolated) quantiles."""
    if not 0 <= lo < hi <= 1:
        raise ValueError("quantiles are in order and within [0, 1]")
    q = F.percentile(x, F.array(F.lit(lo), F.lit(hi))).over(day())
    clipped = F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col("_q")[1]), F.col("_q")[0]))
    return df.withColumn("_q", q).withColumn(x, clipped).drop("_q")


def standardize(df: DataFrame, x: str = "value") -> DataFrame:
    """x as deviations from the date's mean in population standard deviations; null where these are 0."""
    return df.withColumn(x, F.try_divide(F.col(x) - F.avg(x).over(day()), F.stddev_pop(x).over(day())))


def _z(x: Column, ok: Column | None = None, by: tuple[str, ...] = ()) -> Column:
    """Like standardize, for at least 2 values and a deviation above TINY."""
    w = day(by)
    good = (F.count(x).over(w) >= 2) & (F.stddev_pop(x).over(w) > TINY)
    return F.when(good if ok is None else good & ok, F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w)))


def neutralize(df: DataFrame, x: str = "value", industry: str = "industry", size: str | None = None, min_names: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    """x's residual on industry dummies (and log size), standardised: date, ticker, also (columns of df), value.

    The residual is the deviation from the industry's mean on the date; with size, what the slope of the
    deviations of log size explains is taken off, if those deviations vary.
    """
    if min_names < 2:
        raise ValueError("min_names is at least 2")
    ok = F.col(x).isNotNull() & F.col(industry).isNotNull()
    rows = df
    if size:
        rows = rows.withColumn("_s", F.when(F.col(size) > 0, F.log(size)))
        ok = ok & F.col("_s").isNotNull()
    rows = rows.withColumn("_y", F.when(ok, F.col(x)))
    group = Window.partitionBy("date", industry)
    rows = rows.withColumn("_r", F.col("_y") - F.avg("_y").over(group))
    if size:
        rows = rows.withColumn("_t", F.when(F.col("_y").isNotNull(), F.col("_s"))).withColumn("_t", F.col("_t") - F.avg("_t").over(group))
        slope = F.try_divide(F.sum(F.col("_t") * F.col("_r")).over(day()), F.sum(F.col("_t") * F.col("_t")).over(day()))
        rows = rows.withColumn("_r", F.col("_r") - F.coalesce(slope * F.col("_t"), F.lit(0.0)))
    enough = F.count("_r").over(day()) >= min_names
    return rows.select("date", "ticker", *also, _z(F.col("_r"), enough).alias("value"))


def neutralize_diagnostics(neutral: DataFrame) -> DataFrame:
    """A row for each date: names, and whether it has a result."""
    return neutral.groupBy("date").agg(F.count("*").alias("names"), (F.count("value") > 0).alias("valid"))


def neutralize_reasons(df: DataFrame, neutral: DataFrame, x: str = "value", industry: str = "industry", size: str | None = None, min_names: int = 10) -> DataFrame:
    """A row for each date of df: valid, reason (insufficient_names or constant_residual, else null), coverage, n_names, rank.

    coverage is the share of the names with a value that take part; rank is that of the design: an intercept for each industry,
    and log size if it varies within one. Names and rank are null where there is no result.
    """
    ok = F.col(x).isNotNull() & F.col(industry).isNotNull()
    s = F.lit(None).cast("double")
    if size:
        ok, s = ok & F.coalesce(F.col(size) > 0, F.lit(False)), F.log(F.when(F.col(size) > 0, F.col(size)))
    parts = df.groupBy("date", industry).agg(F.count(x).alias("_v"), F.count_if(ok).alias("_n"), F.coalesce(F.min(F.when(ok, s)) < F.max(F.when(ok, s)), F.lit(False)).alias("_varies"))
    days = parts.groupBy("date").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"), (F.count_if(F.col("_n") > 0) + F.max(F.col("_varies").cast("long"))).alias("_rank"))
    rows = days.join(neutralize_diagnostics(neutral).select("date", "valid"), "date", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    reason = F.when(F.col("_n") < min_names, "insufficient_names").when(~F.col("valid"), "constant_residual")
    return rows.select("date", "valid", reason.alias("reason"), F.coalesce(F.try_divide("_n", "_v"), F.lit(0.0)).alias("coverage"), F.when(F.col("valid"), F.col("_n")).alias("n_names"), F.when(F.col("valid"), F.col("_rank")).alias("rank"))


def industry_variants(df: DataFrame, x: str = "value", industry: str = "industry", strength: float = 0.5, min_names: int = 30, by: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """by, date, ticker, also (columns of df), raw, soft, strict: x, x less a part of its industry's mean, x less all of it; standardised within each group of ``by``."""
    if not 0 <= strength <= 1 or min_names < 2:
        raise ValueError("strength is within [0, 1] and min_names at least 2")
    ok = F.col(x).isNotNull() & F.col(industry).isNotNull()
    rows = df.withColumn("_y", F.when(ok, F.col(x))).withColumn("_m", F.when(F.col("_y").isNotNull(), F.avg("_y").over(Window.partitionBy(*by, "date", industry))))
    rows = rows.withColumns({"_soft": F.col("_y") - strength * F.col("_m"), "_strict": F.col("_y") - F.col("_m")})
    enough = (F.count("_y").over(day(by)) >= min_names) & (F.stddev_pop("_strict").over(day(by)) > TINY)
    return rows.select(*by, "date", "ticker", *also, _z(F.col("_y"), enough, by).alias("raw"), _z(F.col("_soft"), enough, by).alias("soft"), _z(F.col("_strict"), enough, by).alias("strict"))


def mean_rank(x: Column, by: tuple[str, ...] = ("date",)) -> Column:
    """Ranks from 1 with ties at their mean; null for null. One sort: a rank is midway between the first and the last of its equals."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count("*").over(w)) / 2)


def centered_rank(df: DataFrame, x: str = "value") -> DataFrame:
    """The date's rank share less the date's mean share; what is nearer to 0 than TINY is 0."""
    rows = df.withColumn("_p", mean_rank(F.col(x)) / F.count(x).over(day()))
    c = F.col("_p") - F.avg("_p").over(day())
    return rows.withColumn(x, F.when(F.abs(c) < TINY, 0.0).otherwise(c)).drop("_p")


def zscore_clip(df: DataFrame, x: str = "value", k: float = 3.0) -> DataFrame:
    """Clipped at k sample deviations from the mean, then standardised; 0 where nothing varies."""
    m, s = F.avg(x).over(day()), F.stddev_samp(x).over(day())
    rows = df.withColumns({"_m": m, "_s": s}).withColumn("_c", F.when(F.col(x).isNotNull(), F.greatest(F.least(F.col(x), F.col("_m") + k * F.col("_s")), F.col("_m") - k * F.col("_s"))))
    rows = rows.withColumns({"_cm": F.avg("_c").over(day()), "_cs": F.stddev_samp("_c").over(day())})
    flat = F.coalesce(F.col("_s") <= 0, F.lit(True)) | F.coalesce(F.col("_cs") <= 0, F.lit(True))
    return rows.withColumn(x, F.when(flat, 0.0).otherwise((F.col("_c") - F.col("_cm")) / F.col("_cs"))).drop("_m", "_s", "_c", "_cm", "_cs")


def buckets(df: DataFrame, x: str = "value", q: int = 5) -> DataFrame:
    """bucket 1..q of equal counts by x, ties by ticker; null for null."""
    if q < 2:
        raise ValueError("q is at least 2")
    n = F.count(x).over(day())
    nth = F.row_number().over(day().orderBy(F.col(x).asc_nulls_last(), "ticker"))
    bucket = F.greatest(F.lit(1), F.ceil((nth - 1) * q / F.greatest(n - 1, F.lit(1))))
    return df.withColumn("bucket", F.when(F.col(x).isNotNull(), bucket.cast("int")))


#: The named size buckets: side and how many, or a band of shares.
SIZE_BUCKETS = {
    "all": ("band", 0.0, 1.0),
    "mega_top100": ("top", 100, None),
    "smaller_half": ("band", 0.0, 0.5),
    "larger_half": ("band", 0.5, 1.0),
    "smallest150": ("bottom", 150, None),
}


def size_members(df: DataFrame, size: str, kind: str, a: float, b: float | None = None, member: str | None = None) -> DataFrame:
    """date, ticker, is_member: the a largest or smallest of the date's (base) members, or those whose share 1-(i+0.5)/n lies in [a, b]."""
    valid = F.col(size).isNotNull() & (F.col(member) if member else F.lit(True))
    rows = df.withColumn("_v", F.when(valid, F.col(size)))
    i = F.row_number().over(day().orderBy(F.col("_v").desc_nulls_last(), "ticker")) - 1
    n = F.count("_v").over(day())
    share = 1 - (i + 0.5) / n
    inside = {"top": i < a, "bottom": i >= n - a, "band": (share >= a) & (share <= (1.0 if b is None else b))}[kind]
    return rows.select("date", "ticker", (F.col("_v").isNotNull() & F.coalesce(inside, F.lit(False))).alias("is_member"))


def named_bucket(df: DataFrame, size: str, name: str, member: str | None = None) -> DataFrame:
    if name not in SIZE_BUCKETS:
        raise ValueError(f"unknown size bucket: {name}")
    return size_members(df, size, *SIZE_BUCKETS[name], member)
