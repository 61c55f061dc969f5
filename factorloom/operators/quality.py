"""Data quality: checks and scores of bars, and their cleaning. One job for all tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

PRICES = ("open", "high", "low", "close")


def rows_of() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def past() -> WindowSpec:
    return rows_of().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return rows_of().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def back() -> WindowSpec:
    """This row and all after it, from the last one: a frame that begins at each row would be read anew for each."""
    return Window.partitionBy("ticker").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)


def gaps(bars: DataFrame, days: int = 7) -> DataFrame:
    """ticker, date, gap_days: bars that come more than ``days`` after the one before."""
    rows = bars.select("ticker", "date", F.datediff("date", F.lag("date").over(rows_of())).alias("gap_days"))
    return rows.filter(F.col("gap_days") > days)


def business_days(start: str, end: str) -> Column:
    """An array of the Mondays to Fridays from start to end."""
    return F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.weekday(d) < 5)


def missing_days(bars: DataFrame, start: str, end: str) -> DataFrame:
    """ticker, date: business days from start to end without a bar of the ticker, of tickers that have any bar (an anti-join)."""
    expected = bars.select("ticker").distinct().select("ticker", F.explode(business_days(start, end)).alias("date"))
    return expected.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def completeness(bars: DataFrame, start: str, end: str, gap: int = 7) -> DataFrame:
    """ticker, bars, missing_values, missing_days, large_gaps, message: what is missing of each ticker; message is null if nothing is."""
    empty = sum((F.col(c).isNull().cast("int") for c in (*PRICES, "volume")), F.lit(0))
    rows = bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.sum(empty).alias("missing_values"))
    days = missing_days(bars, start, end).groupBy("ticker").agg(F.count("*").alias("missing_days"))
    wide = gaps(bars, gap).groupBy("ticker").agg(F.count("*").alias("large_gaps"))
    rows = rows.join(days, "ticker", "left").join(wide, "ticker", "left").fillna(0, ["missing_days", "large_gaps"])
    said = (F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + c.replace("_", " ")))) for c in ("missing_values", "missing_days", "large_gaps"))
    return rows.withColumn("message", F.nullif(F.concat_ws(", ", *said), F.lit("")))


#: The scores that a comparison has.
DIMENSIONS = ("overall", "completeness", "validity", "timeliness", "consistency")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each ticker of either version of the scores: each score before, after and its delta, the labels, and what became of it."""
    a = before.select("ticker", *(F.col(c).alias(f"{c}_before") for c in DIMENSIONS), F.col("label").alias("label_before"))
    b = after.select("ticker", *(F.col(c).alias(f"{c}_after") for c in DIMENSIONS), F.col("label").alias("label_after"))
    rows = a.join(b, "ticker", "full_outer").withColumns({f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in DIMENSIONS})
    moved = F.round("overall_delta", 9)
    status = F.when(F.col("overall_before").isNull(), "added").when(F.col("overall_after").isNull(), "removed").when(moved > 0, "improved").when(moved < 0, "worsened").otherwise("unchanged")
    return rows.withColumn("status", status)


def invalid(high_low_only: bool = True) -> Column:
    """A bar that can't be: open above high or close below low, or a volume that isn't positive."""
    bad = F.coalesce(F.col("open") > F.col("high"), F.lit(False)) | F.coalesce(F.col("close") < F.col("low"), F.lit(False))
    return bad if high_low_only else bad | F.coalesce(F.col("volume") <= 0, F.lit(False))


def scores(bars: DataFrame, expected: int, today: str, fresh_days: float = 7.0) -> DataFrame:
    """For each ticker: completeness, validity, timeliness, consistency, overall (all of 100) and a label.

    ``expected`` is how many bars the period should have, ``today`` the date that age is counted from.
    """
    cells = sum((F.col(c).isNull().cast("int") for c in (*PRICES, "volume")), F.lit(0))
    g = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.avg(cells / 5).alias("missing"), F.count_if(invalid(False)).alias("bad"), F.max("date").alias("last"))
    ratio = F.datediff(F.lit(today).cast("date"), "last") / fresh_days
    complete = F.least(F.lit(100.0), 100.0 * F.col("n") / expected) if expected else F.lit(100.0)
    rows = g.select("ticker", F.col("n").alias("rows"),
        (0.7 * complete + 0.3 * (1 - F.col("missing")) * 100).alias("completeness"),
        F.when(F.col("n") > 0, (F.col("n") - F.col("bad")) / F.col("n") * 100).otherwise(100.0).alias("validity"),
        F.when(ratio <= 1, 100.0).when(ratio <= 1.5, 100 - 100 * (ratio - 1)).otherwise(F.greatest(F.lit(0.0), 50 - 25 * (ratio - 1.5))).alias("timeliness"),
        F.lit(100.0).alias("consistency"))
    rows = rows.withColumn("overall", 0.3 * F.col("completeness") + 0.3 * F.col("validity") + 0.2 * F.col("timeliness") + 0.2 * F.col("consistency"))
    o = F.col("overall")
    return rows.withColumn("label", F.when(o >= 90, "Excellent").when(o >= 80, "Good").when(o >= 70, "Fair").when(o >= 60, "Poor").otherwise("Critical"))


def alerts(quality: DataFrame, floor: float = 70.0) -> DataFrame:
    """ticker, message, severity for each score under the floor."""
    named = quality.unpivot(["ticker"], ["completeness", "validity", "timeliness", "overall"], "check", "score").filter(F.col("score") < floor)
    return named.select("ticker", F.concat(F.col("check"), F.lit(" is low")).alias("message"), F.when(F.col("score") < floor / 2, "critical").otherwise("warning").alias("severity"))


def alert_counts(found: DataFrame) -> DataFrame:
    """severity, alerts, tickers."""
    return found.groupBy("severity").agg(F.count("*").alias("alerts"), F.countDistinct("ticker").alias("tickers"))


def mean_differences(a: DataFrame, b: DataFrame, most: float = 0.01) -> DataFrame:
    """ticker, column, difference of two versions of the bars where the columns' means differ by more than ``most``."""
    columns = [c for c in (*PRICES, "volume") if c in a.columns and c in b.columns]
    long_ = lambda d, n: d.groupBy("ticker").agg(*(F.avg(c).alias(c) for c in columns)).unpivot(["ticker"], columns, "column", n)
    rows = long_(a, "x").join(long_(b, "y"), ["ticker", "column"])
    return rows.withColumn("difference", F.abs(F.col("x") - F.col("y"))).filter(F.col("difference") > most).drop("x", "y")


def fill(bars: DataFrame, columns: tuple[str, ...] = (*PRICES, "volume"), method: str = "forward_fill") -> DataFrame:
    """Missing values: the last known (then the next known) one, a straight line between neighbours, or rows dropped."""
    if method == "drop":
        return bars.dropna(subset=list(columns))
    if method == "forward_fill":
        # the next known value is only needed before the first known one, which it then is
        return bars.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past()), F.first(c, ignorenulls=True).over(whole())) for c in columns})
    if method != "interpolate":
        raise ValueError("method is forward_fill, interpolate or drop")
    rows = bars.withColumn("_i", F.row_number().over(rows_of()))
    out = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct("_i", F.col(c).alias("v")))
        a, b = F.last(at, ignorenulls=True).over(past()), F.last(at, ignorenulls=True).over(back())
        out[c] = F.when(a.isNotNull() & b.isNotNull() & (b["_i"] > a["_i"]), a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["_i"]) / (b["_i"] - a["_i"])).otherwise(F.coalesce(a["v"], F.col(c)))
    return rows.withColumns(out).drop("_i")


def clip_outliers(bars: DataFrame, columns: tuple[str, ...] = (*PRICES, "volume"), method: str = "iqr", k: float = 3.0) -> DataFrame:
    """Each column clipped at k interquartile ranges beyond the quartiles, or k sample deviations from the mean, by ticker."""
    w = Window.partitionBy("ticker")
    rows = bars
    for i, c in enumerate(columns):
        if method == "iqr":
            q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(w)
            rows = rows.withColumn(f"_b{i}", F.struct((q[0] - k * (q[1] - q[0])).alias("lo"), (q[1] + k * (q[1] - q[0])).alias("hi")))
        else:
            m, s = F.avg(c).over(w), F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))
            rows = rows.withColumn(f"_b{i}", F.struct((m - k * s).alias("lo"), (m + k * s).alias("hi")))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_b{i}.hi")), F.col(f"_b{i}.lo"))) for i, c in enumerate(columns)}).drop(*(f"_b{i}" for i in range(len(columns))))


def repair_ohlc(bars: DataFrame) -> DataFrame:
    """High becomes the greatest and low the least of the four prices."""
    return bars.withColumns({"high": F.greatest(*PRICES), "low": F.least(*PRICES)})


def repair_volume(bars: DataFrame) -> DataFrame:
    """Volumes that aren't positive become the ticker's median of those that are."""
    median = F.percentile(F.when(F.col("volume") > 0, F.col("volume")), F.lit(0.5)).over(Window.partitionBy("ticker"))
    return bars.withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")).otherwise(median))


def fill_calendar(bars: DataFrame) -> DataFrame:
    """Every weekday from a ticker's first bar to its last; new rows take the last known values."""
    span = bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("ticker", F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return fill(days.join(bars, ["ticker", "date"], "left"))


def shift_dates(bars: DataFrame, today: str) -> DataFrame:
    """Each ticker's dates moved on by so many days that its last is ``today``; a ticker whose last date is not before it stays as it is."""
    late = F.datediff(F.lit(today).cast("date"), F.max("date").over(Window.partitionBy("ticker")))
    return bars.withColumn("date", F.date_add("date", F.greatest(late, F.lit(0))))


def clean(bars: DataFrame) -> DataFrame:
    """The whole cleaning, in its order: fill, repair prices and volumes, clip, weekdays."""
    return fill_calendar(clip_outliers(repair_volume(repair_ohlc(fill(bars)))))
