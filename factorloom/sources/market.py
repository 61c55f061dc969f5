"""Price bars: scans, cleaning rules, and the dense panel that all operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factorloom.sources.shared import keep, tasks

OHLCV = ("Open", "High", "Low", "Close", "Volume")
RAW_BARS = T.StructType([T.StructField("Date", T.StringType()), *(T.StructField(c, T.StringType()) for c in OHLCV)])


def finite(c: Column) -> Column:
    """Null for NaN and both infinities: the one form of a missing value."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)  # NaN is above all; c is written out twice only, as these nest


def ohlcv_csv(spark: SparkSession, paths: list[str] | str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Raw bars from one CSV a ticker (``<ticker>_*.csv``): ticker, date (UTC), open..volume, seq (order within the file)."""
    raw = spark.read.schema(RAW_BARS).option("header", True).csv(paths)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "[_.]"), 1)
    rows = raw.select(name.alias("ticker"), F.to_date(F.to_utc_timestamp(F.try_to_timestamp("Date"), F.current_timezone())).alias("date"), *(F.col(c).try_cast("double").alias(c.lower()) for c in OHLCV), F.monotonically_increasing_id().alias("seq"))
    rows = rows.filter("date is not null")
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(sorted(set(tickers))))
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows


def sanitize(bars: DataFrame) -> DataFrame:
    """The last row of each (ticker, date) by ``seq``; impossible prices and volumes that aren't positive become null."""
    last = Window.partitionBy("ticker", "date").orderBy(F.col("seq").desc())
    rows = bars.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth", "seq")
    prices = ("open", "high", "low", "close")
    rows = rows.withColumns({c: finite(F.col(c)) for c in (*prices, "volume")})
    bad = F.lit(False)
    for c in prices:
        bad = bad | F.coalesce(F.col(c) <= 0, F.lit(False))
    bad = bad | F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False)) | F.coalesce(F.col("low") > F.least("open", "close", "high"), F.lit(False))
    return rows.withColumns({c: F.when(~bad, F.col(c)) for c in prices} | {"volume": F.when(F.col("volume") > 0, F.col("volume"))})


def load_metadata(bars: DataFrame) -> DataFrame:
    """A row for each ticker: how many bars, and the first and last date."""
    return bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """How many order lines there are, from the files' footers: about as many as a panel has rows, or more."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def lineitem_bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """Bars of suppliers from order lines: unit prices within a week (or month), their order fixed by four columns."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0")
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines.select(F.col("l_suppkey").cast("long").alias("ticker"), *order, px.alias("px"), F.col("l_quantity").cast("double").alias("q"))
    rows = rows.repartition(*tasks(spark, line_count(spark, sf_dir), scanned=True), "ticker")  # a supplier has hardly more than one line a week, so nothing is gained by adding up before; what is made of bars goes by ticker too
    rows = rows.select("ticker", F.date_trunc(grain, "l_shipdate").cast("date").alias("date"), F.struct(*order).alias("o"), "px", "q")
    return rows.groupBy("ticker", "date").agg(F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("q").alias("volume"))


def supplier_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and industry: the region of each supplier."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s = read("supplier").select(F.col("s_suppkey").cast("long").alias("ticker"), F.col("s_nationkey").alias("nk"))
    n = read("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"))
    r = read("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("industry"))
    return s.join(n, "nk").join(r, "rk").select("ticker", "industry")


def densify(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every ticker on every date of the calendar, with ``pos`` from 1. The calendar is one array, as long as the period has dates.

    ``dates`` are the bars' dates, repeated or not, where these are cheaper to have than the bars; else bars are made once and kept.
    A bar is followed by what is missing up to the ticker's next one, and the first led by what is missing before it: nothing is joined.
    """
    if dates is None:
        bars = keep(bars)
        dates = bars
    calendar = dates.agg(F.sort_array(F.collect_set("date")).alias("c")).scalar()
    by = Window.partitionBy("ticker").orderBy("date")
    at = F.coalesce(F.array_position(calendar, F.col("date")), F.lit(0)).cast("int")  # 0: no date
    rows = bars.withColumns({"_at": at, "_last": F.size(calendar)})
    rows = rows.withColumns({"_first": F.when(F.row_number().over(by) == 1, 1).otherwise(F.greatest("_at", F.lit(1))), "_to": F.greatest("_at", F.coalesce(F.lead("_at").over(by) - 1, "_last"))})
    rows = rows.withColumn("pos", F.explode(F.when(F.col("_first") <= F.col("_to"), F.sequence("_first", "_to"))))
    there = (F.col("pos") == F.col("_at")) & F.col("ticker").isNotNull()
    return rows.select("ticker", "pos", F.element_at(calendar, F.col("pos")).alias("date"), *(F.when(there, F.col(c)).alias(c) for c in bars.columns if c not in ("ticker", "date")))


def measures(dense: DataFrame) -> DataFrame:
    """The inputs of formulas: dollar volume, vwap (the mean of the four prices), adv20 and returns beside the prices."""
    by = Window.partitionBy("ticker").orderBy("pos")
    full = by.rowsBetween(-19, 0)
    rows = dense.withColumns({c: finite(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    rows = rows.withColumn("vwap", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    rows = rows.withColumnRenamed("volume", "reported_volume").withColumn("volume", F.col("vwap") * F.col("reported_volume"))
    return rows.withColumns({
        "adv20": F.when(F.count("volume").over(full) == 20, F.sum("volume").over(full) / 20),
        "returns": finite(F.try_divide("close", F.lag("close").over(by)) - 1),
    })


def panel(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """The dense panel of the suppliers' bars: date, pos, ticker, prices, volumes, returns, vwap, adv20."""
    dates = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0").select(F.date_trunc(grain, "l_shipdate").cast("date").alias("date"))
    return measures(densify(lineitem_bars(spark, sf_dir, grain), dates))
