"""Point-in-time joins: what was known on a date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.sources.shared import keep


def asof(left: DataFrame, right: DataFrame, value: str, key: str = "ticker", at: str = "date", since: str = "effective_date") -> DataFrame:
    """left with the value of right's last row (by ``since``, then greatest value) whose ``since`` isn't after ``at``.

    Both are put into one stream by key and time and the last value is carried on: one shuffle by the key, no range join.
    """
    marks = right.groupBy(key, since).agg(F.max(value).alias("_v")).select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), "_v")
    rows = left.withColumns({"_t": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    known = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, known).filter("_side = 1").drop("_t", "_side", "_v")


def reverse_changes(days: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """date, ticker, is_member of days (date, ticker): today's members with later changes undone.

    ``changes`` has effective_date, added, removed. The first change of a ticker after a date decides: one that
    was removed then was a member, one that was added was not. On one day "removed" goes before "added".
    """
    events = changes.select(F.col("removed").alias("ticker"), F.col("effective_date").alias("_t"), F.lit(0).alias("_kind")).unionByName(
        changes.select(F.col("added").alias("ticker"), F.col("effective_date").alias("_t"), F.lit(1).alias("_kind"))).filter("ticker is not null")
    events = events.groupBy("ticker", "_t").agg(F.min("_kind").alias("_kind"))
    rows = days.select("ticker", F.col("date").alias("_t"), F.lit(None).cast("int").alias("_kind"), F.col("date"))
    both = rows.unionByName(events.withColumn("date", F.lit(None).cast("date")))
    # backwards in time; on one day the date's row comes first, as only later changes are undone
    later = Window.partitionBy("ticker").orderBy(F.col("_t").desc(), F.col("date").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_next", F.last("_kind", ignorenulls=True).over(later)).filter("date is not null")
    now = current.select("ticker", F.lit(True).alias("_now")).distinct()
    return known.join(now, "ticker", "left").select("date", "ticker", F.when(F.col("_next") == 0, True).when(F.col("_next") == 1, False).otherwise(F.coalesce("_now", F.lit(False))).alias("is_member"))


def additions_only(days: DataFrame, members: DataFrame) -> DataFrame:
    """date, ticker, is_member: members (ticker, date_added) from the day they were added, or always if that is unknown."""
    m = members.groupBy("ticker").agg(F.min("date_added").alias("_since"), F.lit(True).alias("_in"))
    rows = days.join(m, "ticker", "left")
    return rows.select("date", "ticker", (F.coalesce("_in", F.lit(False)) & F.coalesce(F.col("date") >= F.col("_since"), F.col("_in"), F.lit(False))).alias("is_member"))


def mask(df: DataFrame, membership: DataFrame, x: str = "value") -> DataFrame:
    """x where the ticker is a member on the date, else null."""
    m = membership.filter("is_member").select("date", "ticker", F.lit(True).alias("_in"))
    return df.join(m, ["date", "ticker"], "left").withColumn(x, F.when(F.col("_in"), F.col(x))).drop("_in")


def coverage(df: DataFrame, x: str = "value", member: str | None = None) -> DataFrame:
    """For each date the share of (member) names that have x."""
    rows = df.filter(F.col(member)) if member else df
    return rows.groupBy("date").agg(F.count("*").alias("names"), F.avg(F.col(x).isNotNull().cast("double")).alias("coverage"))


def clean_constituents(raw: DataFrame) -> DataFrame:
    """ticker, sector, date_added of a list with Symbol, GICS Sector, Date added, seq: dots become dashes, the first of repeats stays."""
    t = F.regexp_replace(F.trim("Symbol"), r"\.", "-")
    rows = raw.select(t.alias("ticker"), F.trim("`GICS Sector`").alias("sector"), F.try_to_date("Date added").alias("date_added"), "seq").filter("ticker is not null and ticker != ''")
    first = Window.partitionBy("ticker").orderBy("seq")
    return rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", "seq")


@dataclass
class Universe:
    """membership: date, ticker, is_member of every name that ever was one. metadata: one row on how far it is point-in-time."""

    membership: DataFrame
    metadata: DataFrame
    basis: str


#: What a membership was made from.
REVERSED, ADDITIONS = "changes_reversed", "date_added_additions_only"


def universe(calendar: DataFrame, constituents: DataFrame, changes: DataFrame | None = None) -> Universe:
    """The members on each date of ``calendar`` (date), from today's ``constituents`` (ticker, sector, date_added).

    With a change log that has rows (effective_date, added, removed) the log is undone from today backwards, so names that left are
    there; without, members only begin, on the day they were added, and the metadata says so. Sectors are today's in both cases.
    """
    basis = ADDITIONS if changes is None or changes.isEmpty() else REVERSED
    names = constituents.select("ticker")
    if basis == REVERSED:
        names = names.unionByName(changes.select(F.col("added").alias("ticker"))).unionByName(changes.select(F.col("removed").alias("ticker")))
    names = names.filter("ticker is not null").distinct()
    dates = calendar.agg(F.sort_array(F.collect_set("date")).alias("c")).scalar()  # one array, as long as the period has dates
    days = names.select("ticker", F.explode(dates).alias("date"))
    membership = reverse_changes(days, constituents.select("ticker"), changes) if basis == REVERSED else additions_only(days, constituents)
    if basis == REVERSED:  # names that are members on no date aren't part of the universe, unless they are members today
        ever = membership.groupBy("ticker").agg(F.max("is_member").alias("_ever")).join(constituents.select("ticker", F.lit(True).alias("_now")).distinct(), "ticker", "left").filter("_ever or _now")
        membership = membership.join(ever.select("ticker"), "ticker", "left_semi")
    membership = keep(membership.select("date", "ticker", "is_member"))
    sizes = membership.groupBy("date").agg(F.count_if("is_member").alias("n"))
    at = lambda f: F.coalesce(f("n", "date"), F.lit(0).cast("long"))
    metadata = sizes.agg(at(F.min_by).alias("universe_size_start"), at(F.max_by).alias("universe_size_end")).select(
        F.lit(basis).alias("universe_membership_basis"), F.lit(basis == REVERSED).alias("membership_point_in_time"), F.lit(False).alias("classification_point_in_time"), "universe_size_start", "universe_size_end")
    return Universe(membership, metadata, basis)


def masked_industry(cells: DataFrame, members: DataFrame, sectors: DataFrame) -> DataFrame:
    """date, ticker, is_member, industry of cells (date, ticker): the name's sector (ticker, sector) where it is a member on the date."""
    m = members.filter("is_member").select("date", "ticker", F.lit(True).alias("_in"))
    s = sectors.groupBy("ticker").agg(F.min("sector").alias("_s"))
    rows = cells.select("date", "ticker").join(m, ["date", "ticker"], "left").join(s, "ticker", "left")
    inside = F.coalesce("_in", F.lit(False))
    return rows.select("date", "ticker", inside.alias("is_member"), F.when(inside, F.col("_s")).alias("industry"))


def member_coverage(industry: DataFrame) -> DataFrame:
    """One row: classification_coverage, the share of member cells with a known industry; 0 without any."""
    return industry.agg(F.coalesce(F.try_divide(F.count_if(F.col("is_member") & F.col("industry").isNotNull()), F.count_if("is_member")), F.lit(0.0)).alias("classification_coverage"))


def context(cells: DataFrame, constituents: DataFrame, changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For an experiment over cells (date, ticker): industry (date, ticker, is_member, industry), membership, and one row of metadata with coverage."""
    u = universe(cells.select("date").distinct(), constituents, changes)
    industry = keep(masked_industry(cells, u.membership, constituents))
    return industry, u.membership, u.metadata.join(member_coverage(industry), F.lit(True))  # one row each


def membership_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change log of a CSV with effective_date, added, removed (empty fields are null); rows without a date are left out. No rows if there is no file."""
    schema = "effective_date string, added string, removed string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path) if there else spark.createDataFrame([], schema)
    name = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return raw.select(F.try_to_date("effective_date").alias("effective_date"), name("added"), name("removed")).filter("effective_date is not null")
