"""Seasons, regions, reductions over a season, and coverage of what was asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.checks import lazily, option, require

REGIONS = ("highland", "midland", "lowland")
#: Of each region the months of its season, counted from January of the season's year (0), first and last.
SEASON_MONTHS = {"midland": (3, 6), "lowland": (6, 11), "highland": (10, 15)}
# Point types, as the point tables have them, and their regions.
TYPE_REGION = {
    "Sierra Alta [>3,000]": "highland",
    "Sierra Media [2000-3000 masl]": "midland",
    "Costa [0-500 msnm]": "lowland",
    "Interandino [500 - 2,000]": "lowland",
}
EDGE_DAYS = 2


def region_of(kind: Column) -> Column:
    out = None
    for name, region in TYPE_REGION.items():
        out = F.when(kind == name, region) if out is None else out.when(kind == name, region)
    return out


def split_regions(points: DataFrame) -> DataFrame:
    """points with region; types of no region give NULL."""
    return require(points, "type").withColumn("region", region_of(F.col("type")))


def strict_lookup(rows: DataFrame, points: DataFrame, *columns: str) -> DataFrame:
    """rows with columns of their point, right after id; an id without a point stops the run when it is met.

    Columns of the same name are replaced."""
    side = points.select("id", *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_known"))
    joined = rows.drop(*columns).join(side, "id", "left")
    checked = lazily(F.col("id"), F.col("_known").isNull(), "an id has no point").alias("id")
    return joined.select(checked, *[F.col(f"_p_{c}").alias(c) for c in columns], *[c for c in rows.columns if c not in ("id", *columns)])


def lenient_lookup(rows: DataFrame, points: DataFrame, *columns: str) -> DataFrame:
    """rows with those columns of the point that the point table has; unknown ids get NULL.

    An id that the point table has more than once stops the run when it is met, so rows cannot multiply."""
    there = [c for c in columns if c in points.columns]
    if not there:
        return rows
    side = points.groupBy("id").agg(*[F.first(c).alias(c) for c in there], F.count(F.lit(1)).alias("_times"))
    joined = rows.drop(*there).join(side, "id", "left")
    checked = lazily(F.col("id"), F.coalesce(F.col("_times"), F.lit(0)) > 1, "an id has more than one point").alias("id")
    return joined.select(*[checked if c == "id" else F.col(c) for c in rows.columns if c not in there], *there)


def season_year(date: Column, region: Column) -> Column:
    """The year a day's season is named by: the highland season runs from November to April of the next year."""
    return F.year(date) - F.when((region == "highland") & (F.month(date) <= 4), 1).otherwise(0)


def in_season(date: Column, region: Column) -> Column:
    m = F.month(date)
    return F.when(region == "highland", (m >= 11) | (m <= 4)).when(region == "midland", m.between(4, 7)).when(region == "lowland", m.between(7, 12)).otherwise(False)


def season_window(year: Column, region: Column) -> tuple[Column, Column]:
    """First and last day of a season."""
    first = F.when(region == "highland", F.make_date(year, F.lit(11), F.lit(1))).when(region == "midland", F.make_date(year, F.lit(4), F.lit(1))).otherwise(F.make_date(year, F.lit(7), F.lit(1)))
    last = F.when(region == "highland", F.make_date(year + 1, F.lit(4), F.lit(30))).when(region == "midland", F.make_date(year, F.lit(7), F.lit(31))).otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    return first, last


def assign(daily: DataFrame, points: DataFrame, *carry: str) -> DataFrame:
    """daily (id, date, ...) with region, season and columns `carry` of the point; days outside their region's season are
    left out."""
    rows = daily.join(split_regions(points).select("id", "region", *carry), "id").where(F.col("region").isNotNull())
    return rows.where(in_season(F.col("date"), F.col("region"))).withColumn("season", season_year(F.col("date"), F.col("region")))


def tasks(spark, first_year: int, last_year: int, horizon: int | None = None, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """(year, region, start, end) of every season to run; a season that ends after the horizon's year is left out."""
    names = spark.createDataFrame([(r,) for r in regions], "region string")
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    start, end = season_window(F.col("year"), F.col("region"))
    out = years.join(names, how="cross").withColumns({"start": start, "end": end})  # years times regions: tens of rows
    return out if horizon is None else out.where(F.year("end") <= horizon)


def pairs(periods: dict[str, tuple[str, ...]], regions: tuple[str, ...] = REGIONS, asked: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(region, period) that can be run: each region's own periods, and of those the asked ones, in the regions' order.

    A pair that is asked for but does not exist is an error that names it."""
    unknown = set(periods) - set(regions)
    option(min(unknown, default=regions[0]), regions, "region")
    valid = [(r, p) for r in regions for p in periods.get(r, ())]
    wrong = [x for x in asked or () if x not in valid]
    if wrong:
        raise ValueError(f"no such region and period: {', '.join('/'.join(x) for x in wrong)}")
    return [x for x in valid if asked is None or x in asked]


def not_done(asked: DataFrame, report: DataFrame | None, force: bool = False) -> DataFrame:
    """The seasons (year, region, ...) of asked that have no record in a coverage report yet, or whose record says that
    they are truncated; all of them with `force` or without a report."""
    if force or report is None:
        return asked
    done = report.where(~F.coalesce("truncated", F.lit(True))).select("year", "region").distinct()
    return asked.join(done, ["year", "region"], "left_anti")


def reduce_seasons(results: DataFrame, by: str = "season") -> DataFrame:
    """Per id and year: app (greatest count), sum_bu, sum_fu, n_days. by "season" keeps (season, region) apart;
    "calendar" takes the day's year and merges what seasons give it; its region is that of the latest season."""
    option(by, ("season", "calendar"), "by")
    sums = [F.max("applications").cast("int").alias("app"), F.sum("bu").alias("sum_bu"), F.sum("fu").alias("sum_fu"), F.count(F.lit(1)).alias("n_days")]
    if by == "season":
        return results.groupBy("id", "season", "region").agg(*sums).withColumnRenamed("season", "year")
    return results.groupBy("id", F.year("date").alias("year")).agg(F.max_by("region", F.struct("season", "region")).alias("region"), *sums).select("id", "year", "region", "app", "sum_bu", "sum_fu", "n_days")


def coverage(results: DataFrame, asked: DataFrame | None = None, edge: int = EDGE_DAYS) -> DataFrame:
    """Per (season, region): first, last, n_days, n_ids, truncated (the asked window is not reached within `edge` days).

    asked: year, region, start, end; seasons asked for that have no rows count as truncated."""
    found = results.groupBy("season", "region").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("n_days"), F.count_distinct("id").alias("n_ids")).withColumnRenamed("season", "year")
    if asked is None:
        start, end = season_window(F.col("year"), F.col("region"))
        found = found.withColumns({"start": start, "end": end})
    else:
        found = asked.select("year", "region", "start", "end").join(found, ["year", "region"], "left")
    cut = F.coalesce((F.col("last") < F.date_sub("end", edge)) | (F.col("first") > F.date_add("start", edge)), F.lit(True))
    return found.select("year", "region", "start", "end", "first", "last", F.coalesce("n_days", F.lit(0)).alias("n_days"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), cut.alias("truncated"))


def without_truncated(rows: DataFrame, report: DataFrame) -> DataFrame:
    """rows (year, region) of seasons that are not known to be truncated; a season without a record stays."""
    cut = report.where(F.coalesce("truncated", F.lit(False))).select("year", "region").distinct()
    return rows.join(cut, ["year", "region"], "left_anti")


def season_climate(daily: DataFrame, hours: int = 7) -> DataFrame:
    """Per id and season: rain in total and number of days with at least so many humid hours."""
    return daily.groupBy("id", "season").agg(F.sum("rain").alias("rain"), F.count_if(F.col("humid_hours") >= hours).alias("wet_days"))
