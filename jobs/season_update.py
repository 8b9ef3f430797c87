"""Season scores brought up to date: takes the days after the last run's, and scores again the seasons they belong to.

    python -m jobs.season_update --observations PATH --points PATH --out PATH [--config jobs/season_update.json] [--since DAY]

Observations and points are read as climate data (terrafold/sources/star.py). Under --out lie

    daily      days of all points, by year and month, sorted by id
    rejected   for each season its number of rows (id NULL), and the series that break a rule, with their reasons
    seasons    a row for each point and season: treatments, sums of both scores, days; by year and region; NULL
               if the series was rejected
    coverage   first and last day of each season, and whether it is truncated; by year and region
    mark       the last day that has been taken

A run reads observations from the first day of the month after the mark on (the filter reaches the scan), replaces the
months and then the seasons that these days touch, whole, and moves the mark last. So a run that was cut short is made
good by the next one, which does the same work again; a run without anything new writes nothing. Days before the month
of the mark are taken once: if late rows arrive for them, --since names the day to take everything again from.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, start_logging, written
from terrafold.operators import climate, quarantine, scan, season
from terrafold.sources import star

DAILY = "id long, date date, tmin double, tmax double, tdew double, rain double, year int, month int"
SEASONS = "id long, app int, sum_bu long, sum_fu long, n_days long, year int, region string"
COVERAGE = "start date, end date, first date, last date, n_days long, n_ids long, truncated boolean, year int, region string"
REJECTED = "id long, reasons array<string>, n_bad long, n_rows long, season int, region string"
MARK = "taken_to date"
SERIES = ("id", "season", "region")
DEFAULTS = {"kind": "s", "threshold": 90.0, "utc_offset": -5.0, "rules": {"no_value": "tmin IS NULL OR tmax IS NULL OR tdew IS NULL", "crossed": "tmin > tmax"}}


def _replace(rows: DataFrame, path: str, parts: tuple[str, ...], order: tuple[str, ...]) -> int:
    """Writes rows over the partitions that they belong to, sorted inside files, and returns how many there were."""
    seen = Observation()
    dealt = rows.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", *parts).sortWithinPartitions(*parts, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(path)
    return seen.get["rows"]


def update(spark: SparkSession, observations: str, points: str, out: str, settings: dict | None = None, since: dt.date | None = None) -> dict:
    """One run; returns what it read and wrote."""
    settings = DEFAULTS | (settings or {})
    out = out.rstrip("/")
    mark = written(spark, f"{out}/mark", MARK)
    taken_to = mark and mark.agg(F.max("taken_to")).first()[0]
    if since is not None:
        taken_to = min(taken_to or since, since - dt.timedelta(days=1))
    source = spark.read.parquet(observations)
    if taken_to is not None:
        source = source.where(F.col("l_shipdate") >= F.lit(taken_to + dt.timedelta(days=1)).cast("timestamp"))
    span = source.agg(F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last")).first()
    if span["last"] is None:
        log.info("%s: nothing after %s", observations, taken_to)
        return {"taken_from": None, "taken_to": taken_to, "days": 0, "seasons": 0, "rejected": 0}
    month = span["first"].replace(day=1)
    rows = spark.read.parquet(observations).where(F.col("l_shipdate") >= F.lit(month).cast("timestamp"))
    days = star.daily_of(rows).select("id", "date", "tmin", "tmax", "tdew", "rain", F.year("date").alias("year"), F.month("date").alias("month"))
    n_days = _replace(days, f"{out}/daily", ("year", "month"), ("id", "date"))
    log.info("%s: %d days of points from %s to %s read and written to %s/daily", observations, n_days, month, span["last"], out)

    # the seasons that these months touch begin in the November before, at the earliest
    store = spark.read.schema(DAILY).parquet(f"{out}/daily").where(F.col("year") * 12 + F.col("month") >= (month.year - 1) * 12 + 11)
    _, end = season.season_window(F.col("season"), F.col("region"))
    touched = season.assign(store, star.points_of(spark.read.parquet(points)), "lat", "lon").where(end >= F.lit(month))
    report = quarantine.series_report(touched, SERIES, {name: F.expr(rule) for name, rule in settings["rules"].items()}, unique="date")
    # a row for each season, so that a season without rejected series replaces what an earlier run rejected
    sums = touched.groupBy("season", "region").agg(F.count(F.lit(1)).alias("n_rows"))
    sums = sums.select(F.lit(None).cast("long").alias("id"), "season", "region", F.array().cast("array<string>").alias("reasons"), F.lit(0).cast("long").alias("n_bad"), "n_rows")
    n_sums = _replace(report.unionByName(sums), f"{out}/rejected", ("season", "region"), ("id",))
    rejected = spark.read.schema(REJECTED).parquet(f"{out}/rejected").where(F.col("id").isNotNull() & (end >= F.lit(month)))
    rows = climate.sun_times(quarantine.without(touched, rejected, *SERIES), offset=settings["utc_offset"])
    scored = scan.scored(climate.humid_days(rows, SERIES, settings["threshold"]), settings["kind"], SERIES)
    treated = scan.by_batches(scored, settings["kind"], SERIES, dealt=True)
    columns = ("id", "app", "sum_bu", "sum_fu", "n_days", "year", "region")
    found = season.reduce_seasons(treated).select(*columns)
    nothing = rejected.select("id", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns[1:5]], F.col("season").alias("year"), "region")
    n_seasons = _replace(found.unionByName(nothing), f"{out}/seasons", ("year", "region"), ("id",))
    n_coverage = _replace(season.coverage(touched), f"{out}/coverage", ("year", "region"), ())
    n_rejected = n_sums - n_coverage
    log.info("%s: %d rows of %d seasons written to %s/seasons, %d of them rejected", points, n_seasons, n_coverage, out, n_rejected)
    spark.createDataFrame([(span["last"],)], MARK).write.mode("overwrite").parquet(f"{out}/mark")
    return {"taken_from": month, "taken_to": span["last"], "days": n_days, "seasons": n_seasons, "rejected": n_rejected}


def result(spark: SparkSession, out: str) -> DataFrame:
    """The seasons as they stand, with whether each is truncated."""
    rows = spark.read.schema(SEASONS).parquet(f"{out}/seasons").where("app IS NOT NULL")
    cut = spark.read.schema(COVERAGE).parquet(f"{out}/coverage").select("year", "region", "truncated")
    return rows.join(F.broadcast(cut), ["year", "region"]).select("id", "year", "region", "app", "sum_bu", "sum_fu", "n_days", "truncated")


def main() -> None:
    parse = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("observations", "points", "out"):
        parse.add_argument(f"--{name}", required=True)
    parse.add_argument("--config")
    parse.add_argument("--since", type=dt.date.fromisoformat)
    given = parse.parse_args()
    start_logging()
    spark = SparkSession.builder.appName("season_update").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        update(spark, given.observations, given.points, given.out, given.config and config(spark, given.config), given.since)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
