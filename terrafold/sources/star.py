"""The star schema's tables read as climate data.

A supplier is a point; its line items of a day give that day's values (whole numbers over powers of two, so that every
sum is exact); its type, place and region follow from its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_of(lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """id, date, tmin, tmax, tdew, rain and the sums q, c, n that they come from.

    parts: the rows are dealt by (id, date) to so many tasks, which adaptive execution does not join; what groups by the
    same keys later needs no other shuffle, and all its tables hold such a part."""
    rows = lineitem.select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_linenumber")
    rows = rows.repartition(parts, "id", "date") if parts else rows
    sums = rows.groupBy("id", "date").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"), F.sum("l_linenumber").alias("n"))
    tmin = (F.col("q") % 64) / 8.0
    return sums.select("id", "date", tmin.alias("tmin"), (tmin + 6 + F.col("c") % 8).alias("tmax"), (tmin + (F.col("n") % 16) / 4.0 - 1).alias("tdew"), (((F.col("q") + 3 * F.col("c")) % 48) / 4.0).alias("rain"), "q", "c", "n")


def points_of(supplier: DataFrame) -> DataFrame:
    """id, lon, lat, altitude, type."""
    k = F.col("s_suppkey")
    altitude = (k * 37) % 4500
    kind = F.when(altitude >= 3000, "Sierra Alta [>3,000]").when(altitude >= 2000, "Sierra Media [2000-3000 masl]").when(altitude >= 500, "Interandino [500 - 2,000]").otherwise("Costa [0-500 msnm]")
    return supplier.select(k.alias("id"), (-81.0 + (k % 40) * 0.25).alias("lon"), (-0.5 - (k % 64) * 0.25).alias("lat"), altitude.cast("double").alias("altitude"), kind.alias("type"))
