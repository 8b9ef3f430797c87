"""From daily variables to humid hours per day: joins, shifts along a series, and the humidity window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.checks import nan_to_null, option, require
from terrafold.functions import diurnal, solar

VARIABLES = {"tmin": "tmin", "tmax": "tmax", "tdew": "tdew", "rain": "rain"}


def read_window(long: DataFrame, variable: str, start: str, end: str, ids: list[int] | DataFrame | None = None) -> DataFrame:
    """(id, date, value) of one variable between two days, both included. Filters reach the scan: variable and month are
    partition columns, id and date are sorted inside files. Missing rain counts as none; other values stay missing."""
    months = (F.col("year") * 12 + F.col("month")).between(int(start[:4]) * 12 + int(start[5:7]), int(end[:4]) * 12 + int(end[5:7]))
    out = long.where((F.col("variable") == variable) & months & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if isinstance(ids, DataFrame):
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    elif ids is not None:
        out = out.where(F.col("id").isin(ids))
    value = nan_to_null(F.col("value").cast("double"))
    return out.select("id", "date", (F.coalesce(value, F.lit(0.0)) if variable == "rain" else value).alias("value"))


def join_variables(parts: dict[str, DataFrame]) -> DataFrame:
    """Inner join of several (id, date, value) tables on (id, date), one column for each; each key once in each table.

    One shuffle: the union is grouped by key, and a key stays only where every variable has a row, missing or not."""
    names = sorted(parts)
    rows = None
    for k, name in enumerate(names):
        part = parts[name].select("id", "date", F.lit(k).alias("k"), F.col("value").cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy("id", "date").agg(
        *[F.max(F.when(F.col("k") == k, F.col("value"))).alias(name) for k, name in enumerate(names)],
        *[F.max((F.col("k") == k).cast("int")).alias(f"_has{k}") for k in range(len(names))],
    )
    there = [F.col(f"_has{k}") == 1 for k in range(len(names))]
    keep = there[0]
    for t in there[1:]:
        keep = keep & t
    return wide.where(keep).select("id", "date", *names)


def sun_times(daily: DataFrame, points: DataFrame | None = None, offset: float = -5.0) -> DataFrame:
    """daily with sunrise and sunset of its (id, date); lat and lon are its own columns, or those of the points.

    Everything follows from the row, so the series is read once and not shuffled for it."""
    rows = daily if points is None else daily.join(points.select("id", "lat", "lon"), "id")
    rows = rows.withColumns(solar.day_terms(F.col("date")))
    rise, set_ = solar.sun_hours(F.col("lat"), F.col("lon"), F.col("declination"), F.col("equation_of_time"), offset)
    return rows.withColumns({"sunrise": rise, "sunset": set_}).drop("declination", "equation_of_time", "lat", "lon")


def humid_days(daily: DataFrame, keys: tuple[str, ...] = ("id", "season"), threshold: float = 90.0, method: str = "arrow") -> DataFrame:
    """daily: keys, date, tmin, tmax, tdew, rain, sunrise, sunset. Per series (a value of the keys, by date) the humid
    hours and their mean temperature of the window that ends at each day's noon; the first two and last two days of a
    series have no whole window and are left out, as are series of fewer than five days. Neighbours are the next rows,
    whatever their date. All shifts share one window, so there is one shuffle and one sort; `day` counts a series' rows
    that are left, from 1.

    A task's output holds whole series, sorted by the keys and the day. method "arrow" computes the curve in numpy; "sql" in array expressions only."""
    option(method, ("arrow", "sql"), "method")
    require(daily, *keys, "date", "tmin", "tmax", "tdew", "rain", "sunrise", "sunset")
    w = Window.partitionBy(*keys).orderBy("date")
    names = ("tmin", "tmax", "tdew", "sunrise", "sunset")
    shifted = daily.select(
        *keys, "date", *names, "rain",
        *[F.lag(n, 1).over(w).alias(f"{n}1") for n in names],
        *[F.lag(n, 2).over(w).alias(f"{n}2") for n in ("tmin", "tmax", "sunrise", "sunset")],
        F.lead("tmin", 1).over(w).alias("tmin_next"),
        F.row_number().over(w).alias("_at"), F.lead("date", 2).over(w).alias("_more"),
    ).where((F.col("_at") > 2) & F.col("_more").isNotNull())
    c = F.col
    if method == "arrow":
        result = diurnal.humid_window(threshold)(*[c(n) for n in names], *[c(f"{n}1") for n in names], *[c(f"{n}2") for n in ("tmin", "tmax", "sunrise", "sunset")], c("tmin_next"))
    else:
        result = _window_sql(threshold)
    found = shifted.withColumn("_w", result)
    return found.select(*keys, "date", (c("_at") - 2).alias("day"), c("_w.hours").alias("humid_hours"), c("_w.tmean").alias("humid_tmean"), "rain", ((c("tmin") + c("tmax")) / 2).alias("tavg"))


def _window_sql(threshold: float) -> Column:
    c = F.col
    yesterday = diurnal.hours_column(c("tmin1"), c("tmax1"), c("tmin"), c("sunrise1"), c("sunset1"), c("tmin2"), c("tmax2"), c("sunrise2"), c("sunset2"))
    today = diurnal.hours_column(c("tmin"), c("tmax"), c("tmin_next"), c("sunrise"), c("sunset"), c("tmin1"), c("tmax1"), c("sunrise1"), c("sunset1"))
    a, b, k, d = diurnal.BUCK
    e = lambda t: a * F.exp((b - t / k) * t / (d + t))
    hours = F.concat(
        F.transform(F.slice(yesterday, 13, 12), lambda t: F.struct(t.alias("t"), c("tdew1").alias("td"))),
        F.transform(F.slice(today, 1, 12), lambda t: F.struct(t.alias("t"), c("tdew").alias("td"))),
    )
    # bound to a variable, so that the array is computed once
    return F.transform(
        F.array(hours),
        lambda h: F.transform(
            F.array(F.filter(h, lambda x: 100.0 * e(x["td"]) / e(x["t"]) >= threshold)),
            lambda wet: F.struct(F.size(wet).alias("hours"), (F.aggregate(F.when(F.size(wet) > 0, wet).otherwise(h), F.lit(0.0), lambda s, x: s + x["t"]) / F.when(F.size(wet) > 0, F.size(wet)).otherwise(F.size(h))).alias("tmean")),
        )[0],
    )[0]
