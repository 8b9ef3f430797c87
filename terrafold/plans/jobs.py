"""The end-to-end jobs, each one lazy plan over all seasons at once, written by partition."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.checks import option
from terrafold.operators import catalog, climate, climate_index, grid, raster, scan, season, trend
from terrafold.sinks import cog, tables, tiff
from terrafold.sources import bounds, cube, files

STEPS = ("prepare", "scores", "rasters", "merge", "points", "trend", "index")


def prepare(cells: DataFrame, points: DataFrame, variable: str, g: grid.Grid, out: str, amounts: bool = False) -> None:
    """Cells (date, row, col, value) at the points, in the monthly layout; months already there are left alone."""
    mapping = grid.map_points(points, g)
    values = grid.extract_nodes(cells.withColumn("value", grid.clean(F.col("value"), not_negative=amounts)), mapping)
    long = values.select(F.lit(variable).alias("variable"), F.year("date").alias("year"), F.month("date").alias("month"), "id", "date", "value")
    tables.write_months(_new_months(long, out), out)


def prepare_bilinear(cells: DataFrame, points: DataFrame, variable: str, axes: dict, out: str, missing: str = "renormalize") -> None:
    """The same between the nodes of coarser cells; axes: lon0, lat0, dx, dy, cols, rows."""
    values = grid.bilinear(cells, grid.bilinear_corners(points, **axes), missing)
    long = values.select(F.lit(variable).alias("variable"), F.year("date").alias("year"), F.month("date").alias("month"), "id", "date", "value")
    tables.write_months(_new_months(long, out), out)


def open_cube(spark: SparkSession, path: str, g: grid.Grid, name: str | None = None, start: dt.date | None = None, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(date, row, col, value) of a cube file whose size, origin, order of dimensions and days are checked first.
    first, last: only these days; they become bounds on the steps, which reach the scan."""
    cube.check_grid(path, g.lat0, g.lon0, g.rows, g.cols, name)
    days = cube.days_of(path, start, name)
    cube.check_days(days)
    steps = spark.createDataFrame(list(enumerate(days)), "time int, date date")  # a row a day of the file
    asked = [k for k, day in enumerate(days) if (first is None or day >= first) and (last is None or day <= last)]
    cells = bounds.load(spark, cube.Netcdf, path, {"time": (min(asked, default=0), max(asked, default=-1) + 1)}, variable=name)
    return cells.join(F.broadcast(steps), "time").select("date", "row", "col", "value")


def prepare_file(spark: SparkSession, path: str, points: DataFrame, variable: str, g: grid.Grid, out: str, start: dt.date | None = None, name: str | None = None, amounts: bool = False) -> dict:
    """A cube file to the monthly layout, with a record of sources and layout beside it, which is returned."""
    cells = open_cube(spark, path, g, name, start)
    prepare(cells, points, variable, g, out, amounts)
    present = spark.read.parquet(out).select("variable", "year", "month").distinct()
    asked = cells.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct()
    record = tables.provenance(sources={variable: path}, layout=catalog.layout_report(present, asked, [variable]))
    tables.write_summary(spark, record, f"{out}/_provenance/{variable}")
    return record


def _new_months(long: DataFrame, out: str) -> DataFrame:
    spark = long.sparkSession
    try:
        done = spark.read.parquet(out).select("variable", "year", "month")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return long
    # the keys alone are listed: partition columns need no file to be read
    return catalog.to_do(long, done, "variable", "year", "month")


def daily_results(window: DataFrame, points: DataFrame, kind: str = "r", threshold: float = 90.0, offset: float = -5.0) -> DataFrame:
    """window (id, date, tmin, tmax, tdew, rain) to scored and treated days of all seasons."""
    keys = ("id", "season", "region")
    rows = climate.sun_times(season.assign(window, points, "lat", "lon"), offset=offset)
    return scan.by_batches(scan.scored(climate.humid_days(rows, keys, threshold), kind, keys), kind, keys, dealt=True)


def run_scores(long: DataFrame, points: DataFrame, out: str, start: str, end: str, kind: str = "r", asked: DataFrame | None = None) -> DataFrame:
    """Reads the four variables, scores all seasons, writes results and coverage; returns the coverage. Without a result
    there is only the coverage: of the seasons asked for (year, region, start, end), if they are named."""
    parts = {v: climate.read_window(long, v, start, end) for v in ("tmin", "tmax", "tdew", "rain")}
    results = season.strict_lookup(daily_results(climate.join_variables(parts), points, kind), points, "lon", "lat", "altitude")
    tables.write_seasons(results, f"{out}/daily")
    written = long.sparkSession.read.schema(results.schema).parquet(f"{out}/daily")
    report = season.coverage(written, asked)
    tables.write_coverage(report, f"{out}/coverage")
    return report


def run_trends(results: DataFrame, points: DataFrame, out: str, min_years: int = 10, years: tuple[int, int] | None = None, by: str = "season") -> DataFrame:
    """Yearly table of the seasons that are complete, and trends of its three metrics on the point table."""
    rows = season.without_truncated(results.withColumnRenamed("season", "year"), season.coverage(results)).withColumnRenamed("year", "season")
    yearly = season.lenient_lookup(season.reduce_seasons(rows, by), points, "lon", "lat", "altitude")
    yearly.write.mode("overwrite").parquet(f"{out}/yearly")
    written = results.sparkSession.read.parquet(f"{out}/yearly")
    stats = trend.on_grid(points, trend.ols(written, ("app", "sum_bu", "sum_fu"), min_years, years))
    stats.write.mode("overwrite").parquet(f"{out}/trends")
    return results.sparkSession.read.parquet(f"{out}/trends")


def run_rasters(results: DataFrame, points: DataFrame, out: str) -> None:
    """Pixel tables of all seasons: greatest count, sums of both scores; and the yearly merge, whose regions must not overlap."""
    g = raster.geometry(points)
    placed = raster.pixels_of(points, g).select("id", "y_idx", "x_idx")
    per = results.groupBy("id", "season", "region").agg(F.max("applications").alias("app"), F.sum("bu").alias("bu"), F.sum("fu").alias("fu"))
    pixels = placed.join(per, "id").select(F.col("season").alias("year"), "region", "y_idx", "x_idx", "app", "bu", "fu")
    pixels.write.mode("overwrite").partitionBy("year", "region").parquet(f"{out}/pixels")
    written = results.sparkSession.read.parquet(f"{out}/pixels")
    for v in ("app", "bu", "fu"):
        raster.sum_regions(written.withColumnRenamed(v, "value")).write.mode("overwrite").partitionBy("year").parquet(f"{out}/merged_{v}")


def merge_year(parts: DataFrame, geometries: dict[str, raster.Geometry], path: str, variable: str, year: int, description: str = "", units: str = "", kind: str = "int16", layout: str = "plain") -> dict[str, int]:
    """parts (region, y_idx, x_idx, value) of one year as one GeoTIFF, plain or ("cog") tiled with overviews, whose tags say what
    it holds; valid pixels by region.
    Regions on different grids, or with a value at the same pixel, are errors, and leave an older file as it is."""
    option(layout, ("plain", "cog"), "layout")
    g = raster.same_geometry(geometries)
    merged = raster.merge_regions(parts)
    valid = {r["region"]: r["n_pixels"] for r in raster.region_pixels(parts).orderBy("region").collect()}
    tags = {"variable": variable, "description": description, "units": units, "year": str(year), "regions_merged": "; ".join(f"{r} ({n} px)" for r, n in valid.items()), "n_valid_pixels": str(sum(valid.values()))}
    if layout == "cog":
        cog.write(merged, g, path, kind, f"{variable} - {description}", tags)
    else:
        tiff.write(merged, g, f"{path}.part", kind, f"{variable} - {description}", tags)
        files.rename(f"{path}.part", path)
    return valid


def rerun_sample(results: DataFrame, long: DataFrame, points: DataFrame, n: int, start: str, end: str, kind: str = "r", seed: int = 0) -> DataFrame:
    """Scores n sampled points again and compares them with the results there are: one row, as compare_runs() gives it."""
    ids = catalog.sample_ids(points, n, seed)
    some = points.join(F.broadcast(ids), "id", "left_semi")
    parts = {v: climate.read_window(long, v, start, end).join(F.broadcast(ids), "id", "left_semi") for v in ("tmin", "tmax", "tdew", "rain")}
    again = daily_results(climate.join_variables(parts), some, kind)
    return catalog.compare_runs(results.join(F.broadcast(ids), "id", "left_semi"), again, ["applications", "bu", "fu"])


def run_index(yearly: DataFrame, points: DataFrame, monthly: DataFrame, out: str, years: tuple[int, int], permutations: int = 5000) -> dict:
    """Season means of the index, permutation significance of every metric per point and field, and the unit table."""
    spark = yearly.sparkSession
    span = list(range(years[0], years[1] + 1))
    means = climate_index.season_means(monthly, climate_index.years_frame(spark, *years))
    by_region: dict[str, list[float]] = {}
    for r in means.orderBy("region", "year").collect():  # regions times years
        by_region.setdefault(r["region"], []).append(r["value"])
    perms = climate_index.block_permutations(len(span), permutations)
    summary: dict = {"years": list(years), "n_perm": permutations, "field": {}}
    for metric in ("app", "sum_bu", "sum_fu"):
        series = climate_index.series_of(yearly.join(points.select("id"), "id", "left_semi"), metric, span)
        climate_index.permutation_slopes(series, by_region, perms).write.mode("overwrite").parquet(f"{out}/permuted_{metric}")
        found = spark.read.parquet(f"{out}/permuted_{metric}")
        field = climate_index.field_significance(climate_index.point_significance(found), climate_index.hits_of(found)).first()
        summary["field"][metric] = field.asDict() if field else {}
        units = climate_index.unit_table(yearly.where(F.col("year").isin(span)), points, means, metric)
        tables.write_report(units, f"{out}/units_{metric}")
        tables.write_report(climate_index.unit_significance(units, by_region, span, perms), f"{out}/regressions_{metric}")
    tables.write_summary(spark, tables.provenance(**summary), f"{out}/summary")
    return summary


def run(steps: list[str], actions: dict[str, Callable[[], object]]) -> list[str]:
    """Runs the asked steps in their fixed order, whatever order they are asked in."""
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    done = []
    for s in STEPS:
        if s in steps and s in actions:
            actions[s]()
            done.append(s)
    return done


def session(app: str = "terrafold", **conf: str) -> SparkSession:
    """A session with what the plans rely on; sizes are left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
