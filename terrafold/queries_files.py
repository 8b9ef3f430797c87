"""Queries that write tables, files and streams in the engine's layouts and read them back, each with SQL for another engine.

Each call works in a folder of its own under spark.checkpoint.dir. What is written is derived from the star schema's
tables by Spark (sources/star.py)."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold import queries as core
from terrafold.operators import catalog, climate_index, grid, quarantine, raster, season
from terrafold.plans import jobs
from terrafold.queries import DAILY, POINTS, SEASON, YEARLY, Query, daily, points, results, seasoned, table, yearly
from terrafold.sinks import cube as cube_sink
from terrafold.sinks import tables, tiff
from terrafold.sources import bounds, geotiff, index_text, season_tree
from terrafold.sources.files import scratch
from terrafold.streaming import live_scan

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- cubes ---------------------------------------------------------------------------------------------------------

_CUBE_GRID = grid.Grid(lat0=-1.0, lon0=-80.0, step=0.5, rows=16, cols=8)
_CELLS = "cells AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 16 AS INTEGER) AS row, CAST(l_suppkey // 16 % 8 AS INTEGER) AS col, CAST(sum(l_quantity) AS BIGINT) % 4096 / 4.0e0 AS value FROM lineitem GROUP BY ALL)"


def _cells(spark, d) -> DataFrame:
    at = [F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 16).cast("int").alias("row"), (F.floor(F.col("l_suppkey") / 16) % 8).cast("int").alias("col")]
    return table(spark, d, "lineitem").groupBy(*at).agg((F.sum("l_quantity").cast("long") % 4096 / 4.0).alias("value"))


def _cube_file(spark, d, time: str = "time", units: str | None = None) -> tuple[str, dt.date]:
    cells = _cells(spark, d)
    span = cells.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    path = f"{scratch(spark, 'cube')}/cube.nc"
    cube_sink.write(cells, _CUBE_GRID, path, span["a"], span["b"], "rain", time, units)
    return path, span["a"]


@query(f"WITH {_CELLS} SELECT * FROM cells")
def cube_daily(spark, d):
    path, _ = _cube_file(spark, d)
    return jobs.open_cube(spark, path, _CUBE_GRID).where("value IS NOT NULL")


@query(f"WITH {_CELLS} SELECT * FROM cells WHERE date >= (SELECT min(date) + 400 FROM cells)")
def cube_legacy(spark, d):
    """An axis of another name whose units name no day, and bounds that reach the file."""
    path, first = _cube_file(spark, d, "z", "step")
    return jobs.open_cube(spark, path, _CUBE_GRID, start=first, first=first + dt.timedelta(days=400)).where("value IS NOT NULL")


@query(f"WITH {_CELLS} SELECT 'rain' AS variable, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(row * 8 + col AS INTEGER) AS id, date, CAST(value AS FLOAT) AS value FROM cells")
def cube_months(spark, d):
    """From the file to the monthly layout at points on the grid's nodes, twice: the second run leaves the same rows."""
    path, _ = _cube_file(spark, d)
    out = f"{scratch(spark, 'months')}/climate"
    at = grid.nodes(spark, _CUBE_GRID)
    for _ in range(2):
        jobs.prepare_file(spark, path, at, "rain", _CUBE_GRID, out, amounts=True)
    return spark.read.parquet(out).where("value IS NOT NULL").select("variable", "year", "month", "id", "date", "value")


@query(f"""WITH {_CELLS}, nodes AS (SELECT CAST(k AS BIGINT) AS id, (k % 15) / 2.0e0 AS fx, (k // 15) / 2.0e0 AS fy FROM range(0, 31 * 15) t(k)),
    placed AS (SELECT *, least(CAST(floor(fx) AS INTEGER), 6) AS j, least(CAST(floor(fy) AS INTEGER), 14) AS i FROM nodes),
    corner AS (SELECT id, i + di AS row, j + dj AS col, (CASE di WHEN 1 THEN fy - i ELSE 1 - fy + i END) * (CASE dj WHEN 1 THEN fx - j ELSE 1 - fx + j END) AS weight FROM placed, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(di, dj))
    SELECT id, date, round(sum(weight * value) / sum(weight), 9) AS value FROM corner JOIN cells USING (row, col) WHERE weight > 0 GROUP BY id, date""")
def finer_grid(spark, d):
    """The cells resampled to a grid of half the step."""
    fine = grid.nodes(spark, grid.Grid(lat0=-1.0, lon0=-80.0, step=0.25, rows=31, cols=15))
    corners = grid.bilinear_corners(fine, lon0=-80.0, lat0=-1.0, dx=0.5, dy=-0.5, cols=8, rows=16)
    return grid.bilinear(_cells(spark, d), corners).withColumn("value", F.round("value", 9))


# ---- tables --------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {core._RESULTS} SELECT * FROM results")
def season_store(spark, d):
    """Results by season and region, written twice."""
    out = scratch(spark, "seasons")
    rows = results(spark, d)
    for _ in range(2):
        tables.write_seasons(rows, out)
    return spark.read.schema(rows.schema).parquet(out)


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {core._COVERAGE} SELECT * FROM coverage")
def coverage_records(spark, d):
    out = scratch(spark, "coverage")
    report = season.coverage(seasoned(spark, d))
    tables.write_coverage(report, out)
    return spark.read.schema(report.schema).json(out)


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {core._COVERAGE} SELECT s.season, 'of ' || s.region AS period, s.region, count(*) AS n, any_value(truncated) AS truncated FROM seasoned s JOIN coverage c ON c.year = s.season AND c.region = s.region GROUP BY ALL")
def season_files(spark, d):
    """A tree of a folder for each year, period and region, with a record of coverage beside the files."""
    root, rows = scratch(spark, "tree"), results(spark, d)
    for r in season.coverage(seasoned(spark, d)).collect():  # years times regions
        at = f"{root}/{r['year']}/of {r['region']}/{r['region']}"
        rows.where((F.col("season") == r["year"]) & (F.col("region") == r["region"])).select("id", "date", "bu").coalesce(1).write.parquet(at)
        record = json.dumps({"truncated": r["truncated"], "n_days": r["n_days"]}, indent=1)
        spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("append").text(at)
    found = season_tree.read(spark, root).groupBy("season", "period", "region").agg(F.count(F.lit(1)).alias("n"))
    return found.join(season_tree.read_coverage(spark, root, "*.txt").select("season", "period", "region", "truncated"), ["season", "period", "region"])


@query("SELECT l_returnflag AS flag, count(*) > 0 AS unreadable FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def broken_files(spark, d):
    """Files that only look like Parquet, found by their ends."""
    root, rows = scratch(spark, "broken"), table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("string").alias("value"))
    rows.write.partitionBy("flag").parquet(f"{root}/all")
    rows.where("flag <> 'N'").write.partitionBy("flag").text(f"{root}/none")
    bad = season_tree.unreadable(spark, root, "part-*")
    return bad.select(F.regexp_extract("path", "flag=([^/]*)/", 1).alias("flag")).distinct().withColumn("unreadable", F.lit(True))


@query(f"WITH {DAILY} SELECT id, round(avg(rain), 5) AS rain, count(*) AS n FROM daily GROUP BY id")
def csv_report(spark, d):
    out = scratch(spark, "report")
    tables.write_report(daily(spark, d).groupBy("id").agg(F.avg("rain").alias("rain"), F.count(F.lit(1)).alias("n")), out)
    return spark.read.option("header", "true").schema("id long, rain double, n long").csv(out)


@query(f"WITH {core._PRESENT}, gone AS (SELECT variable, count(*) AS n FROM asked ANTI JOIN present USING (variable, year, month) GROUP BY variable) SELECT 'lineitem' AS source, p.variable, count(*) AS n_present, min(year * 100 + month) AS first, max(year * 100 + month) AS last, any_value(coalesce(g.n, 0)) AS n_missing FROM present p LEFT JOIN gone g USING (variable) GROUP BY p.variable")
def provenance_record(spark, d):
    out = scratch(spark, "provenance")
    layout = catalog.layout_report(core._present(spark, d), catalog.months(spark, 1995, 2001), ["A", "N", "R"])
    tables.write_summary(spark, tables.provenance(sources={"all": "lineitem"}, layout=layout, notes="a query"), out)
    kind = "sources map<string,string>, layout array<struct<variable:string,n_present:bigint,first:int,last:int,n_missing:bigint>>"
    record = spark.read.text(out, wholetext=True).select(F.from_json("value", kind).alias("r"))
    return record.select(F.col("r.sources")["all"].alias("source"), F.explode("r.layout").alias("l")).select("source", "l.*")


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {core._RESULTS} SELECT r.*, p.altitude, p.type FROM results r JOIN points p USING (id)")
def backfilled(spark, d):
    """Columns of the points that old results lack, added in place; a second call finds nothing to do."""
    out = f"{scratch(spark, 'backfill')}/results"
    tables.write_seasons(results(spark, d), out)
    for _ in range(2):
        tables.backfill(spark, out, points(spark, d), ("altitude", "type"))
    return spark.read.parquet(out)


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, (count(*) * 37) % 193 / 32.0e0 - 2 AS value FROM orders GROUP BY ALL")
def index_lines(spark, d):
    """A monthly index as text with a comment and uneven white space."""
    out = f"{scratch(spark, 'index')}/text"
    line = F.concat(F.when(F.col("month") % 2 == 0, "  ").otherwise(""), F.col("year"), F.lit("  "), F.col("month"), F.lit("\t"), F.col("value"))
    rows = core.monthly_index(spark, d).select(line.alias("value"))
    rows.unionByName(spark.createDataFrame([("% year month value",), ("",)], "value string")).write.text(out)
    return index_text.read(spark, out)


# ---- rasters -------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY}, {core._GEO} SELECT y_idx, x_idx, CAST(max(n) AS DOUBLE) AS value FROM daily JOIN px USING (id) GROUP BY y_idx, x_idx")
def raster_file(spark, d):
    p = points(spark, d)
    g = raster.geometry(p)
    pixels = raster.rasterize(daily(spark, d), p, g, "n", "max").groupBy("y_idx", "x_idx").agg(F.max("value").alias("value"))
    path = f"{scratch(spark, 'raster')}/n.tif"
    tiff.write(pixels, g, path, "float32", "largest n")
    return bounds.load(spark, geotiff.GeoTiff, path)


@query("""WITH r AS (SELECT CAST(s_suppkey // 40 AS INTEGER) AS y_idx, CAST(s_suppkey % 40 AS INTEGER) AS x_idx, CAST(s_suppkey AS DOUBLE) AS value FROM supplier WHERE s_suppkey % 3 <> 2)
    SELECT level, CAST(y_idx // step AS INTEGER) AS y_idx, CAST(x_idx // step AS INTEGER) AS x_idx, value FROM r, (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) l(level, step) WHERE y_idx % step = 0 AND x_idx % step = 0""")
def raster_tiles(spark, d):
    """Regions merged into one tiled file with overviews, all of whose levels are read."""
    parts = core._regional(spark, d)
    g = raster.Geometry(-81.0, 0.0, 0.25, 0.25, parts.agg(F.max("y_idx")).first()[0] + 1, 40)
    path = f"{scratch(spark, 'tiles')}/BU_2001.tif"
    jobs.merge_year(parts, {r: g for r in season.REGIONS}, path, "BU", 2001, "units", "1", "float32", layout="cog")
    out = None
    for level in range(4):
        pixels = bounds.load(spark, geotiff.GeoTiff, path, level=level).select(F.lit(level).alias("level"), "y_idx", "x_idx", "value")
        out = pixels if out is None else out.unionByName(pixels)
    return out


@query(f"""WITH {DAILY}, {POINTS}, {SEASON} SELECT season AS year, count(DISTINCT region)  AS n_paths FROM seasoned GROUP BY season""")
def raster_years(spark, d):
    """How many of its regions' files each year has, one a region."""
    root, rows = scratch(spark, "paths"), seasoned(spark, d)
    span = rows.agg(F.min("season").alias("a"), F.max("season").alias("b")).first()
    for r in rows.select("season", "region").distinct().collect():  # years times regions
        spark.range(1).coalesce(1).write.parquet(f"{root}/{r['season']}/{r['region']} season/{r['region']}")
    found, _ = season_tree.raster_paths(spark, root, span["a"], span["b"], {f"{r} season": r for r in season.REGIONS}, "*.parquet", strict=False)
    return spark.createDataFrame([(year, sum(x is not None for x in paths.values())) for year, paths in found.items()], "year int, n_paths long")


# ---- joins, series, seasons to run ---------------------------------------------------------------------------------


@query(f"WITH {DAILY}, {POINTS}, few AS (SELECT * FROM points WHERE id % 5 <> 0) SELECT d.id, d.date, d.rain, s.altitude, s.type FROM daily d LEFT JOIN few s USING (id)")
def lenient_join(spark, d):
    return season.lenient_lookup(daily(spark, d).select("id", "date", "rain"), points(spark, d).where("id % 5 <> 0"), "altitude", "type", "not there")


@query(f"""WITH {DAILY}, {POINTS}, {SEASON}, {core._COVERAGE}, span AS (SELECT CAST(year(min(date)) AS INTEGER) AS a, CAST(year(max(date)) AS INTEGER) AS b FROM daily),
    asked AS (SELECT CAST(y AS INTEGER) AS year, region, CASE region WHEN 'highland' THEN make_date(y, 11, 1) WHEN 'midland' THEN make_date(y, 4, 1) ELSE make_date(y, 7, 1) END AS start,
    CASE region WHEN 'highland' THEN make_date(y + 1, 4, 30) WHEN 'midland' THEN make_date(y, 7, 31) ELSE make_date(y, 12, 31) END AS "end" FROM span, range(a, b + 1) t(y), (VALUES ('highland'), ('midland'), ('lowland')) r(region))
    SELECT a.* FROM asked a, span WHERE year("end") <= b AND NOT EXISTS (SELECT 1 FROM coverage c WHERE c.year = a.year AND c.region = a.region AND NOT c.truncated)""")
def seasons_to_run(spark, d):
    """The seasons inside the data's years that have no whole result yet."""
    rows = seasoned(spark, d)
    span = daily(spark, d).agg(F.year(F.min("date")).alias("a"), F.year(F.max("date")).alias("b")).first()
    asked = season.tasks(spark, span["a"], span["b"], horizon=span["b"])
    return season.not_done(asked, season.coverage(rows)).select("year", "region", "start", "end")


@query(f"WITH {DAILY}, {POINTS}, {SEASON} SELECT id, season, region, count(*) AS n_days, greatest(0, count(*) - 4) AS n_scored FROM seasoned GROUP BY ALL")
def scored_days(spark, d):
    """Days of each series, and those that have a whole window: all but two at each end, none of a short series."""
    found = core.humid(spark, d).groupBy("id", "season", "region").agg(F.count(F.lit(1)).alias("n_scored"))
    every = seasoned(spark, d).groupBy("id", "season", "region").agg(F.count(F.lit(1)).alias("n_days"))
    return every.join(found, ["id", "season", "region"], "left").select("id", "season", "region", "n_days", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


@query(f"""WITH {DAILY}, {POINTS}, {SEASON}, odd AS (SELECT *, tdew > tmax AS dew, rain > 11.5 AS rainy FROM seasoned)
    SELECT id, season, region, list_filter([CASE WHEN bool_or(dew) THEN 'dew' END, CASE WHEN bool_or(rainy) THEN 'rainy' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons, count(*) FILTER (dew OR rainy) AS n_bad, count(*) AS n_rows FROM odd GROUP BY ALL HAVING bool_or(dew) OR bool_or(rainy)""")
def series_rejected(spark, d):
    """Series that break a rule, with their reasons."""
    report = quarantine.series_report(seasoned(spark, d), ("id", "season", "region"), {"dew": F.col("tdew") > F.col("tmax"), "rainy": F.col("rain") > 11.5}, unique="date")
    return report.withColumn("reasons", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")))


@query(f"""WITH {DAILY}, {POINTS}, {SEASON}, bad AS (SELECT DISTINCT id, season, region FROM seasoned WHERE tdew > tmax OR rain > 11.5)
    SELECT id, season, region, count(*) AS n_days FROM seasoned ANTI JOIN bad USING (id, season, region) GROUP BY ALL""")
def series_accepted(spark, d):
    rows, keys = seasoned(spark, d), ("id", "season", "region")
    report = quarantine.series_report(rows, keys, {"dew": F.col("tdew") > F.col("tmax"), "rainy": F.col("rain") > 11.5}, unique="date")
    return quarantine.without(rows, report, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"))


_WHOLE = "whole AS (SELECT id FROM yearly WHERE year BETWEEN 1995 AND 2000 GROUP BY id HAVING count(*) = 6)"


@query(f"WITH {YEARLY}, {_WHOLE} SELECT id, region, CAST(year - 1995 AS INTEGER) AS pos, CAST(app AS DOUBLE) AS y FROM yearly SEMI JOIN whole USING (id) WHERE year BETWEEN 1995 AND 2000")
def series_matrix(spark, d):
    """One array a point, in the order of years, of the points that have them all."""
    return _series(spark, d).select("id", "region", F.posexplode("y").alias("pos", "y"))


def _series(spark, d) -> DataFrame:
    rows = yearly(spark, d)
    whole = rows.where("year BETWEEN 1995 AND 2000").groupBy("id").count().where("count = 6")
    return climate_index.series_of(rows.join(whole, "id", "left_semi"), "app", list(range(1995, 2001)))


@query(f"""WITH {core._PSLOPE}, limits AS (SELECT id, list_sort(list(b))[CAST(ceil((count(*) - 1) * 0.95e0) AS INTEGER) + 1] AS least, max(b) AS most FROM other GROUP BY id)
    SELECT CAST(perm AS INTEGER) AS perm, count(*) FILTER (b >= least - 1e-9 AND most > 1e-9) AS hits FROM other JOIN limits USING (id) GROUP BY perm""")
def field_counters(spark, d):
    """How many points each permutation makes significant, from the vectors that tasks hand on."""
    found = climate_index.permutation_slopes(_series(spark, d), {r: core._X for r in season.REGIONS}, np.array(core._PERMS))
    return climate_index.hits_of(found)


# ---- jobs and streams ----------------------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, {POINTS}, {SEASON}, {core._RESULTS}, {core._COVERAGE}, y AS (SELECT id, season AS year, max(applications) AS app FROM results r JOIN coverage c ON c.year = r.season AND c.region = r.region WHERE NOT truncated GROUP BY id, season)
    SELECT p.id, CAST(coalesce(n, 0) AS INTEGER) AS n_years_app, CASE WHEN n >= 4 THEN round(slope, 6) + 0e0 END AS slope_app FROM points p LEFT JOIN (SELECT id, count(*) AS n, CASE WHEN max(app) = min(app) THEN 0e0 ELSE regr_slope(app, year) END AS slope FROM y GROUP BY id) s USING (id)""")
def trend_job(spark, d):
    """The job from daily results to trends on the point table; truncated seasons do not count."""
    found = jobs.run_trends(results(spark, d), points(spark, d), scratch(spark, "trends"), min_years=4)
    return found.select("id", F.coalesce("n_years_app", F.lit(0)).alias("n_years_app"), (F.round("slope_app", 6) + 0.0).alias("slope_app"))


_AGAIN = core._SCORED + """, j AS (SELECT s.id, s.date, s.bu, s.n, day(s.date) <> 7 AS old FROM scan s WHERE s.day > 0),
    t AS (SELECT count(*) FILTER (x <> y) AS n_ids_changed FROM (SELECT id, max(n) FILTER (old) AS x, max(n) AS y FROM j GROUP BY id))
    SELECT count(*) FILTER (old) AS n_common, CAST(0 AS BIGINT) AS n_only_old, count(*) FILTER (NOT old) AS n_only_new, CAST(0 AS DOUBLE) AS max_diff_applications,
    CAST(max(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) FILTER (old) AS DOUBLE) AS max_diff_bu, CAST(0 AS DOUBLE) AS max_diff_fu, any_value(n_ids_changed) AS n_ids_changed FROM j, t"""


@query(_AGAIN)
def rerun_compared(spark, d):
    """All points scored again from the long table, against results that lack each month's seventh and differ in a column."""
    rows = daily(spark, d)
    wide = rows.select("id", "date", F.year("date").alias("year"), F.month("date").alias("month"), "tmin", "tmax", "tdew", "rain")
    long = catalog.melt(wide, ["id", "date", "year", "month"], ["tmin", "tmax", "tdew", "rain"], "variable")
    p = points(spark, d)
    old = jobs.daily_results(rows.select("id", "date", "tmin", "tmax", "tdew", "rain"), p, "s").where("day(date) <> 7")
    old = old.withColumn("bu", F.col("bu") + (F.col("id") % 4 == 0).cast("int"))
    return jobs.rerun_sample(old, long, p, 1 << 30, "1990-01-01", "2010-12-31", "s")


def _streamed(spark, d, decide) -> DataFrame:
    """The scan's days as a file stream that ends when all files are read, decided and written."""
    root = scratch(spark, "stream")
    rows = core._long_days(spark, d).drop("day")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    run = decide(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live_scan.OUT).parquet(f"{root}/out")


@query(f"WITH RECURSIVE {DAILY}, {core._LONG}, {core._scan_sql('longdays', 'ms')} {core._SCAN_OUT}")
def application_stream(spark, d):
    return _streamed(spark, d, lambda days: live_scan.decide(days, "ms"))


@query(f"WITH RECURSIVE {DAILY}, {core._LONG}, {core._scan_sql('longdays', 'ms')} {core._SCAN_OUT} AND date <= (SELECT max(date) - 10 FROM daily)")
def application_stream_late(spark, d):
    """Days in any order: those that the watermark, ten days behind the last, has passed."""
    return _streamed(spark, d, lambda days: live_scan.decide_late(days, "ms", delay_days=10))
