"""Rasters as pixel tables (y_idx, x_idx, value): geometry from points, values per point, merges of regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.checks import DataError, none_where

NODATA = -9999


@dataclass(frozen=True)
class Geometry:
    """West and north edge, cell size, and shape."""

    west: float
    north: float
    dx: float
    dy: float
    rows: int
    cols: int


def _least_gap(points: DataFrame, column: str) -> DataFrame:
    values = points.select(F.col(column).alias("v")).distinct()
    # distinct coordinates of a grid: as many as it has rows or columns
    gaps = values.select("v", (F.col("v") - F.lag("v").over(Window.orderBy("v"))).alias("gap"))
    return gaps.agg(F.min("gap").alias("gap"), F.min("v").alias("low"), F.max("v").alias("high"))


def geometry(points: DataFrame) -> Geometry:
    """Cells as wide as the least gap between coordinates, centred on the points."""
    x, y = _least_gap(points, "lon").first(), _least_gap(points, "lat").first()
    dx, dy = x["gap"] or 1.0, y["gap"] or 1.0
    return Geometry(x["low"] - dx / 2, y["high"] + dy / 2, dx, dy, int((y["high"] - y["low"]) / dy) + 1, int((x["high"] - x["low"]) / dx) + 1)


def pixels_of(points: DataFrame, g: Geometry) -> DataFrame:
    """points with y_idx and x_idx; fractions are cut off."""
    return points.withColumns({"x_idx": ((F.col("lon") - g.west) / g.dx).cast("int"), "y_idx": ((F.lit(g.north) - F.col("lat")) / g.dy).cast("int")})


def rasterize(results: DataFrame, points: DataFrame, g: Geometry, value: str, how: str = "max") -> DataFrame:
    """(y_idx, x_idx, value): the value per point of all its rows, at its pixel. Points without a result have no pixel."""
    per_id = results.groupBy("id").agg({"max": F.max, "sum": F.sum}[how](value).alias("value"))
    return pixels_of(points, g).join(per_id.where("value is not null"), "id").select("y_idx", "x_idx", "value")


def merge_regions(parts: DataFrame) -> DataFrame:
    """parts: region, y_idx, x_idx, value. One raster; two regions with a value at one pixel stop the run."""
    rows = parts.where(F.col("value").isNotNull() & (F.col("value") != NODATA))
    merged = rows.groupBy("y_idx", "x_idx").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    none_where(merged, F.col("_n") > 1, "regions overlap at")
    return merged.drop("_n")


def same_geometry(geometries: dict[str, Geometry]) -> Geometry:
    """The one geometry that all regions have; rasters of different grids are not merged."""
    first = next(iter(geometries.values()))
    other = [region for region, g in geometries.items() if g != first]
    if other:
        raise DataError(f"not on the grid of the others: {', '.join(other)}")
    return first


def region_pixels(parts: DataFrame) -> DataFrame:
    """Number of valid pixels of each region."""
    return parts.where(F.col("value").isNotNull() & (F.col("value") != NODATA)).groupBy("region").agg(F.count(F.lit(1)).alias("n_pixels"))


def sum_regions(parts: DataFrame) -> DataFrame:
    """parts: year, region, y_idx, x_idx, value. Per year and pixel the sum; a pixel is missing where all regions are."""
    return parts.where(F.col("value").isNotNull() & (F.col("value") != NODATA)).groupBy("year", "y_idx", "x_idx").agg(F.sum("value").alias("value"))


def value_range(stack: DataFrame) -> DataFrame:
    return stack.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def significant_blocks(pixels: DataFrame, p: str = "p", size: int = 10, alpha: float = 0.05, share: float = 0.5) -> DataFrame:
    """Blocks of size x size pixels most of whose points are significant: (block_y, block_x, share)."""
    by = pixels.groupBy(F.floor(F.col("y_idx") / size).cast("int").alias("block_y"), F.floor(F.col("x_idx") / size).cast("int").alias("block_x"))
    return by.agg(F.avg((F.col(p) < alpha).cast("double")).alias("share")).where(F.col("share") >= share)
