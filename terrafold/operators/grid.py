"""Points on a regular grid: node index, exact and bilinear extraction, and keys remapped through a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.checks import none_where, option, unique_key


@dataclass(frozen=True)
class Grid:
    """Row 0 is the northernmost. Node (row, col) lies at lat0 - row * step, lon0 + col * step."""

    lat0: float = 1.22
    lon0: float = -81.40
    step: float = 0.01
    rows: int = 1982
    cols: int = 1422

    def row_of(self, lat: Column) -> Column:
        return F.rint((F.lit(self.lat0) - lat) / self.step).cast("int")

    def col_of(self, lon: Column) -> Column:
        return F.rint((lon - F.lit(self.lon0)) / self.step).cast("int")


def nearest_nodes(points: DataFrame, grid: Grid) -> DataFrame:
    """points with row, col and gid of the nearest node."""
    row, col = grid.row_of(F.col("lat")), grid.col_of(F.col("lon"))
    return points.withColumns({"row": row, "col": col}).withColumn("gid", F.col("row").cast("long") * grid.cols + F.col("col"))


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """All nodes of a grid as points (id, lon, lat), to resample a coarser cube to it with bilinear()."""
    row, col = F.floor(F.col("id") / grid.cols), F.col("id") % grid.cols
    return spark.range(grid.rows * grid.cols).select("id", (F.lit(grid.lon0) + col * grid.step).alias("lon"), (F.lit(grid.lat0) - row * grid.step).alias("lat"))


def map_points(points: DataFrame, grid: Grid, tolerance: float = 1e-5) -> DataFrame:
    """nearest_nodes of points that must lie on nodes of the grid (within `tolerance` cells), inside it, one a node."""
    out = nearest_nodes(points, grid)
    off = F.greatest(F.abs((F.lit(grid.lat0) - F.col("lat")) / grid.step - F.col("row")), F.abs((F.col("lon") - grid.lon0) / grid.step - F.col("col")))
    none_where(out, off > tolerance, "points off the grid's nodes")
    none_where(out, ~(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)), "points outside the grid")
    unique_key(out, "gid")
    return out


#: A table of points or corners of at most so many rows (about 50 MB) goes to every task, so that no cell of a cube moves.
SMALL = 2_000_000


def _near(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small enough; else both sides are dealt by their key."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def extract_nodes(cube: DataFrame, mapping: DataFrame) -> DataFrame:
    """cube: date, row, col, value. The values at the mapped points."""
    return cube.join(_near(mapping.select("id", "row", "col")), ["row", "col"]).select("id", "date", "value")


def clean(value: Column, fill: float | None = None, largest: float = 1e30, not_negative: bool = False) -> Column:
    """Fill values, NaN and absurd magnitudes as NULL; negative amounts as 0 where asked."""
    bad = F.isnan(value) | (F.abs(value) > largest)
    if fill is not None:
        bad = bad | (value == fill)
    return F.when(~bad, F.greatest(value, F.lit(0.0)) if not_negative else value)


def bilinear_corners(points: DataFrame, lon0: float, lat0: float, dx: float, dy: float, cols: int, rows: int) -> DataFrame:
    """(id, row, col, weight): the four cells around each point; dy is negative for rows that go south. Points on a
    centre (within 1e-6 cells) take it alone; points outside the outer centres are clamped to the edge."""

    def snapped(v: Column, start: float, step: float) -> Column:
        f = (v - F.lit(start)) / step
        return F.when(F.abs(f - F.rint(f)) < 1e-6, F.rint(f)).otherwise(f)

    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    at = points.select("id", snapped(F.col("lon"), lon0, dx).alias("fx"), snapped(F.col("lat"), lat0, dy).alias("fy"))
    at = at.withColumns({"j": clamp(F.floor("fx"), 0, cols - 2).cast("int"), "i": clamp(F.floor("fy"), 0, rows - 2).cast("int")})
    at = at.withColumns({"wx": clamp(F.col("fx") - F.col("j"), 0.0, 1.0), "wy": clamp(F.col("fy") - F.col("i"), 0.0, 1.0)})
    corner = lambda di, dj: F.struct((F.col("i") + di).alias("row"), (F.col("j") + dj).alias("col"), ((F.col("wy") if di else 1 - F.col("wy")) * (F.col("wx") if dj else 1 - F.col("wx"))).alias("weight"))
    return at.select("id", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c")).select("id", "c.row", "c.col", "c.weight")


def bilinear(cube: DataFrame, corners: DataFrame, missing: str = "renormalize") -> DataFrame:
    """(id, date, value) from cube (date, row, col, value; NULL is missing). Corners of weight 0 do not count. A missing
    corner is left out and the others weigh more, or ("propagate") makes the value missing."""
    option(missing, ("renormalize", "propagate"), "missing")
    rows = cube.join(_near(corners.where("weight > 0")), ["row", "col"])
    there = F.col("value").isNotNull()
    value = F.try_divide(F.sum(F.when(there, F.col("weight") * F.col("value"))), F.sum(F.when(there, F.col("weight"))))
    if missing == "propagate":
        value = F.when(F.bool_and(there), value)
    return rows.groupBy("id", "date").agg(value.alias("value"))


def remap(values: DataFrame, table: DataFrame) -> DataFrame:
    """values (gid, ...) by id of the mapping; every id of the mapping must have its gid among the values."""
    gone = table.select("id", "gid").join(values.select("gid").distinct(), "gid", "left_anti")
    none_where(gone, F.lit(True), "ids without values")
    return values.join(table.select("id", "gid"), "gid").drop("gid")


def predictions_to_daily(predictions: DataFrame, table: DataFrame, start: str, days: int, buckets: int) -> DataFrame:
    """predictions: id_bucket, gid, day (from 0), pred; a partition column id_bucket = gid % buckets. Reads the buckets
    that the mapping needs, checks that each id has all days, and gives (id, date, value)."""
    wanted = table.select("id", "gid", F.pmod(F.col("gid"), F.lit(buckets)).cast("int").alias("id_bucket"))
    rows = predictions.join(wanted, ["id_bucket", "gid"]).where(F.col("day") < days)
    counts = wanted.join(rows.groupBy("id").agg(F.count_distinct("day").alias("n")), "id", "left")
    none_where(counts, F.coalesce("n", F.lit(0)) < days, "ids with too few predicted days")
    return rows.select("id", F.date_add(F.lit(start).cast("date"), F.col("day")).alias("date"), F.col("pred").alias("value"))
