"""Sources, sinks, jobs and the stream, each in a round trip."""

import datetime as dt
import json
import sqlite3
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrafold.checks import DataError
from terrafold.operators import climate, grid, raster, scan
from terrafold.plans import jobs
from terrafold.sinks import cog, tables, tiff
from terrafold.sources import bounds, cube, geotiff, hdf5, index_text, points, season_tree
from terrafold.streaming import live_scan


def netcdf3(path, values, records=True):
    """A classic file with one float variable (time, lat, lon) and its axes."""
    t, rows, cols = values.shape
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    number = lambda k, v: name(k) + struct.pack(">iif", 5, 1, v)
    dims = struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0 if records else t) + name("lat") + struct.pack(">i", rows) + name("lon") + struct.pack(">i", cols)

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", t if records else 0) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
        out += name("lat") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, rows * 4, begins[0])
        out += name("rain") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 2) + text("units", "mm") + number("_FillValue", -99.0) + struct.pack(">iii", 5, rows * cols * 4, begins[1])
        return out

    size = len(header((0, 0)))
    with open(path, "wb") as f:
        f.write(header((size, size + rows * 4)) + np.arange(rows).astype(">f4").tobytes() + values.astype(">f4").tobytes())


@pytest.mark.parametrize("records", [True, False])
def test_netcdf_cube(spark, tmp_path, records):
    values = np.arange(3 * 2 * 4, dtype=float).reshape(3, 2, 4)
    values[1, 0, 2], values[2, 1, 3] = -99.0, np.nan
    netcdf3(tmp_path / "a.nc", values, records)
    spark.dataSource.register(cube.Netcdf)
    got = {(r["time"], r["row"], r["col"]): r["value"] for r in spark.read.format("netcdf").option("path", str(tmp_path / "a.nc")).option("steps", "2").load().collect()}
    assert len(got) == 24 and got[(1, 0, 2)] is None and got[(2, 1, 3)] is None and got[(2, 1, 2)] == 22.0
    assert cube.axes(str(tmp_path / "a.nc"), ("lat",))["lat"].tolist() == [0.0, 1.0]
    assert cube.start_date("days since 1981-01-01 00:00") == "1981-01-01" and cube.start_date("unknown") is None
    with pytest.raises(ValueError, match="classic"):
        cube.Header(b"\x89HDF\r\n" + b"\0" * 90)


def test_index_text(spark, tmp_path):
    (tmp_path / "i.txt").write_text("% a comment\n1950  1  -0.5\n\n 1950\t2 1.25 \n")
    assert [tuple(r) for r in index_text.read(spark, str(tmp_path / "i.txt")).orderBy("month").collect()] == [(1950, 1, -0.5), (1950, 2, 1.25)]


def wkb(kind, *parts, order="<"):
    """Well-known binary: a point, a line, a polygon of rings, or several geometries."""
    head = (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", kind)
    vertices = lambda p: b"".join(struct.pack(order + "d" * len(v), *v) for v in p)
    if kind % 1000 == 1:
        return head + vertices(parts)
    if kind % 1000 == 2:
        return head + struct.pack(order + "I", len(parts)) + vertices(parts)
    if kind % 1000 == 3:
        return head + struct.pack(order + "I", len(parts)) + b"".join(struct.pack(order + "I", len(p)) + vertices(p) for p in parts)
    return head + struct.pack(order + "I", len(parts)) + b"".join(parts)


def closed(*p):
    return [*p, p[0]]


SQUARE = closed((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))
HOLE = closed((2.0, 1.0), (3.0, 1.0), (3.0, 3.0), (2.0, 3.0))
FAR = closed((10.0, 0.0), (12.0, 0.0), (12.0, 2.0), (10.0, 2.0))
L_SHAPE = closed((0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0))


def plain_centroid(rings, n=400):
    """Of an area by counting cells inside: outer rings less holes."""

    def inside(ring, x, y):
        hit = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if ay != by:
                hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return hit

    xs = [v[0] for r, _ in rings for v in r]
    ys = [v[1] for r, _ in rings for v in r]
    x, y = np.meshgrid(min(xs) + (np.arange(n) + 0.5) / n * (max(xs) - min(xs)), min(ys) + (np.arange(n) + 0.5) / n * (max(ys) - min(ys)))
    weight = sum(sign * inside(ring, x, y).astype(int) for ring, sign in rings)
    return (x * weight).sum() / weight.sum(), (y * weight).sum() / weight.sum()


def test_geopackage(spark, tmp_path):
    shapes = {
        1: (wkb(1, (-75.5, -12.25)), (-75.5, -12.25)),
        2: (wkb(3, SQUARE, HOLE), plain_centroid([(SQUARE, 1), (HOLE, -1)])),
        3: (wkb(3, SQUARE[::-1], HOLE[::-1], order=">"), plain_centroid([(SQUARE, 1), (HOLE, -1)])),
        4: (wkb(6, wkb(3, SQUARE), wkb(3, FAR)), plain_centroid([(SQUARE, 1), (FAR, 1)])),
        5: (wkb(2, (0.0, 0.0), (4.0, 0.0), (4.0, 2.0)), ((4 * 2 + 2 * 4) / 6, (4 * 0 + 2 * 1) / 6)),
        6: (wkb(4, wkb(1, (1.0, 1.0)), wkb(1, (3.0, 5.0))), (2.0, 3.0)),
        7: (wkb(1003, [(x, y, 9.0) for x, y in L_SHAPE]), plain_centroid([(L_SHAPE, 1)])),
        8: (wkb(3, closed((1.0, 1.0), (3.0, 1.0))), (2.0, 1.0)),
        9: (None, None),
        10: (wkb(1, (float("nan"), float("nan"))), None),
    }
    with sqlite3.connect(tmp_path / "p.gpkg") as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('p', 'geom')")
        con.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, geom BLOB, kind TEXT, height REAL)")
        for i, (shape, _) in shapes.items():
            con.execute("INSERT INTO p VALUES (?, ?, 'x', 1.5)", (i * 7, shape and b"GP\x00\x01" + struct.pack("<i", 4326) + shape))
    table = points.read_geopackage(spark, str(tmp_path / "p.gpkg"), each=20)
    assert table.dtypes == [("lon", "double"), ("lat", "double"), ("id", "bigint"), ("kind", "string"), ("height", "double")]
    assert table.rdd.getNumPartitions() == 4
    got = {r["id"] // 7: (r["lon"], r["lat"]) for r in table.collect()}
    assert set(got) == {i for i, (_, at) in shapes.items() if at}
    for i, at in got.items():
        assert at == pytest.approx(shapes[i][1], abs=0.01)
    assert got[2] == pytest.approx(((16 * 2 - 2 * 2.5) / 14, 2.0), abs=1e-12)
    with pytest.raises(Exception, match="no layer"):
        points.read_geopackage(spark, str(tmp_path / "p.gpkg"), "other").collect()


def shapefile(folder, shapes, names):
    """A .shp of record contents with its .shx, and a .dbf of one number and one text."""
    body, index = b"", b""
    for k, content in enumerate(shapes):
        index += struct.pack(">ii", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">ii", k + 1, len(content) // 2) + content
    (folder / "p.shp").write_bytes(b"\0" * 100 + body)
    (folder / "p.shx").write_bytes(b"\0" * 100 + index)
    field = lambda name, kind, width, decimals: name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14
    head = field(b"id", b"N", 4, 0) + field(b"name", b"C", 6, 0) + field(b"h", b"N", 6, 2) + b"\r"
    rows = b"".join(b" " + f"{k:4d}".encode() + n.encode().ljust(6) + (f"{k / 4:6.2f}".encode() if k % 2 else b"******") for k, n in enumerate(names))
    (folder / "p.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, len(names), 32 + len(head), 17) + b"\0" * 20 + head + rows)
    return str(folder / "p.shp")


def parted(kind, parts):
    """A line or polygon record of parts."""
    starts = np.cumsum([0, *[len(p) for p in parts]])
    return struct.pack("<i4d", kind, 0, 0, 0, 0) + struct.pack("<ii", len(parts), starts[-1]) + struct.pack(f"<{len(parts)}i", *starts[:-1]) + b"".join(struct.pack("<dd", *v) for p in parts for v in p)


def test_shapefile(spark, tmp_path):
    shapes = [
        struct.pack("<idd", 1, -75.5, -12.25),
        parted(5, [SQUARE[::-1], HOLE]),  # outer rings go clockwise, holes the other way
        parted(5, [SQUARE[::-1], FAR[::-1]]),
        parted(3, [[(0.0, 0.0), (2.0, 0.0)], [(0.0, 4.0), (0.0, 8.0)]]),
        struct.pack("<i4di", 8, 0, 0, 0, 0, 2) + struct.pack("<4d", 1.0, 1.0, 3.0, 5.0),
        struct.pack("<i", 0),
        struct.pack("<iddd", 11, 5.0, 6.0, 7.0),
    ]
    want = [(-75.5, -12.25), ((16 * 2 - 2 * 2.5) / 14, 2.0), ((16 * 2 + 4 * 11) / 20, (16 * 2 + 4 * 1) / 20), ((2 * 1 + 4 * 0) / 6, (2 * 0 + 4 * 6) / 6), (2.0, 3.0), (None, None), (5.0, 6.0)]
    path = shapefile(tmp_path, shapes, ["a", "b", "ñ", "d", "e", "", "g"])
    table = points.read_shapefile(spark, f"file://{path}", each=3)
    assert table.dtypes == [("lon", "double"), ("lat", "double"), ("id", "bigint"), ("name", "string"), ("h", "double")]
    assert table.rdd.getNumPartitions() == 3
    rows = sorted(table.collect(), key=lambda r: r["id"])
    assert [r["name"] for r in rows] == ["a", "b", "ñ", "d", "e", "", "g"] and [r["h"] for r in rows] == [None, 0.25, None, 0.75, None, 1.25, None]
    for r, at in zip(rows, want):
        assert (r["lon"], r["lat"]) == (at if at[0] is None else pytest.approx(at, abs=1e-12))


def test_months_are_replaced_and_a_failed_run_leaves_them(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [("rain", 2001, m, i, dt.date(2001, m, 1), float(i)) for m in (1, 2) for i in range(5)]
    long = spark.createDataFrame(rows, "variable string, year int, month int, id int, date date, value float")
    state = lambda: sorted(map(tuple, spark.read.parquet(path).select(*long.columns).collect()))
    tables.write_months(long, path)
    before = state()
    tables.write_months(long, path)
    assert state() == before and len(before) == 10
    # a task that fails in the middle of a month: all months are as they were
    bad = long.withColumn("value", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("value") + 1))
    with pytest.raises(Exception, match="lost"):
        tables.write_months(bad, path)
    assert state() == before
    tables.write_months(long.where("month = 2").withColumn("value", F.col("value") + 1), path)
    assert [r for r in state() if r[2] == 1] == [r for r in before if r[2] == 1] and sum(r[5] for r in state()) == sum(r[5] for r in before) + 5
    tables.write_months(long, path, mode="append")
    assert len(state()) == 20


def test_months_round_trip_prunes_and_pushes_down(spark, tmp_path):
    days = [dt.date(2001, 1, 30) + dt.timedelta(days=k) for k in range(5)]
    rows = [("rain", d.year, d.month, i, d, float(i)) for i in range(20) for d in days]
    long = spark.createDataFrame(rows, "variable string, year int, month int, id int, date date, value float")
    tables.write_months(long, str(tmp_path / "m"))
    back = climate.read_window(spark.read.parquet(str(tmp_path / "m")), "rain", "2001-02-01", "2001-02-02", [3, 4])
    assert back.count() == 4
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(date,2001-02-01)" in plan and "IN (3,4)" in plan


def test_season_tree_and_broken_files(spark, tmp_path):
    root = tmp_path / "tree"
    spark.range(3).coalesce(1).write.parquet(str(root / "2001" / "p1" / "north"))
    (root / "2001" / "p1" / "north" / "coverage.json").write_text(json.dumps({"truncated": True, "n_days": 4}))
    (root / "2001" / "p1" / "north" / "bad.parquet").write_bytes(b"PAR1 and nothing else")
    bad = season_tree.unreadable(spark, str(root)).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("bad.parquet")
    (root / "2001" / "p1" / "north" / "bad.parquet").unlink()
    assert season_tree.read(spark, str(root)).select("season", "period", "region").distinct().collect() == [(2001, "p1", "north")]
    assert season_tree.read_coverage(spark, str(root)).first()["truncated"] is True


def test_tiff_round_trip(spark, tmp_path):
    g = raster.Geometry(-81.0, 1.0, 0.5, 0.5, 3, 4)
    px = spark.createDataFrame([(0, 1, 5), (2, 3, 7)], "y_idx int, x_idx int, value int")
    for kind in ("int16", "float32"):
        tiff.write(px, g, str(tmp_path / "a.tif"), kind, "a test")
        image, back = tiff.read(str(tmp_path / "a.tif"))
        assert back == g and image[0, 1] == 5 and image[2, 3] == 7 and (image == raster.NODATA).sum() == 10
    with pytest.raises(ValueError):
        tiff.write(spark.createDataFrame([(9, 0, 1)], px.schema), g, str(tmp_path / "b.tif"))


def test_year_is_merged_with_tags(spark, tmp_path):
    g = raster.Geometry(-81.0, 1.0, 0.5, 0.5, 3, 4)
    parts = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 2, None), ("b", 2, 3, 7), ("b", 2, 2, 8)], "region string, y_idx int, x_idx int, value int")
    out = str(tmp_path / "BU_2001.tif")
    assert jobs.merge_year(parts, {"a": g, "b": g}, out, "BU", 2001, "blight <units> ñ", "1") == {"a": 1, "b": 2}
    image, back = tiff.read(out)
    tags = tiff.read_tags(out)
    assert back == g and image[2, 2] == 8 and (image == raster.NODATA).sum() == 9
    assert tags["regions_merged"] == "a (1 px); b (2 px)" and tags["n_valid_pixels"] == "3" and tags["DESCRIPTION"] == "BU - blight <units> ñ" and tags["year"] == "2001"
    with pytest.raises(DataError, match="b"):
        jobs.merge_year(parts, {"a": g, "b": raster.Geometry(-81.0, 1.0, 0.5, 0.5, 3, 5)}, out, "BU", 2001)
    with pytest.raises(DataError):
        jobs.merge_year(parts.union(parts.where("region = 'b'").withColumn("region", F.lit("a"))), {"a": g, "b": g}, out, "BU", 2001)
    assert tiff.read_tags(out) == tags


def test_raster_paths(spark, tmp_path):
    folders = {"p1": "north", "p2": "south"}
    for at in ("2001/p1/north/BU.tif", "2001/p2/south/BU.tif", "2002/p1/north/BU.tif", "2003/p1/north/BU.tif", "2003/p1/north/BU_b.tif", "2003/p2/south/BU.tif", "2001/p1/south/BU.tif"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(b"")
    found, skipped = season_tree.raster_paths(spark, str(tmp_path), 2001, 2004, folders)
    assert list(found) == [2001] and found[2001]["p1"].endswith("2001/p1/north/BU.tif") and sorted(skipped) == [2002, 2003, 2004] and "more than one" in skipped[2003]
    found, skipped = season_tree.raster_paths(spark, str(tmp_path), 2001, 2004, folders, strict=False)
    assert list(found) == [2001, 2002] and found[2002]["p2"] is None and sorted(skipped) == [2003, 2004]
    with pytest.raises(DataError):
        season_tree.raster_paths(spark, str(tmp_path), 2004, 2005, folders)


def cube_file(path, values, time=None, units="", lats=(1.0, 0.5), lons=(-81.0, -80.5), names=("time", "lat", "lon")):
    """A classic file without records: value(time, lat, lon), both axes, and a time axis if it is given."""
    name = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    sizes = dict(zip(names, values.shape))
    dims = struct.pack(">ii", 10, 3) + b"".join(name(n) + struct.pack(">i", k) for n, k in sizes.items())
    order = list(sizes)
    parts = [(n, [order.index(n)], np.array(v), "") for n, v in (("lat", lats), ("lon", lons))]
    if time is not None:
        parts.append((names[0], [0], np.array(time), units))
    parts.append(("rain", [0, 1, 2], values, ""))

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", 0) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(parts))
        for (n, d, v, u), at in zip(parts, begins):
            out += name(n) + struct.pack(f">i{len(d)}i", len(d), *d) + (struct.pack(">ii", 12, 1) + text("units", u) if u else struct.pack(">ii", 0, 0)) + struct.pack(">iii", 6, v.size * 8, at)
        return out

    begins = len(header([0] * len(parts))) + np.concatenate([[0], np.cumsum([p[2].size * 8 for p in parts])[:-1]])
    path.write_bytes(header(begins.tolist()) + b"".join(p[2].astype(">f8").tobytes() for p in parts))
    return str(path)


def test_cube_file_to_months(spark, tmp_path):
    g = grid.Grid(1.0, -81.0, 0.5, 2, 2)
    values = np.arange(40 * 4, dtype=float).reshape(40, 2, 2)
    path = cube_file(tmp_path / "a.nc", values, np.arange(40) * 24 + 12, "hours since 2001-01-10 00:00:00")
    pts = spark.createDataFrame([(1, -80.5, 1.0), (2, -81.0, 0.5)], "id long, lon double, lat double")
    record = jobs.prepare_file(spark, path, pts, "rain", g, str(tmp_path / "m"))
    assert record["layout"] == [{"variable": "rain", "n_present": 2, "first": 200101, "last": 200102, "n_missing": 0}] and record["sources"] == {"rain": path}
    rows = {(r["id"], r["date"]): r["value"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert len(rows) == 80 and rows[(1, dt.date(2001, 1, 10))] == 1.0 and rows[(2, dt.date(2001, 2, 18))] == 158.0
    assert jobs.prepare_file(spark, path, pts, "rain", g, str(tmp_path / "m")) == record and spark.read.parquet(str(tmp_path / "m")).count() == 80
    for bad, match in ((grid.Grid(1.0, -81.0, 0.5, 2, 3), "nodes"), (grid.Grid(1.5, -81.0, 0.5, 2, 2), "begins"), (grid.Grid(1.0, -80.0, 0.5, 2, 2), "begins")):
        with pytest.raises(DataError, match=match):
            jobs.open_cube(spark, path, bad)
    with pytest.raises(DataError, match="dimensions"):
        jobs.open_cube(spark, cube_file(tmp_path / "o.nc", values, names=("time", "lon", "lat")), g)
    some = jobs.open_cube(spark, path, g, first=dt.date(2001, 1, 12), last=dt.date(2001, 1, 13))
    assert sorted({r["date"] for r in some.collect()}) == [dt.date(2001, 1, 12), dt.date(2001, 1, 13)] and some.count() == 8
    assert jobs.open_cube(spark, path, g, first=dt.date(2005, 1, 1)).count() == 0
    with pytest.raises(DataError, match="contiguous"):
        jobs.open_cube(spark, cube_file(tmp_path / "t.nc", values, np.where(np.arange(40) < 3, np.arange(40), np.arange(40) + 1), "days since 2001-01-01"), g)


def test_days_of_older_cubes(tmp_path):
    values = np.zeros((3, 2, 2))
    first = dt.date(1999, 12, 31)
    want = [first, dt.date(2000, 1, 1), dt.date(2000, 1, 2)]
    for k, names in enumerate((("T", "lat", "lon"), ("z", "lat", "lon"))):
        assert cube.days_of(cube_file(tmp_path / f"{k}.nc", values, [0, 1, 2], "days since 1999-12-31", names=names)) == want
    assert cube.days_of(cube_file(tmp_path / "s.nc", values, [7, 8, 9], "step"), first) == want
    assert cube.days_of(cube_file(tmp_path / "n.nc", values), first) == want
    with pytest.raises(DataError):
        cube.days_of(str(tmp_path / "n.nc"))


def test_rows_of_a_group(spark, tmp_path):
    long = world(spark)[1].where("variable = 'rain' and year = 2001 and month = 3")
    tables.write_months(long, str(tmp_path / "m"), files=1, group_rows=20)
    file = next((tmp_path / "m").rglob("*.parquet"))
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 62 and [groups.row_group(k).num_rows for k in range(groups.num_row_groups)] == [20, 20, 20, 2]


def test_nodes_of_a_finer_grid(spark):
    fine = grid.nodes(spark, grid.Grid(1.0, -81.0, 0.25, 5, 5))
    cells = spark.range(9).select(F.lit(dt.date(2001, 1, 1)).alias("date"), (F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    got = grid.bilinear(cells, grid.bilinear_corners(fine, lon0=-81.0, lat0=1.0, dx=0.5, dy=-0.5, cols=3, rows=3), "propagate")
    assert {r["id"]: r["value"] for r in got.collect()}[6] == 2.0


def world(spark):
    pts = spark.createDataFrame([(1, -75.0, -12.0, 3500.0, "Sierra Alta [>3,000]"), (2, -76.0, -8.0, 100.0, "Costa [0-500 msnm]")], "id long, lon double, lat double, altitude double, type string")
    days = spark.range(2 * 800).select((F.col("id") % 2 + 1).cast("int").alias("id"), F.date_add(F.lit("2000-07-01").cast("date"), (F.col("id") / 2).cast("int")).alias("date"), F.col("id").alias("k"))
    value = {"tmin": F.col("k") % 7 + 4.0, "tmax": F.col("k") % 7 + 14.0 + F.col("k") % 3, "tdew": F.col("k") % 7 + 5.0, "rain": F.col("k") % 11 / 2.0}
    parts = [days.select(F.lit(v).alias("variable"), F.year("date").alias("year"), F.month("date").alias("month"), "id", "date", x.cast("float").alias("value")) for v, x in value.items()]
    return pts, parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def test_jobs_from_months_to_trends(spark, tmp_path):
    pts, long = world(spark)
    tables.write_months(long, str(tmp_path / "climate"))
    report = jobs.run_scores(spark.read.parquet(str(tmp_path / "climate")), pts, str(tmp_path / "out"), "2000-07-01", "2002-12-31", "s")
    seen = {(r["year"], r["region"]): r["truncated"] for r in report.collect()}
    assert seen[(2000, "highland")] is False and seen[(2000, "lowland")] is False and seen[(2002, "lowland")] is True
    results = spark.read.parquet(str(tmp_path / "out/daily"))
    assert {"lon", "lat", "altitude", "applications"} <= set(results.columns)
    stats = jobs.run_trends(results, pts, str(tmp_path / "trend"), min_years=2)
    assert stats.count() == 2 and "slope_sum_bu" in stats.columns
    jobs.run_rasters(results, pts, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/merged_app")).count() > 0
    path = tables.backfill(spark, str(tmp_path / "out/daily"), pts, ("type",))
    assert path == str(tmp_path / "out/daily") and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["coverage", "daily"]
    again = jobs.rerun_sample(spark.read.parquet(path), spark.read.parquet(str(tmp_path / "climate")), pts, 1, "2000-07-01", "2002-12-31", "s").first()
    assert again["n_common"] > 0 and again["n_only_old"] == again["n_only_new"] == again["n_ids_changed"] == 0 and again["max_diff_bu"] == 0
    asked = spark.createDataFrame([(1990, "lowland", dt.date(1990, 7, 1), dt.date(1990, 12, 31))], "year int, region string, start date, end date")
    empty = jobs.run_scores(spark.read.parquet(str(tmp_path / "climate")), pts, str(tmp_path / "none"), "1990-07-01", "1990-12-31", "s", asked)
    assert [(r["year"], r["n_days"], r["truncated"]) for r in empty.collect()] == [(1990, 0, True)]
    assert "type" in spark.read.parquet(path).columns and tables.backfill(spark, path, pts, ("type",)) == path
    order = []
    assert jobs.run(["trend", "scores"], {s: (lambda s=s: order.append(s)) for s in jobs.STEPS}) == ["scores", "trend"] == order
    with pytest.raises(ValueError):
        jobs.run(["other"], {})


def test_index_job(spark, tmp_path):
    yearly = spark.range(60).select((F.col("id") % 6).alias("id"), (F.col("id") / 6).cast("int").alias("k")).select("id", (F.col("k") + 2000).alias("year"), F.element_at(F.array(F.lit("highland"), F.lit("midland"), F.lit("lowland")), (F.col("id") % 3 + 1).cast("int")).alias("region"), *[(F.col("k") * c % 7).cast("double").alias(n) for n, c in (("app", 3), ("sum_bu", 5), ("sum_fu", 2))])
    pts = spark.range(6).select("id", (-F.col("id").cast("double") * 3).alias("lat"), F.lit(-75.0).alias("lon"))
    monthly = spark.range(14 * 12).select((F.col("id") / 12 + 2000).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"), (F.col("id") % 5 - 2.0).alias("value"))
    summary = jobs.run_index(yearly, pts, monthly, str(tmp_path), (2000, 2009), 50)
    units = spark.read.option("header", "true").csv(str(tmp_path / "regressions_app"))
    assert {"region", "zone", "slope", "p"} <= set(units.columns) and units.count() > 0
    assert set(summary["field"]) == {"app", "sum_bu", "sum_fu"} and 0 <= summary["field"]["app"]["field_p"] <= 1
    with pytest.raises(DataError):
        jobs.run_index(yearly.where("not (id = 1 and year = 2003)"), pts, monthly, str(tmp_path / "x"), (2000, 2009), 5)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, 2000, dt.date(2000, 1, 1) + dt.timedelta(days=k), int(rng.integers(0, 8)), int(rng.integers(0, 6))) for k in range(70) for i in range(3)]
    schema = "id long, season int, date date, bu int, fu int"
    for part in range(3):  # three micro-batches, days in order
        spark.createDataFrame(rows[part * 70 : (part + 1) * 70], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    query = live_scan.decide(stream, "ms").writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table("decided").select("id", "day", "fu", "acc_bu", "applications").collect()))
    df = spark.createDataFrame([(i, s, d, (d - dt.date(2000, 1, 1)).days + 1, b, f) for i, s, d, b, f in rows], "id long, season int, date date, day int, bu int, fu int")
    assert got == sorted(map(tuple, scan.by_batches(df, "ms", parts=2).select("id", "day", "fu", "acc_bu", "applications").collect()))


# ---- pushed filters, rasters by windows ----------------------------------------------------------------------------


def test_bounds_reach_the_cube(spark, tmp_path):
    """Bounds leave out partitions and bytes; the rows are those of a filter over all cells, in any mix of tables."""
    values = np.arange(40 * 6 * 5, dtype=float).reshape(40, 6, 5)
    path = cube_file(tmp_path / "a.nc", values, lats=range(6), lons=range(5))
    open_ = lambda **within: bounds.load(spark, cube.Netcdf, f"file://{path}", within, steps=4)
    some = open_(time=(9, 13), row=(2, 4), col=(3, None))
    assert {(r["time"], r["row"], r["col"]) for r in some.collect()} == {(t, r, c) for t in range(9, 13) for r in (2, 3) for c in (3, 4)}
    assert open_().rdd.getNumPartitions() == 10 and some.rdd.getNumPartitions() == 2
    assert open_(time=(99, None)).count() == 0 and open_(time=(3, 4), row=(5, 6)).count() == 5
    both = open_(time=(3, 4)).alias("a").join(open_(time=(5, 6)).alias("b"), ["row", "col"])
    assert {(r["t"], r["u"]) for r in both.selectExpr("a.time AS t", "b.time AS u").collect()} == {(3, 5)}
    read = {"bytes": 0}

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read["bytes"] += n
            return self.f.read_at(n, at)

    keep = cube.open_at
    cube.open_at = lambda p: Counted(keep(p))
    try:
        reader = cube.CubeReader({"path": path, "row_from": "5"})
        reader._open()
        head, read["bytes"] = read["bytes"], 0
        got = [r for batch in reader.read(cube.Block(path, 0, 2)) for r in batch.to_pylist()]
    finally:
        cube.open_at = keep
    assert len(got) == 10 and read["bytes"] - head == 2 * 5 * 8


def test_a_header_of_any_length(tmp_path):
    values = np.arange(8.0).reshape(2, 2, 2)
    path = cube_file(tmp_path / "a.nc", values, [0, 1], "days since 2000-01-01" + " " * 300_000)
    assert cube.days_of(path)[1] == dt.date(2000, 1, 2)
    cut = tmp_path / "cut.nc"
    cut.write_bytes(open(path, "rb").read()[:200])
    with pytest.raises((struct.error, ValueError)):
        cube.days_of(str(cut))


@pytest.mark.parametrize("kind", ["int16", "float32"])
def test_tiled_raster_with_overviews(spark, tmp_path, kind):
    g = raster.Geometry(-81.0, 1.0, 0.5, 0.5, 700, 530)
    rng = np.random.default_rng(5)
    image = np.full((g.rows, g.cols), raster.NODATA, "i2" if kind == "int16" else "f4")
    for y, x in zip(rng.integers(0, 300, 4000), rng.integers(0, g.cols, 4000)):
        image[y, x] = rng.integers(-500, 500) if kind == "int16" else rng.normal()
    image[650, 3] = 7
    y, x = np.nonzero(image != raster.NODATA)
    px = spark.createDataFrame([(int(a), int(b), float(image[a, b])) for a, b in zip(y, x)], "y_idx int, x_idx int, value double")
    path = f"file://{tmp_path}/a.tif"
    cog.write(px, g, path, kind, "a test", {"year": "2001"})
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"]
    found = geotiff.images(path)
    assert [i.shape for i in found] == [(700, 530), (350, 265), (175, 133), (88, 67)] and found[0].block == (256, 256)
    assert geotiff.geometry(path) == g and tiff.read_tags(path) == {"year": "2001", "DESCRIPTION": "a test"}
    assert min(s for s in found[0].tags[geotiff.TILE_BYTES]) == 0  # tiles without pixels are left out
    # overviews come first, the smallest first, and the raster's own tiles last
    starts = [min(a for a in i.tags[geotiff.TILE_AT] if a) for i in found]
    assert starts == sorted(starts, reverse=True)
    read = lambda level, **within: bounds.load(spark, geotiff.GeoTiff, path, within, level=level, windows=1)
    for level, step in enumerate((1, 2, 4, 8)):
        part = image[::step, ::step]
        want = {(int(a), int(b)): float(part[a, b]) for a, b in zip(*np.nonzero(part != raster.NODATA))}
        assert {(r["y_idx"], r["x_idx"]): r["value"] for r in read(level).collect()} == want
    corner = read(0, y_idx=(0, 20), x_idx=(0, 20))
    assert corner.rdd.getNumPartitions() == 1 < read(0).rdd.getNumPartitions()
    assert {(r["y_idx"], r["x_idx"]) for r in corner.collect()} == {(a, b) for a, b in zip(y.tolist(), x.tolist()) if a < 20 and b < 20}
    whole, back = tiff.read(path)
    assert back == g and np.array_equal(whole, image)
    with pytest.raises(DataError, match="outside"):
        cog.write(spark.createDataFrame([(700, 0, 1.0)], px.schema), g, path, kind)
    assert tiff.read_tags(path)["year"] == "2001"


def lzw(data):
    """The compressor's side of the format, for short data: a clear code often enough that codes keep nine bits."""
    codes = []
    for k, byte in enumerate(data):
        codes += [256] * (k % 200 == 0) + [byte]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def foreign(path, order, big, image, compression, predictor, tile=None, band_values=None):
    """A file as other writers make it, with strips of two rows or with tiles."""
    rows, cols = image.shape
    samples = 1 if band_values is None else 2
    full = image[:, :, None] if band_values is None else np.stack([image, band_values], axis=2)
    high, wide = tile or (2, cols)
    blocks = []
    for y in range(0, rows, high):
        for x in range(0, cols, wide):
            part = full[y : y + high, x : x + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = part.astype(image.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = part.astype(">f4").view(np.uint8).reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[k : k + 100]) - 1]) + d[k : k + 100] for k in range(0, len(d), 100))}[compression](raw))
    word, size = ("Q", 16) if big else ("I", 8)
    at = size + np.cumsum([0, *[len(b) for b in blocks]])
    kind = {"i": 2, "u": 1, "f": 3}[image.dtype.kind]
    tags = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [image.dtype.itemsize * 8] * samples), (259, "H", [compression]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [kind] * samples), (33550, "d", [0.5, 0.5, 0.0]), (33922, "d", [0.0, 0.0, 0.0, -81.0, 1.0, 0.0]), (42113, "s", b"-1\0")]
    tags += [(322, "I", [wide]), (323, "I", [high]), (324, word, at[:-1].tolist()), (325, word, [len(b) for b in blocks])] if tile else [(273, word, at[:-1].tolist()), (278, "I", [2]), (279, word, [len(b) for b in blocks])]
    tags.sort()
    codes = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    first, entry, inline = int(at[-1]), 20 if big else 12, 8 if big else 4
    pool_at = first + (8 if big else 2) + entry * len(tags) + inline
    table, pool = b"", b""
    for code, fmt, values in tags:
        data = values if fmt == "s" else struct.pack(f"{order}{len(values)}{fmt}", *values)
        table += struct.pack(f"{order}HH{word}", code, codes[fmt], len(values))
        table += data.ljust(inline, b"\0") if len(data) <= inline else struct.pack(order + word, pool_at + len(pool))
        pool += data if len(data) > inline else b""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    path.write_bytes(head + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + table + struct.pack(order + word, 0) + pool)
    return str(path)


@pytest.mark.parametrize(
    "order,big,dtype,compression,predictor,tile",
    [("<", False, "i2", 1, 1, None), (">", False, "i2", 5, 2, None), ("<", True, "f4", 8, 3, (16, 16)), (">", True, "f8", 32773, 1, None), ("<", False, "u1", 5, 1, (16, 16)), (">", False, "i4", 8, 2, (16, 16)), ("<", False, "f4", 5, 3, (16, 32))],
)
def test_rasters_of_other_writers(spark, tmp_path, order, big, dtype, compression, predictor, tile):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 200, (37, 21)).astype(dtype)
    image[5, 6] = 0 if dtype == "u1" else -1
    other = (image // 2 + 1).astype(dtype) if predictor != 3 else None
    path = foreign(tmp_path / "f.tif", order, big, image, compression, predictor, tile, other)
    for band, want in (("1", image), ("2", other)):
        if want is None:
            continue
        got = {(r["y_idx"], r["x_idx"]): r["value"] for r in bounds.load(spark, geotiff.GeoTiff, path, band=band, windows=3).collect()}
        assert got == {(y, x): float(want[y, x]) for y in range(37) for x in range(21) if want[y, x] != -1}
    assert geotiff.geometry(path) == raster.Geometry(-81.0, 1.0, 0.5, 0.5, 37, 21)


def test_lzw_codes_grow():
    """Codes of ten bits and more, and the code that is not known yet; by a compressor that keeps its table."""
    data = bytes(np.random.default_rng(3).integers(0, 4, 6000).astype(np.uint8)) + b"a" * 500
    table, width, bits, held = {bytes([k]): k for k in range(256)}, 9, "", b""
    free, bits = 258, f"{256:09b}"
    for byte in data:
        piece = held + bytes([byte])
        if piece in table:
            held = piece
            continue
        bits += f"{table[held]:0{width}b}"
        table[piece] = free
        free += 1
        if free == (1 << width):
            width += 1
        held = bytes([byte])
    bits += f"{table[held]:0{width}b}"
    free += 1
    if free == (1 << width):
        width += 1
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    packed = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    assert free < 4094 and geotiff._lzw(packed) == data


def test_year_is_merged_into_tiles(spark, tmp_path):
    g = raster.Geometry(-81.0, 1.0, 0.5, 0.5, 3, 4)
    parts = spark.createDataFrame([("a", 0, 1, 5), ("b", 2, 3, 7)], "region string, y_idx int, x_idx int, value int")
    out = f"file://{tmp_path}/BU_2001.tif"
    assert jobs.merge_year(parts, {"a": g, "b": g}, out, "BU", 2001, layout="cog") == {"a": 1, "b": 1}
    image, back = tiff.read(out)
    assert back == g and image[0, 1] == 5 and image[2, 3] == 7 and tiff.read_tags(out)["n_valid_pixels"] == "2"
    with pytest.raises(ValueError, match="layout"):
        jobs.merge_year(parts, {"a": g, "b": g}, out, "BU", 2001, layout="other")


def test_stream_of_late_days_equals_batch(spark, tmp_path):
    """Days come up to nine days late and out of order, in many small batches; what the watermark has passed is as in the scan."""
    rng = np.random.default_rng(9)
    first = dt.date(2000, 1, 1)
    rows = [(i, 2000, first + dt.timedelta(days=k), int(rng.integers(0, 8)), int(rng.integers(0, 6))) for i in range(3) for k in range(60)]
    schema = "id long, season int, date date, bu int, fu int"
    comes = sorted(rows, key=lambda r: (r[2] - first).days + rng.uniform(0, 9))
    comes += [(9, 2000, first + dt.timedelta(days=400), 0, 0)]  # much later, so that the watermark passes all
    for k in range(0, len(comes), 30):
        spark.createDataFrame(comes[k : k + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    run = live_scan.decide_late(stream, "ms").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    columns = ("id", "date", "day", "fu", "acc_bu", "acc_fu", "applications")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    df = spark.createDataFrame([(*r[:3], (r[2] - first).days + 1, *r[3:]) for r in rows], "id long, season int, date date, day int, bu int, fu int")
    assert got == sorted(map(tuple, scan.by_batches(df, "ms", parts=2).select(*columns).collect()))
    # a day behind the watermark is dropped, and a second run goes on where the first ended
    spark.createDataFrame([(1, 2000, first + dt.timedelta(days=70), 5, 5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = live_scan.decide_late(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ms").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    again.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)


# ---- HDF5-based cubes ----------------------------------------------------------------------------------------------


class Hdf5Writer:
    """Files by the format's description. old: superblock 0, headers of version 1, symbol tables; else superblock 2, headers
    of version 2 and links in the group's header, as NetCDF-4 has them."""

    def __init__(self, old):
        self.old, self.body = old, bytearray(b"\0" * 96)

    def put(self, data):
        self.body += b"\0" * (-len(self.body) % 8)
        self.body += data
        return len(self.body) - len(data)

    @staticmethod
    def kind(dtype):
        dtype = np.dtype(dtype)
        big = dtype.byteorder == ">"
        if dtype.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, dtype.itemsize)
        if dtype.kind == "f":
            bits = (0, 32, 23, 8, 0, 23, 127) if dtype.itemsize == 4 else (0, 64, 52, 11, 0, 52, 1023)
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, 31 if dtype.itemsize == 4 else 63, 0, dtype.itemsize, bits[0], bits[1], bits[2], bits[3], bits[4], bits[5], bits[6])
        return struct.pack("<BBBBIHH", 0x10, big | 8 * (dtype.kind == "i"), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)

    def space(self, shape):
        head = struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) if self.old else struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0)
        return head + struct.pack(f"<{len(shape)}Q", *shape)

    def attribute(self, name, value):
        if isinstance(value, list) and isinstance(value[0], bytes):  # lists of references
            kind, shape, data = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8), (len(value),), b"".join(value)
        elif isinstance(value, str):
            kind, shape, data = self.kind(f"S{len(value) + 1}"), (), value.encode() + b"\0"
        else:
            kind, shape, data = self.kind(value.dtype), (1,), value.tobytes()
        name, space = name.encode() + b"\0", self.space(shape)
        if self.old:
            pad = lambda b: b + b"\0" * (-len(b) % 8)
            return struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + data
        return struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + data

    def header(self, messages):
        """An object's header; the last message lies in a continued block."""
        if self.old:
            pack = lambda kind, data: struct.pack("<HHB3x", kind, len(data) + -len(data) % 8, 0) + data + b"\0" * (-len(data) % 8)
            last = pack(*messages[-1])
            at = self.put(last)
            first = b"".join(pack(*m) for m in messages[:-1]) + pack(0x10, struct.pack("<QQ", at, len(last)))
            return self.put(struct.pack("<BBHII4x", 1, 0, len(messages) + 1, 1, len(first)) + first)
        pack = lambda kind, data: struct.pack("<BHBH", kind, len(data), 0, 7) + data
        last = b"OCHK" + pack(*messages[-1]) + b"\0" * 4
        at = self.put(last)
        first = b"".join(pack(*m) for m in messages[:-1]) + pack(0x10, struct.pack("<QQ", at, len(last)))
        return self.put(b"OHDR" + struct.pack("<BB16xI", 2, 0x26, len(first)) + first + b"\0" * 4)

    def chunks(self, values, chunk, filters):
        """A B-tree of two levels with a chunk's bytes at each leaf; chunks of fill values alone are left out."""
        rank, leaves = values.ndim, []
        key = lambda start, size, mask: struct.pack("<II", size, mask) + struct.pack(f"<{rank + 1}Q", *start, 0)
        for k, start in enumerate(np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk)])):
            start = [a * c for a, c in zip(start, chunk)]
            part = values[tuple(slice(a, a + c) for a, c in zip(start, chunk))]
            part = np.pad(part, [(0, c - n) for c, n in zip(chunk, part.shape)])
            if (part == -99).all():
                continue
            data, mask = part.tobytes(), 0
            for n, f in enumerate(filters):
                if f == hdf5.DEFLATE and k % 3 == 2:  # this one was stored as it was
                    mask |= 1 << n
                elif f == hdf5.DEFLATE:
                    data = zlib.compress(data)
                elif f == hdf5.SHUFFLE:
                    data = np.frombuffer(data, np.uint8).reshape(-1, values.itemsize).T.tobytes()
                else:
                    data += b"sum."
            leaves.append((key(start, len(data), mask), self.put(data)))
        end = key([n + c for n, c in zip(values.shape, chunk)], 0, 0)

        def node(level, rows):
            return self.put(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(rows), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in rows) + end)

        return node(1, [(leaves[a][0], node(0, leaves[a : a + 5])) for a in range(0, len(leaves), 5)])

    def dataset(self, values, chunk=None, filters=(), attrs=()):
        messages = [(0x1, self.space(values.shape)), (0x3, self.kind(values.dtype))]
        if chunk:
            tree = self.chunks(values, chunk, filters)
            messages.append((0x8, struct.pack("<BBBQ", 3, 2, len(chunk) + 1, tree) + struct.pack(f"<{len(chunk) + 1}I", *chunk, values.itemsize)))
        else:
            messages.append((0x8, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes)))
        if filters and self.old:
            each = b"".join(struct.pack("<HHHH8sI", f, 8, 0, 1, b"name", 4) + b"\0" * 4 for f in filters)
            messages.append((0xB, struct.pack("<BB6x", 1, len(filters)) + each))
        elif filters:
            messages.append((0xB, struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHHI", f, 0, 1, 4) for f in filters)))
        messages.append((0x5, struct.pack("<BBBBI", 2, 1, 0, 1, 0)))
        return self.header(messages + [(0xC, self.attribute(n, a)) for n, a in attrs])

    def references(self, addresses):
        """Lists of one reference each, by way of a global heap."""
        objects = b"".join(struct.pack("<HHIQQ", k + 1, 1, 0, 8, a) for k, a in enumerate(addresses))
        at = self.put(struct.pack("<4sB3xQ", b"GCOL", 1, 16 + len(objects) + 16) + objects + b"\0" * 16)
        return [struct.pack("<IQI", 1, at, k + 1) for k in range(len(addresses))]

    def finish(self, path, members):
        if self.old:
            names, offsets = b"\0" * 8, {}
            for n in sorted(members):
                offsets[n] = len(names)
                names += n.encode() + b"\0" * (8 - len(n) % 8)
            heap = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), hdf5.NOWHERE, self.put(names)))
            nodes = []
            for some in (sorted(members)[:2], sorted(members)[2:]):
                nodes.append(self.put(struct.pack("<4sBBH", b"SNOD", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", offsets[n], members[n], 0, 0) for n in some)))
            tree = self.put(struct.pack("<4sBBHQQ", b"TREE", 0, 0, 2, hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + b"\0" * 8)
            root = self.header([(0x11, struct.pack("<QQ", tree, heap)), (0xC, self.attribute("title", "x"))])
            head = hdf5.SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(self.body), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        else:
            links = [(0x6, struct.pack("<BBQB", 1, 0x4, k, len(n)) + n.encode() + struct.pack("<Q", a)) for k, (n, a) in enumerate(members.items())]
            root = self.header([(0x2, struct.pack("<BBQQQ", 0, 1, len(links), hdf5.NOWHERE, hdf5.NOWHERE)), *links])
            head = hdf5.SIGNATURE + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQI", 0, hdf5.NOWHERE, len(self.body), root, 0)
        self.body[: len(head)] = head
        path.write_bytes(bytes(self.body))
        return str(path)


def hdf5_cube(path, values, old, chunk=(7, 2, 3), filters=(hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.FLETCHER), named=True):
    """rain(time, lat, lon) with its axes; rows and columns may be as many, then only names tell them apart."""
    w = Hdf5Writer(old)
    steps, rows, cols = values.shape
    time = w.dataset(np.arange(steps, dtype="<i4"), (16,), (hdf5.DEFLATE,), [("units", "days since 2001-01-10"), ("calendar", "standard")])
    lon = w.dataset((-81.0 + 0.5 * np.arange(cols)).astype("<f8"), attrs=[("units", "degrees_east")])
    lat = w.dataset((1.0 - 0.5 * np.arange(rows)).astype(">f8"), attrs=[("units", "degrees_north")])
    attrs = [("units", "mm"), ("_FillValue", np.array([-99], values.dtype))] + ([("DIMENSION_LIST", w.references([time, lat, lon]))] if named else [])
    return w.finish(path, {"time": time, "lon": lon, "lat": lat, "rain": w.dataset(values, chunk, filters, attrs)})


@pytest.mark.parametrize("old", [True, False])
def test_hdf5_cube_equals_its_classic_twin(spark, tmp_path, old):
    rng = np.random.default_rng(4)
    values = (rng.integers(0, 500, (40, 5, 5)) / 4).astype("<f4")
    values[3, 1, 2], values[9, 0, 0] = -99, np.nan
    values[14:21, 2:4, 0:3] = -99  # a chunk that was never written
    path = hdf5_cube(tmp_path / "a.nc", values, old)
    twin = cube_file(tmp_path / "b.nc", np.where(values == -99, np.nan, values).astype(float), np.arange(40), "days since 2001-01-10", lats=1.0 - 0.5 * np.arange(5), lons=-81.0 + 0.5 * np.arange(5))
    g = grid.Grid(1.0, -81.0, 0.5, 5, 5)
    state = lambda df: sorted((r["date"], r["row"], r["col"], r["value"]) for r in df.where("value IS NOT NULL").collect())
    whole = jobs.open_cube(spark, f"file://{path}", g)
    assert state(whole) == state(jobs.open_cube(spark, twin, g)) and whole.rdd.getNumPartitions() > 3
    file = hdf5.File(path)
    assert len(file.chunks(file.vars["rain"])) == 6 * 3 * 2 - 1 and [file.dims[k][0] for k in file.vars["rain"].dims] == ["time", "lat", "lon"]
    assert cube.days_of(path)[:2] == [dt.date(2001, 1, 10), dt.date(2001, 1, 11)]
    some = bounds.load(spark, cube.Netcdf, path, {"time": (6, 9), "row": (1, 2), "col": (2, 4)}, chunks=1)
    assert some.rdd.getNumPartitions() == 4  # of 35 chunks
    assert {(r["time"], r["row"], r["col"]): r["value"] for r in some.collect()} == {(t, 1, c): float(values[t, 1, c]) for t in (6, 7, 8) for c in (2, 3)}
    with pytest.raises(DataError, match="begins"):
        jobs.open_cube(spark, path, grid.Grid(1.5, -81.0, 0.5, 5, 5))


def test_hdf5_layouts(spark, tmp_path):
    """Values in one piece, other types and orders, axes known by their sizes, and what is refused."""
    values = np.arange(12 * 2 * 3, dtype=">i2").reshape(12, 2, 3)
    for k, (chunk, filters) in enumerate(((None, ()), ((12, 2, 3), ()), ((5, 1, 2), (hdf5.SHUFFLE,)))):
        path = hdf5_cube(tmp_path / f"{k}.nc", values, k % 2 == 0, chunk, filters, named=False)
        got = {(r["time"], r["row"], r["col"]): r["value"] for r in bounds.load(spark, cube.Netcdf, path, steps=5).collect()}
        assert got == {i: float(values[i]) for i in np.ndindex(*values.shape)}
    w = Hdf5Writer(False)
    with pytest.raises(ValueError, match="filters"):
        cube.days_of(w.finish(tmp_path / "f.nc", {"rain": w.dataset(values, (12, 2, 3), (32015,))}))
    (tmp_path / "n.nc").write_bytes(hdf5.SIGNATURE + b"\x09" + b"\0" * 200)
    with pytest.raises(ValueError, match="superblock"):
        cube.days_of(str(tmp_path / "n.nc"))
