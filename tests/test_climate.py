"""Operators against small brute-force versions and closed forms."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.checks import DataError, none_where, unique_key
from terrafold.functions import classes, scores, solar, student
from terrafold.operators import catalog, climate, climate_index, grid, raster, scan, season, trend
from terrafold.sources import star


def brute_scan(bu, fu, due_b, due_f):
    b = f = since = count = 0
    out = []
    for k, (x, y) in enumerate(zip(bu, fu)):
        since, b, f = since + 1, b + x, f + y
        if k == 25 or ((b >= due_b or f > due_f) and since > 5 and count):
            count += 1
            out.append((x, 0, b, f, count))
            b = f = since = 0
        else:
            out.append((x, y, 0, 0, count))
    return out


def series(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, 2000, dt.date(2000, 1, 1) + dt.timedelta(days=k), k + 1, int(rng.integers(0, 8)), int(rng.integers(0, 8))) for i, n in enumerate(lengths) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, season int, date date, day int, bu int, fu int")


@pytest.mark.parametrize("kind", scores.CLASSES)
def test_scan_equals_brute_force(spark, kind):
    rows, df = series(spark, [1, 25, 26, 27, 80, 120])
    got = {(r["id"], r["day"]): (r["bu"], r["fu"], r["acc_bu"], r["acc_fu"], r["applications"]) for r in scan.by_batches(df, kind, parts=2).collect()}
    fold = {(r["id"], r["day"]): (r["bu"], r["fu"], r["acc_bu"], r["acc_fu"], r["applications"]) for r in scan.by_arrays(df, kind).collect()}
    for i in range(6):
        mine = [r for r in rows if r[0] == i]
        want = brute_scan([r[4] for r in mine], [r[5] for r in mine], scores.BLIGHT_DUE[kind], scores.WASHOFF_DUE[kind])
        assert [got[(i, k + 1)] for k in range(len(mine))] == want
    assert got == fold


def test_scan_keeps_series_cut_by_batches(spark):
    _, df = series(spark, [40] * 30)
    whole = sorted(map(tuple, scan.by_batches(df, "r", parts=3).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, scan.by_batches(df, "r", parts=3).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_series_too_short_give_nothing(spark):
    rows = [(1, 2000, dt.date(2000, 11, 1) + dt.timedelta(days=k), 5.0, 15.0, 6.0, 0.0, 5.5, 18.0) for k in range(4)]
    rows += [(2, 2000, dt.date(2000, 11, 1) + dt.timedelta(days=k), 5.0, 15.0, 6.0, 0.0, 5.5, 18.0) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, season int, date date, tmin double, tmax double, tdew double, rain double, sunrise double, sunset double")
    got = climate.humid_days(df).collect()
    assert len(got) == 5 and {r["id"] for r in got} == {2} and all(0 <= r["humid_hours"] <= 24 for r in got)
    with pytest.raises(ValueError):
        climate.humid_days(df, method="other")


def test_sun_is_symmetric_about_noon_and_missing_at_the_pole(spark):
    df = spark.createDataFrame([(dt.date(2001, 6, 21), 0.0, 0.0), (dt.date(2001, 6, 21), 80.0, 0.0)], "date date, lat double, lon double")
    terms = df.select("*", *[c.alias(n) for n, c in solar.day_terms(F.col("date")).items()])
    rise, set_ = solar.sun_hours(F.col("lat"), F.col("lon"), F.col("declination"), F.col("equation_of_time"), offset=0.0)
    a, b = terms.select(rise.alias("r"), set_.alias("s"), "declination").orderBy(F.col("lat")).collect()
    assert 12.0 < a["s"] - a["r"] < 12.2 and abs(a["declination"] - 23.43) < 0.02 and b["r"] is None
    assert solar.standard_offset("America/Lima") == -5 and solar.standard_offset("UTC") == 0


def test_student_known_values():
    # critical values of printed tables
    for dof, t in ((1, 12.706), (2, 4.303), (10, 2.228), (38, 2.024)):
        assert abs(student.critical(dof) - t) < 6e-4


def test_ols_constant_short_and_gaps(spark):
    rng = np.random.default_rng(1)
    rows = [(1, y, 0.0) for y in range(1990, 2010)] + [(2, y, 1.0) for y in range(1990, 1994)] + [(3, y, float(2 * y + rng.normal())) for y in range(1985, 2015) if y % 4] + [(4, 2000, None)]
    df = spark.createDataFrame(rows, "id long, year int, app double")
    got = {r["id"]: r for r in trend.ols(df, ("app",), 10).collect()}
    assert (got[1]["slope_app"], got[1]["p_value_app"], got[1]["r_squared_app"]) == (0.0, 1.0, None)
    assert got[2]["slope_app"] is None and got[2]["n_years_app"] == 4 and got[4]["n_years_app"] == 0
    x, y = (np.array([r[k] for r in rows if r[0] == 3], dtype=float) for k in (1, 2))
    slope = np.polyfit(x, y, 1)[0]
    assert abs(got[3]["slope_app"] - slope) < 1e-8 and got[3]["p_value_app"] < 1e-10
    assert trend.ols(df, ("app",), 3, years=(1990, 1993)).where("id = 1").first()["n_years_app"] == 4


def test_permutations_keep_blocks_and_signal_is_found(spark):
    perms = climate_index.block_permutations(39, 200, seed=1)
    assert all(sorted(p) == list(range(39)) for p in perms.tolist())
    assert np.mean(np.diff(perms, axis=1) == 1) > 0.4
    for p in climate_index.block_permutations(39, 300, seed=5):
        at = np.argsort(p)
        together = [{k for k in range(o, 38, 2) if at[k + 1] - at[k] == 1} == set(range(o, 38, 2)) for o in (0, 1)]
        assert any(together)
    rng = np.random.default_rng(0)
    x = rng.normal(size=39)
    rows = [(i, "a", [float(v) for v in ((2 * x if i < 60 else 0) + rng.normal(size=39))]) for i in range(120)] + [(120, "a", [1.0] * 39)]
    found = climate_index.permutation_slopes(spark.createDataFrame(rows, "id long, region string, y array<double>"), {"a": x.tolist()}, perms)
    points = climate_index.point_significance(found)
    p = {r["id"]: r["p"] for r in points.collect()}
    assert all(p[i] < 0.05 for i in range(60)) and p[120] == 1.0 and np.mean([p[i] < 0.05 for i in range(60, 120)]) < 0.2
    field = climate_index.field_significance(points, climate_index.hits_of(found)).first()
    assert field["field_p"] < 0.05 and field["n_points"] == 121


def test_bilinear_reproduces_a_plane_and_treats_gaps(spark):
    cube = spark.createDataFrame([(dt.date(2000, 1, 1), i, j, 1.0 + 2 * j + 3 * i) for i in range(3) for j in range(3)] + [(dt.date(2000, 1, 2), i, j, None if (i, j) == (0, 0) else 4.0) for i in range(3) for j in range(3)], "date date, row int, col int, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.0), (2, 2.0, -2.0), (3, 0.25, -0.75), (4, 9.0, 9.0)], "id long, lon double, lat double")
    corners = grid.bilinear_corners(pts, 0.0, 0.0, 1.0, -1.0, 3, 3)
    first = {r["id"]: r["value"] for r in grid.bilinear(cube, corners).where("date = '2000-01-01'").collect()}
    assert first == {1: 2.0, 2: 11.0, 3: 1.0 + 0.5 + 2.25, 4: 5.0}
    second = {r["id"]: r["value"] for r in grid.bilinear(cube, corners, "propagate").where("date = '2000-01-02'").collect()}
    assert second[1] is None and second[2] == 4.0 and second[3] is None
    with pytest.raises(ValueError):
        grid.bilinear(cube, corners, "other")


def test_points_must_lie_on_nodes(spark):
    g = grid.Grid(0.0, -80.0, 0.1, 4, 5)
    ok = spark.createDataFrame([(1, -80.0, 0.0), (2, -79.6, -0.3), (3, -79.9, -0.1)], "id long, lon double, lat double")
    assert [(r["row"], r["col"]) for r in grid.map_points(ok, g).orderBy("id").collect()] == [(0, 0), (3, 4), (1, 1)]
    for bad in ((-79.95, 0.0), (-79.0, 0.0)):
        with pytest.raises(DataError):
            grid.map_points(spark.createDataFrame([(1, *bad)], "id long, lon double, lat double"), g)
    with pytest.raises(DataError):
        grid.map_points(ok.union(ok), g)


def test_regions_must_not_overlap(spark):
    parts = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 1, 2), ("b", 0, 0, raster.NODATA)], "region string, y_idx int, x_idx int, value int")
    assert raster.merge_regions(parts).count() == 2
    with pytest.raises(DataError):
        raster.merge_regions(parts.union(spark.createDataFrame([("b", 0, 0, 3)], parts.schema)))


def test_lookup_is_strict(spark):
    pts = spark.createDataFrame([(1, -75.0, -12.0, 3500.0)], "id long, lon double, lat double, altitude double")
    ok = season.strict_lookup(spark.createDataFrame([(1, 5.0, 2)], "id long, lat double, n int"), pts, "lon", "lat")
    assert ok.columns == ["id", "lon", "lat", "n"] and ok.first()["lat"] == -12.0
    with pytest.raises(Exception, match="an id has no point"):
        season.strict_lookup(spark.createDataFrame([(9, 2)], "id long, n int"), pts, "lon").collect()


def test_classes():
    assert [classes.STEPS[False].first(x) for x in (0.7, 1.6, 2.2, 37, -1, 0)] == [1.0, 2.0, 2.5, 50.0, 1.0, 1.0]
    c = classes.around_zero(largest=3.2)
    assert c.breaks == [-b for b in reversed(c.breaks)] and c.breaks[-1] == 3.0


def test_magnitude_classes(spark):
    some = spark.range(10_000).select((F.col("id") % 9 + 4).cast("double").alias("v"))
    assert classes.magnitude(some, "v").breaks == [6.0, 8.0, 10.0, 12.0, 14.0] or len(classes.magnitude(some, "v").breaks) == 5
    zeros = spark.range(10_000).select(F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.pow(F.col("id") % 100 / 20.0, F.lit(4.0))).alias("v"))
    found = classes.magnitude(zeros, "v")
    assert found.zeros and found.labels[0] == "0"
    with pytest.raises(ValueError):
        classes.magnitude(some, "v", method="other")


def test_checks(spark):
    df = spark.range(3)
    assert none_where(df, F.col("id") > 5, "too large").count() == 3
    with pytest.raises(DataError):
        none_where(df, F.col("id") > 1, "too large")
    with pytest.raises(DataError):
        unique_key(df.union(df), "id")
    with pytest.raises(DataError):
        catalog.unexpected(df, spark.range(2))


def test_missing_index_months_stop_the_run(spark):
    monthly = spark.createDataFrame([(2000, m, 1.0) for m in range(1, 13)], "year int, month int, value double")
    years = climate_index.years_frame(spark, 2000, 2000)
    with pytest.raises(DataError):
        climate_index.season_means(monthly, years)
    assert {r["region"] for r in climate_index.season_means(monthly, years, strict=False).collect()} == {"midland", "lowland"}


def test_flagship_shuffles_its_series_once(spark):
    """Without broadcasts: the days' derivation, both sides of the join with the points, and the last sums. The window takes
    the join's partitioning; nothing is read twice, and neither sun times nor the treatment scan shuffles."""
    from terrafold.queries import flagship

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 4 and sum("season" in line for line in exchanges) == 1
    assert plan.count("Window [") == 1 and plan.count("FileScan parquet") == 2


def test_scan_refuses_days_out_of_order(spark):
    rows, df = series(spark, [30])
    with pytest.raises(Exception, match="out of order"):
        scan.by_batches(df.where("day <> 7").coalesce(1), "r", dealt=True).collect()


def test_lenient_lookup_does_not_multiply(spark):
    pts = spark.createDataFrame([(1, -75.0), (2, -76.0)], "id long, lon double")
    rows = spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "id long, n int")
    assert [(r["id"], r["lon"]) for r in season.lenient_lookup(rows, pts, "lon", "other").orderBy("n").collect()] == [(1, -75.0), (1, -75.0), (3, None)]
    with pytest.raises(Exception, match="more than one point"):
        season.lenient_lookup(rows, pts.union(pts), "lon").collect()


def test_pairs_of_region_and_period():
    periods = {"midland": ("main",), "highland": ("early", "late")}
    assert season.pairs(periods) == [("highland", "early"), ("highland", "late"), ("midland", "main")]
    assert season.pairs(periods, asked=[("midland", "main")]) == [("midland", "main")]
    with pytest.raises(ValueError, match="midland/late"):
        season.pairs(periods, asked=[("midland", "late")])
    with pytest.raises(ValueError):
        season.pairs({"elsewhere": ("main",)})


def test_intervals_of_very_long_series(spark):
    # critical values of printed tables: 200 degrees of freedom 1.97190, 1000 1.96234
    got = spark.createDataFrame([(200,), (1000,)], "d int").select(trend._critical(F.col("d"), 0.05).alias("t")).collect()
    assert abs(got[0]["t"] - 1.971896) < 1e-6 and abs(got[1]["t"] - 1.962339) < 1e-6
    assert abs(trend.student.critical(150) - spark.range(1).select(trend._critical(F.lit(151) * 1, 0.05).alias("t")).first()["t"]) < 2e-4


def test_ranks_of_a_column(spark, monkeypatch):
    from terrafold.functions import ranks

    monkeypatch.setattr(ranks, "FEW", 20)
    monkeypatch.setattr(ranks, "BINS", 7)
    v = np.concatenate([np.random.default_rng(4).lognormal(3, 2, 900), np.full(300, 5.0), [-1e6, 1e9]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    shares = [0.0, 0.013, 0.25, 0.5, 0.77, 0.99, 1.0]
    assert np.allclose(ranks.percentiles(df, shares), np.quantile(v, shares), rtol=1e-12)
    assert ranks.percentiles(df.limit(0), shares) is None


def test_tree_diff_deals_once_into_many_parts(spark):
    """Both sides and their comparison share one shuffle by key, whose parts adaptive execution does not join."""
    from terrafold import queries

    found = queries.tree_diff(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_key = re.findall(r"hashpartitioning\(id#\d+L?, date#\d+, (\d+)\), (\w+)", plan)
    assert by_key and set(by_key) == {(str(queries.DIFF_PARTS), "REPARTITION_BY_NUM")}
    row = found.first()
    assert row["n_common"] and row["n_only_old"] and row["n_only_new"]
    rows = star.daily_of(queries.table(spark, "/root/testdata/sf0.001", "lineitem"))
    assert not rows.exceptAll(star.daily_of(queries.table(spark, "/root/testdata/sf0.001", "lineitem"), 7)).count()
