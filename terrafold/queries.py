"""One query for each operator, over tables of the star schema read as climate data (sources/star.py), each with SQL for
another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import classes, diurnal, ranks, scores, solar
from terrafold.operators import catalog, climate, climate_index, grid, raster, scan, season, trend
from terrafold.sources import star

Query = Callable[[SparkSession, str], DataFrame]
DIFF_PARTS = 200
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- inputs: the same in Spark and in SQL -------------------------------------------------------------------------


def daily(spark: SparkSession, d: str) -> DataFrame:
    return star.daily_of(table(spark, d, "lineitem"))


DAILY = """daily AS (SELECT id, date, (q % 64) / 8.0 AS tmin, (q % 64) / 8.0 + 6 + c % 8 AS tmax, (q % 64) / 8.0 + (n % 16) / 4.0 - 1 AS tdew,
    ((q + 3 * c) % 48) / 4.0 AS rain, q, c, n FROM (
    SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS q, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return star.points_of(table(spark, d, "supplier"))


POINTS = """points AS (SELECT id, lon, lat, altitude, type, CASE WHEN altitude >= 3000 THEN 'highland' WHEN altitude >= 2000 THEN 'midland' ELSE 'lowland' END AS region FROM (
    SELECT s_suppkey AS id, CAST(-81.0 + (s_suppkey % 40) * 0.25 AS DOUBLE) AS lon, CAST(-0.5 - (s_suppkey % 64) * 0.25 AS DOUBLE) AS lat, CAST((s_suppkey * 37) % 4500 AS DOUBLE) AS altitude,
    CASE WHEN (s_suppkey * 37) % 4500 >= 3000 THEN 'Sierra Alta [>3,000]' WHEN (s_suppkey * 37) % 4500 >= 2000 THEN 'Sierra Media [2000-3000 masl]' WHEN (s_suppkey * 37) % 4500 >= 500 THEN 'Interandino [500 - 2,000]' ELSE 'Costa [0-500 msnm]' END AS type FROM supplier))"""

SEASON = """seasoned AS (SELECT d.*, p.region, p.lat, p.lon, year(date) - CASE WHEN region = 'highland' AND month(date) <= 4 THEN 1 ELSE 0 END AS season FROM daily d JOIN points p USING (id)
    WHERE CASE region WHEN 'highland' THEN month(date) >= 11 OR month(date) <= 4 WHEN 'midland' THEN month(date) BETWEEN 4 AND 7 ELSE month(date) BETWEEN 7 AND 12 END)"""


def seasoned(spark: SparkSession, d: str) -> DataFrame:
    return season.assign(daily(spark, d), points(spark, d))


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders of a year as a point's yearly results: id, year, region, app."""
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 97).alias("id"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("app"), F.sum(F.floor("o_totalprice")).alias("sum_bu"))
    return rows.withColumn("region", F.element_at(F.array(*[F.lit(r) for r in season.REGIONS]), (F.col("id") % 3 + 1).cast("int")))


YEARLY = """yearly AS (SELECT o_custkey % 97 AS id, year(o_orderdate) AS year, count(*) AS app, CAST(sum(floor(o_totalprice)) AS BIGINT) AS sum_bu,
    ['highland', 'midland', 'lowland'][o_custkey % 97 % 3 + 1] AS region FROM orders GROUP BY ALL)"""


def monthly_index(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a month as an index between -2 and 4."""
    rows = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("year", "month", ((F.col("n") * 37) % 193 / 32.0 - 2).alias("value"))


INDEX = "monthly AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, (count(*) * 37) % 193 / 32.0 - 2 AS value FROM orders GROUP BY ALL)"
MEANS = """months AS (SELECT r.region, CAST(y.year AS INTEGER) AS year, k FROM (VALUES ('midland', 3, 6), ('lowland', 6, 11), ('highland', 10, 15)) r(region, a, b), range(1995, 2002) y(year), range(0, 16) t(k) WHERE k BETWEEN a AND b),
    means AS (SELECT region, m.year, avg(value) AS value FROM months m LEFT JOIN monthly i ON i.year = m.year + k // 12 AND i.month = k % 12 + 1 GROUP BY region, m.year HAVING count(*) = count(value))"""


def index_means(spark: SparkSession, d: str) -> DataFrame:
    return climate_index.season_means(monthly_index(spark, d), climate_index.years_frame(spark, 1995, 2001), strict=False)


# ---- joins, seasons, reductions ------------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT id, date, tmin, tmax, rain FROM daily WHERE c % 8 <> 3 AND q % 5 <> 0 AND n % 7 <> 1")
def climate_window_join(spark, d):
    rows = daily(spark, d)
    part = lambda c, keep: rows.where(keep).select("id", "date", F.col(c).alias("value"))
    return climate.join_variables({"tmin": part("tmin", F.col("c") % 8 != 3), "tmax": part("tmax", F.col("q") % 5 != 0), "rain": part("rain", F.col("n") % 7 != 1)})


@query(f"WITH {DAILY} SELECT id, date, CASE WHEN c % 3 = 0 THEN 0.0 ELSE rain END AS value FROM daily WHERE date BETWEEN DATE '1996-02-10' AND DATE '1996-05-20' AND id % 2 = 0")
def filtered_scan(spark, d):
    rows = daily(spark, d)
    long = rows.select(F.lit("rain").alias("variable"), F.year("date").alias("year"), F.month("date").alias("month"), "id", "date", F.when(F.col("c") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("rain")).alias("value"))
    return climate.read_window(long, "rain", "1996-02-10", "1996-05-20", points(spark, d).where("id % 2 = 0"))


@query(f"WITH {DAILY}, {POINTS} SELECT id, altitude, type, date, rain FROM daily JOIN points USING (id)")
def strict_point_join(spark, d):
    return season.strict_lookup(daily(spark, d).select("id", "date", "rain"), points(spark, d), "altitude", "type")


@query(f"WITH {POINTS} SELECT region, count(*) AS n_points, min(altitude) AS lowest, max(altitude) AS highest FROM points GROUP BY region")
def region_split(spark, d):
    return season.split_regions(points(spark, d)).groupBy("region").agg(F.count(F.lit(1)).alias("n_points"), F.min("altitude").alias("lowest"), F.max("altitude").alias("highest"))


@query(f"WITH {DAILY}, {POINTS}, {SEASON} SELECT id, season, region, count(*) AS n_days, min(date) AS first, max(date) AS last, sum(rain) AS rain FROM seasoned GROUP BY ALL")
def season_assign(spark, d):
    return seasoned(spark, d).groupBy("id", "season", "region").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("rain").alias("rain"))


@query(f"""WITH {DAILY}, {POINTS}, years AS (SELECT unnest(range(min(year(date)), max(year(date)) + 1)) AS y, max(year(date)) AS horizon FROM daily), r AS (SELECT region, count(*) AS n_points FROM points GROUP BY region),
    t AS (SELECT CAST(y AS INTEGER) AS year, region, CASE region WHEN 'highland' THEN make_date(y, 11, 1) WHEN 'midland' THEN make_date(y, 4, 1) ELSE make_date(y, 7, 1) END AS start,
    CASE region WHEN 'highland' THEN make_date(y + 1, 4, 30) WHEN 'midland' THEN make_date(y, 7, 31) ELSE make_date(y, 12, 31) END AS "end", n_points, horizon FROM years, r)
    SELECT year, region, start, "end", n_points FROM t WHERE year("end") <= horizon""")
def season_tasks(spark, d):
    """The seasons of the data's own years that end within them, with the points that each has to run."""
    span = daily(spark, d).agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b")).first()
    if span["a"] is None:
        span = {"a": 0, "b": -1}
    sizes = season.split_regions(points(spark, d)).groupBy("region").agg(F.count(F.lit(1)).alias("n_points"))
    return season.tasks(spark, span["a"], span["b"], horizon=span["b"]).join(sizes, "region")


_RESULTS = "results AS (SELECT id, season, region, date, CAST(c % 8 AS INTEGER) AS bu, CAST(q % 7 AS INTEGER) AS fu, CAST(n % 9 AS INTEGER) AS applications FROM seasoned)"


def results(spark, d):
    return seasoned(spark, d).select("id", "season", "region", "date", (F.col("c") % 8).cast("int").alias("bu"), (F.col("q") % 7).cast("int").alias("fu"), (F.col("n") % 9).cast("int").alias("applications"))


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {_RESULTS} SELECT id, season AS year, region, max(applications) AS app, CAST(sum(bu) AS BIGINT) AS sum_bu, CAST(sum(fu) AS BIGINT) AS sum_fu, count(*) AS n_days FROM results GROUP BY ALL")
def season_reduce(spark, d):
    return season.reduce_seasons(results(spark, d))


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {_RESULTS} SELECT id, year(date) AS year, max_by(region, season) AS region, max(applications) AS app, CAST(sum(bu) AS BIGINT) AS sum_bu, CAST(sum(fu) AS BIGINT) AS sum_fu, count(*) AS n_days FROM results GROUP BY id, year(date)")
def calendar_reduce(spark, d):
    return season.reduce_seasons(results(spark, d), by="calendar")


_COVERAGE = """coverage AS (SELECT year, region, start, "end", first, last, n_days, n_ids, last < "end" - 2 OR first > start + 2 AS truncated FROM (
    SELECT season AS year, region, min(date) AS first, max(date) AS last, count(DISTINCT date) AS n_days, count(DISTINCT id) AS n_ids,
    CASE region WHEN 'highland' THEN make_date(season, 11, 1) WHEN 'midland' THEN make_date(season, 4, 1) ELSE make_date(season, 7, 1) END AS start,
    CASE region WHEN 'highland' THEN make_date(season + 1, 4, 30) WHEN 'midland' THEN make_date(season, 7, 31) ELSE make_date(season, 12, 31) END AS "end" FROM seasoned GROUP BY season, region))"""


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {_COVERAGE} SELECT * FROM coverage")
def coverage_report(spark, d):
    return season.coverage(seasoned(spark, d))


@query(f"WITH {DAILY}, {POINTS}, {SEASON}, {_COVERAGE} SELECT s.season AS year, s.region, count(*) AS n FROM seasoned s JOIN coverage c ON c.year = s.season AND c.region = s.region WHERE NOT truncated GROUP BY ALL")
def truncated_exclusion(spark, d):
    rows = seasoned(spark, d)
    return season.without_truncated(rows.withColumnRenamed("season", "year"), season.coverage(rows)).groupBy("year", "region").agg(F.count(F.lit(1)).alias("n"))


_PRESENT = "present AS (SELECT DISTINCT l_returnflag AS variable, year(l_shipdate) AS year, month(l_shipdate) AS month FROM lineitem WHERE month(l_shipdate) <> 7), asked AS (SELECT v AS variable, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM (VALUES ('A'), ('N'), ('R')) t(v), range(1995, 2002) a(y), range(1, 13) b(m))"


def _present(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variable"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).where("month <> 7").distinct()


@query(f"WITH {_PRESENT} SELECT * FROM asked ANTI JOIN present USING (variable, year, month)")
def missing_months(spark, d):
    return catalog.missing_months(_present(spark, d), catalog.months(spark, 1995, 2001), ["A", "N", "R"]).select("variable", "year", "month")


@query(f"WITH {_PRESENT}, gone AS (SELECT variable, count(*) AS n FROM asked ANTI JOIN present USING (variable, year, month) GROUP BY variable) SELECT p.variable, count(*) AS n_present, min(year * 100 + month) AS first, max(year * 100 + month) AS last, any_value(coalesce(g.n, 0)) AS n_missing FROM present p LEFT JOIN gone g USING (variable) GROUP BY p.variable")
def layout_report(spark, d):
    return catalog.layout_report(_present(spark, d), catalog.months(spark, 1995, 2001), ["A", "N", "R"])


@query(f"WITH {_PRESENT} SELECT variable, year, month FROM asked WHERE month = 7")
def resume_to_do(spark, d):
    names = spark.createDataFrame([("A",), ("N",), ("R",)], "variable string")
    asked = catalog.months(spark, 1995, 2001).join(F.broadcast(names), how="cross")
    return catalog.to_do(asked.where("month = 7"), _present(spark, d), "variable", "year", "month").select("variable", "year", "month")


# ---- sun, hours, scores, scan --------------------------------------------------------------------------------------

_T = "((date - DATE '1970-01-01') + 2440588.0 - 2451545.0) / 36525.0"
# Polynomial coefficients of the public algorithm, as in functions/solar.py.
_SUN = f"""suntime AS (SELECT date, degrees(asin(sin(obl) * sin(app))) AS declination,
    4 * degrees(y * sin(2 * l0) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0) - 1.25 * ecc * ecc * sin(2 * m)) AS eot FROM (
    SELECT *, pow(tan(obl / 2), 2) AS y, radians(ml + sin(m) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(2 * m) * (0.019993e0 - 0.000101e0 * t) + sin(3 * m) * 0.000289e0 - 0.00569e0 - 0.00478e0 * sin(node)) AS app FROM (
    SELECT *, radians(ml) AS l0, radians(23e0 + (26e0 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60e0) / 60e0 + 0.00256e0 * cos(node)) AS obl FROM (
    SELECT date, t, (280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)) % 360e0 AS ml, radians(357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t)) AS m,
    0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS ecc, radians(125.04e0 - 1934.136e0 * t) AS node FROM (SELECT DISTINCT date, CAST({_T} AS DOUBLE) AS t FROM DAYS)))))"""


def _sun_sql(days: str, lat: str, lon: str) -> tuple[str, str, str]:
    cosine = f"(cos(radians(90.833e0)) / (cos(radians({lat})) * cos(radians(declination))) - tan(radians({lat})) * tan(radians(declination)))"
    angle = f"degrees(acos(CASE WHEN abs({cosine}) <= 1 THEN {cosine} END))"
    noon = f"(720e0 - 4e0 * {lon} - eot - 300e0)"
    return _SUN.replace("FROM DAYS", f"FROM {days}"), f"({noon} - 4 * {angle}) / 60e0", f"({noon} + 4 * {angle}) / 60e0"


_SUN_CTE, _RISE, _SET = _sun_sql("days", "lat", "lon")


@query(f"WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), {_SUN_CTE} SELECT date, lat, round({_RISE}, 6) AS sunrise, round({_SET}, 6) AS sunset FROM suntime, (VALUES (-12.5e0, -75e0), (-0.25e0, -78.5e0), (64e0, 20e0)) p(lat, lon)")
def solar_times(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    places = spark.createDataFrame([(-12.5, -75.0), (-0.25, -78.5), (64.0, 20.0)], "lat double, lon double")
    terms = days.select("date", *[c.alias(n) for n, c in solar.day_terms(F.col("date")).items()])
    rise, set_ = solar.sun_hours(F.col("lat"), F.col("lon"), F.col("declination"), F.col("equation_of_time"))
    return terms.join(F.broadcast(places), how="cross").select("date", "lat", F.round(rise, 6).alias("sunrise"), F.round(set_, 6).alias("sunset"))


def _hour_sql(b: str = "") -> str:
    """Hours 1..24 as a list; b: suffix of the day's columns, whose day before has the next number."""
    c = {"": "1", "1": "2"}[b]
    tp = "tmin_next" if b == "" else "tmin"
    peak, to, to_b = f"(sunset{b} - 4e0)", f"(tmax{b} - 0.39e0 * (tmax{b} - {tp}))", f"(tmax{c} - 0.39e0 * (tmax{c} - tmin{c}))"
    half = "1.5707963267948966e0"
    return f"""list_transform(range(1, 25), lambda h: CASE
        WHEN h <= sunrise{b} THEN {to_b} + (tmin{b} - {to_b}) / sqrt(sunrise{c} + 24e0 - sunset{c}) * sqrt(greatest(h + 24e0 - sunset{c}, 0e0))
        WHEN h <= {peak} THEN tmin{b} + (tmax{b} - tmin{b}) * ((h - sunrise{b}) / ({peak} - sunrise{b})) * {half}
        WHEN h <= sunset{b} THEN {to} + (tmax{b} - {to}) * sin({half} + (h - {peak}) / 4e0 * {half})
        ELSE {to} + ({tp} - {to}) / sqrt(sunrise{b} + 24e0 - sunset{b}) * sqrt(greatest(h - sunset{b}, 0e0)) END)"""


_SHIFT = f"""{_sun_sql('seasoned', 'lat', 'lon')[0]}, sunny AS (SELECT s.id, s.season, s.region, s.date, CAST(tmin AS DOUBLE) AS tmin, CAST(tmax AS DOUBLE) AS tmax, CAST(tdew AS DOUBLE) AS tdew, CAST(rain AS DOUBLE) AS rain, {_RISE} AS sunrise, {_SET} AS sunset FROM seasoned s JOIN suntime USING (date)),
    shifted AS (SELECT * FROM (SELECT *, lag(tmin) OVER w AS tmin1, lag(tmax) OVER w AS tmax1, lag(tdew) OVER w AS tdew1, lag(sunrise) OVER w AS sunrise1, lag(sunset) OVER w AS sunset1,
    lag(tmin, 2) OVER w AS tmin2, lag(tmax, 2) OVER w AS tmax2, lag(sunrise, 2) OVER w AS sunrise2, lag(sunset, 2) OVER w AS sunset2, lead(tmin) OVER w AS tmin_next, row_number() OVER w AS rn, lead(date, 2) OVER w AS more
    FROM sunny WINDOW w AS (PARTITION BY id, season ORDER BY date)) WHERE rn > 2 AND more IS NOT NULL)"""
_E = lambda t: f"(0.61121e0 * exp((18.678e0 - {t} / 234.5e0) * {t} / (257.14e0 + {t})))"
_HUMID = f"""{_SHIFT}, hours AS (SELECT *, list_concat(list_slice({_hour_sql('1')}, 13, 24), list_slice({_hour_sql('')}, 1, 12)) AS t FROM shifted),
    wetness AS (SELECT *, list_filter(range(1, 25), lambda i: 100e0 * (CASE WHEN i <= 12 THEN {_E('tdew1')} ELSE {_E('tdew')} END) / {_E('t[i]')} >= 90e0) AS wet FROM hours),
    humid AS (SELECT id, season, region, date, CAST(len(wet) AS INTEGER) AS humid_hours, CASE WHEN len(wet) > 0 THEN list_sum(list_transform(wet, lambda i: t[i])) / len(wet) ELSE list_sum(t) / 24 END AS humid_tmean, rain, (tmin + tmax) / 2 AS tavg FROM wetness)"""
_BASE = f"WITH RECURSIVE {DAILY}, {POINTS}, {SEASON}"


def humid(spark, d, method: str = "arrow"):
    rows = climate.sun_times(season.assign(daily(spark, d), points(spark, d), "lat", "lon"))
    return climate.humid_days(rows, ("id", "season", "region"), method=method)


@query(f"{_BASE}, {_SHIFT} SELECT id, season, date, round(t[1], 6) AS h1, round(t[7], 6) AS h7, round(t[12], 6) AS h12, round(t[15], 6) AS h15, round(t[18], 6) AS h18, round(t[24], 6) AS h24 FROM (SELECT *, {_hour_sql('')} AS t FROM shifted)")
def diurnal_hours(spark, d):
    from pyspark.sql.window import Window

    rows = climate.sun_times(season.assign(daily(spark, d), points(spark, d), "lat", "lon"))
    w = Window.partitionBy("id", "season").orderBy("date")
    names = ("tmin", "tmax", "sunrise", "sunset")
    s = rows.select("id", "season", "date", *names, *[F.lag(n).over(w).alias(f"{n}1") for n in names], F.lead("tmin").over(w).alias("next"), F.row_number().over(w).alias("rn"), F.lead("date", 2).over(w).alias("more"))
    c = F.col
    t = diurnal.hours_column(c("tmin"), c("tmax"), c("next"), c("sunrise"), c("sunset"), c("tmin1"), c("tmax1"), c("sunrise1"), c("sunset1"))
    return s.where("rn > 2 and more is not null").withColumn("t", t).select("id", "season", "date", *[F.round(F.col("t")[h - 1], 6).alias(f"h{h}") for h in (1, 7, 12, 15, 18, 24)])


_HUMID_OUT = f"{_BASE}, {_HUMID} SELECT id, season, region, date, humid_hours, round(humid_tmean, 6) AS humid_tmean, rain, tavg FROM humid"


@query(_HUMID_OUT)
def humid_hours(spark, d):
    return humid(spark, d).drop("day").withColumn("humid_tmean", F.round("humid_tmean", 6))


@query(_HUMID_OUT)
def humid_hours_sql(spark, d):
    return humid(spark, d, "sql").drop("day").withColumn("humid_tmean", F.round("humid_tmean", 6))


@query(f"{_BASE}, {_HUMID} SELECT id, season, sum(rain) AS rain, count(*) FILTER (humid_hours >= 7) AS wet_days FROM humid GROUP BY ALL")
def season_climate(spark, d):
    return season.season_climate(humid(spark, d))


_EVENT_DAYS = """days AS (SELECT user_id AS id, date, CAST(count(*) * 5 % 26 AS INTEGER) AS h, CAST(sum(event_id) AS BIGINT) % 240 / 8.0 AS t, CAST(sum(event_id) AS BIGINT) % 49 / 4.0 AS rain, any_value(day) AS day
    FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS date, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS day FROM events) GROUP BY user_id, date)"""


def _event_days(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("k"), F.sum("event_id").alias("e"))
    return rows.select("id", "date", (F.col("k") * 5 % 26).cast("int").alias("h"), (F.col("e") % 240 / 8.0).alias("t"), (F.col("e") % 49 / 4.0).alias("rain"), F.row_number().over(Window.partitionBy("id").orderBy("date")).alias("day"))


@query(f"WITH {_EVENT_DAYS} SELECT id, date, " + ", ".join(f"CAST({scores.blight_sql('h', 't', k)} AS INTEGER) AS bu_{k}" for k in scores.CLASSES) + " FROM days")
def blight_scores(spark, d):
    return _event_days(spark, d).select("id", "date", *[scores.blight_units(F.col("h"), F.col("t"), k).alias(f"bu_{k}") for k in scores.CLASSES])


@query(f"WITH {_EVENT_DAYS} SELECT id, date, CAST({scores.washoff_sql('rain', 'day')} AS INTEGER) AS fu, CAST((((CAST({scores.washoff_sql('rain', 'day')} AS INTEGER) * 40 + 128) % 256) + 256) % 256 - 128 AS INTEGER) AS narrow FROM days")
def washoff_scores(spark, d):
    fu = scores.washoff_units(F.col("rain"), F.col("day"))
    return _event_days(spark, d).select("id", "date", fu.alias("fu"), scores.narrow(fu * 40).alias("narrow"))


def _scan_sql(days: str, kind: str) -> str:
    """days: id, season, date, day, bu, fu, in full sequence."""
    b, f = scores.BLIGHT_DUE[kind], scores.WASHOFF_DUE[kind]
    step = f"(x.day = 26 OR ((s.sb + x.bu >= {b} OR s.sf + x.fu > {f}) AND s.since + 1 > 5 AND s.n > 0))"
    return f"""scan AS (SELECT id, season, CAST(0 AS BIGINT) AS day, CAST(NULL AS DATE) AS date, 0 AS bu, 0 AS fu, 0 AS acc_bu, 0 AS acc_fu, 0 AS sb, 0 AS sf, 0 AS since, 0 AS n FROM (SELECT DISTINCT id, season FROM {days})
    UNION ALL SELECT x.id, x.season, x.day, x.date, x.bu, CASE WHEN {step} THEN 0 ELSE x.fu END, CASE WHEN {step} THEN s.sb + x.bu ELSE 0 END, CASE WHEN {step} THEN s.sf + x.fu ELSE 0 END,
    CASE WHEN {step} THEN 0 ELSE s.sb + x.bu END, CASE WHEN {step} THEN 0 ELSE s.sf + x.fu END, CASE WHEN {step} THEN 0 ELSE s.since + 1 END, s.n + CASE WHEN {step} THEN 1 ELSE 0 END
    FROM scan s JOIN {days} x ON x.id = s.id AND x.season = s.season AND x.day = s.day + 1)"""


_SCAN_OUT = "SELECT id, season, date, CAST(day AS INTEGER) AS day, bu, fu, acc_bu, acc_fu, n AS applications FROM scan WHERE day > 0"
_LONG = "longdays AS (SELECT id, 0 AS season, date, row_number() OVER (PARTITION BY id ORDER BY date) AS day, CAST(c * 3 % 8 AS INTEGER) AS bu, CAST(q % 7 AS INTEGER) AS fu FROM daily)"


def _long_days(spark, d):
    from pyspark.sql.window import Window

    return daily(spark, d).select("id", F.lit(0).alias("season"), "date", F.row_number().over(Window.partitionBy("id").orderBy("date")).alias("day"), (F.col("c") * 3 % 8).cast("int").alias("bu"), (F.col("q") % 7).cast("int").alias("fu"))


def _scan_query(kind: str) -> None:
    def run(spark, d):
        return scan.by_batches(_long_days(spark, d), kind)

    run.__name__ = f"application_scan_{kind}"
    query(f"WITH RECURSIVE {DAILY}, {_LONG}, {_scan_sql('longdays', kind)} {_SCAN_OUT}")(run)


for _kind in scores.CLASSES:
    _scan_query(_kind)


@query(f"WITH RECURSIVE {DAILY}, {_LONG}, {_scan_sql('longdays', 'ms')} {_SCAN_OUT}")
def application_scan_fold(spark, d):
    return scan.by_arrays(_long_days(spark, d), "ms")


def flagship(spark, d, kind: str = "s"):
    """Days to seasons: sun, hours, scores, treatments, and the season's sums for each point."""
    keys = ("id", "season", "region")
    treated = scan.by_batches(scan.scored(humid(spark, d), kind, keys), kind, keys, dealt=True)
    return season.reduce_seasons(treated)


_SCORED = f"""{_BASE}, {_HUMID}, scored AS (SELECT id, season, date, row_number() OVER (PARTITION BY id, season ORDER BY date) AS day, CAST({scores.blight_sql('humid_hours', 'humid_tmean', 's')} AS INTEGER) AS bu, rain, region FROM humid),
    ready AS (SELECT id, season, date, day, bu, CAST({scores.washoff_sql('rain', 'day')} AS INTEGER) AS fu FROM scored), {_scan_sql('ready', 's')}"""
ORACLE_SQL["flagship"] = f"""{_SCORED}
    SELECT s.id, s.season AS year, p.region, max(n) AS app, CAST(sum(bu) AS BIGINT) AS sum_bu, CAST(sum(fu) AS BIGINT) AS sum_fu, count(*) AS n_days FROM scan s JOIN points p USING (id) WHERE day > 0 GROUP BY ALL"""
#: The same with whether the season is truncated: what a job that keeps seasons up to date has in the end.
SEASON_UPDATE_SQL = f"""{_SCORED}, {_COVERAGE}, sums AS (SELECT s.id, s.season AS year, p.region, max(n) AS app, CAST(sum(bu) AS BIGINT) AS sum_bu, CAST(sum(fu) AS BIGINT) AS sum_fu, count(*) AS n_days FROM scan s JOIN points p USING (id) WHERE day > 0 GROUP BY ALL)
    SELECT s.*, truncated FROM sums s JOIN coverage c USING (year, region)"""
QUERIES["flagship"] = flagship


# ---- trends --------------------------------------------------------------------------------------------------------

_OLS = f"""{YEARLY}, sums AS (SELECT id, count(app) AS n, CAST(count(app) * sum((year - 2000) * app) - sum(year - 2000) * sum(app) AS DOUBLE) AS a, CAST(count(app) * sum((year - 2000) * (year - 2000)) - sum(year - 2000) * sum(year - 2000) AS DOUBLE) AS b,
    CAST(count(app) * sum(app * app) - sum(app) * sum(app) AS DOUBLE) AS c, max(app) - min(app) AS span FROM yearly GROUP BY id),
    fit AS (SELECT id, n, CASE WHEN n >= 5 THEN CASE WHEN span = 0 THEN 0e0 ELSE a / b END END AS slope, CASE WHEN n >= 5 THEN CASE WHEN span = 0 THEN 0e0 ELSE sqrt(greatest(0e0, b * c - a * a) / (b * b * (n - 2))) END END AS se,
    CASE WHEN n >= 5 AND span <> 0 THEN least(1e0, a * a / (b * c)) END AS r2, span, n - 2 AS dof FROM sums),
    angle AS (SELECT *, atan(abs(slope / se) / sqrt(dof)) AS a FROM fit),
    terms AS (SELECT *, list_sum(list_transform(range(0, CASE WHEN dof % 2 = 1 THEN (dof - 1) // 2 ELSE dof // 2 END), lambda k: pow(cos(a), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: CASE WHEN dof % 2 = 1 THEN 2e0 * j / (2 * j + 1) ELSE (2e0 * j - 1) / (2 * j) END)), 1))) AS total FROM angle),
    pval AS (SELECT *, CASE WHEN slope IS NOT NULL THEN CASE WHEN span = 0 THEN 1 WHEN se = 0 THEN 0 ELSE greatest(0, 1 - CASE WHEN dof % 2 = 1 THEN (a + sin(a) * cos(a) * coalesce(total, 0)) * 2 / pi() ELSE sin(a) * total END) END END AS p FROM terms)"""


@query(f"WITH {_OLS} SELECT id, slope + 0e0 AS slope_app, se AS std_err_app, round(p, 6) AS p_value_app, r2 AS r_squared_app, CAST(n AS INTEGER) AS n_years_app FROM pval")
def ols_trend(spark, d):
    out = trend.ols(yearly(spark, d), ("app", "sum_bu"), min_years=5)
    return out.select("id", (F.col("slope_app") + 0.0).alias("slope_app"), "std_err_app", F.round("p_value_app", 6).alias("p_value_app"), "r_squared_app", "n_years_app")


_CRITICAL = "(VALUES (3, 3.182446305284263e0), (4, 2.776445105198055e0), (5, 2.570581835636314e0)) c(dof, tc)"


@query(f"WITH {_OLS} SELECT id, round(slope - tc * se, 6) AS conf_int_lower_app, round(slope + tc * se, 6) AS conf_int_upper_app FROM pval JOIN {_CRITICAL} USING (dof) WHERE slope IS NOT NULL")
def trend_intervals(spark, d):
    out = trend.ols(yearly(spark, d), ("app",), min_years=5).where("slope_app is not null and n_years_app between 5 and 7")
    return out.select("id", F.round("conf_int_lower_app", 6).alias("conf_int_lower_app"), F.round("conf_int_upper_app", 6).alias("conf_int_upper_app"))


@query(f"""WITH {_OLS}, classed AS (SELECT CASE WHEN p >= 0.3 THEN 1 WHEN p < 0.3 AND slope > 0 THEN 2 WHEN p < 0.3 AND slope < 0 THEN 3 ELSE 0 END AS trend_class FROM range(0, 120) g(id) LEFT JOIN pval USING (id))
    SELECT trend_class, count(*) AS n_points, round(CASE WHEN trend_class > 0 THEN 100.0 * count(*) / sum(CASE WHEN trend_class > 0 THEN count(*) END) OVER () END, 6) AS share FROM classed GROUP BY trend_class""")
def trend_classes(spark, d):
    stats = trend.ols(yearly(spark, d), ("app",), min_years=5)
    rows = trend.on_grid(spark.range(120), stats).withColumn("trend_class", trend.significance(F.col("p_value_app"), F.col("slope_app"), 0.3))
    return trend.class_shares(rows).withColumn("share", F.round("share", 6))


@query(f"WITH {_OLS} SELECT id, round(slope * 10, 6) AS slope_decade FROM pval WHERE p < 0.3")
def slope_decade(spark, d):
    return trend.per_decade(trend.ols(yearly(spark, d), ("app",), min_years=5), "app", 0.3).withColumn("slope_decade", F.round("slope_decade", 6))


# ---- climate index -------------------------------------------------------------------------------------------------

_CATEGORY = "CASE WHEN value IS NULL THEN 'neutra' WHEN value < -0.7 THEN 'fría' WHEN value < 0.5 THEN 'neutra' WHEN value < 1.3 THEN 'cálida débil' WHEN value < 2.1 THEN 'cálida moderada' WHEN value < 3.5 THEN 'cálida fuerte' ELSE 'cálida extraordinaria' END"
_LABEL = "CASE WHEN region = 'highland' THEN printf('%d/%02d', year, (year + 1) % 100) ELSE CAST(year AS VARCHAR) END"


@query(f"WITH {INDEX}, {MEANS} SELECT region, year, round(value, 6) AS value FROM means")
def index_season_mean(spark, d):
    return index_means(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {INDEX}, {MEANS} SELECT region, year, {_LABEL} AS season, {_CATEGORY} AS category FROM means")
def index_category(spark, d):
    return index_means(spark, d).select("region", "year", climate_index.season_label(F.col("region"), F.col("year")).alias("season"), climate_index.category(F.col("value")).alias("category"))


_EVENTS = "happened AS (SELECT * FROM (VALUES ('first', 1996), ('first', 1997), ('second', 1999), ('second', 2000)) e(event, year))"
_CHOSEN = f"{_EVENTS}, ranked AS (SELECT event, region, year, value, row_number() OVER (PARTITION BY event, region ORDER BY value DESC, year) AS k FROM happened JOIN means USING (year)), chosen AS (SELECT event, region, CASE WHEN value > 0.5 THEN year END AS year, CASE WHEN value > 0.5 THEN value END AS value FROM ranked WHERE k = 1)"


def _chosen(spark, d):
    happened = spark.createDataFrame([("first", 1996), ("first", 1997), ("second", 1999), ("second", 2000)], "event string, year int")
    return climate_index.event_seasons(index_means(spark, d), happened)


@query(f"WITH {INDEX}, {MEANS}, {_CHOSEN} SELECT event, region, year, round(value, 6) AS value FROM chosen")
def event_peak(spark, d):
    return _chosen(spark, d).withColumn("value", F.round("value", 6))


_PLACE = "place AS (SELECT id, -(id % 18) * 1.0e0 AS lat, CASE WHEN -(id % 18) < -15 THEN 'Sur' WHEN -(id % 18) < -9 THEN 'Centro' ELSE 'Norte' END AS zone FROM range(0, 97) t(id))"


def _place(spark):
    return spark.range(97).select("id", (-(F.col("id") % 18)).cast("double").alias("lat"))


_UNITS = f"""{YEARLY}, {INDEX}, {MEANS}, {_PLACE}, unit AS (SELECT region, zone, year, avg(app) AS unit_mean, count(DISTINCT id) AS n_points FROM yearly JOIN place USING (id) GROUP BY ALL),
    unit_table AS (SELECT u.*, m.value, avg(unit_mean) OVER (PARTITION BY region, zone) AS am FROM unit u LEFT JOIN means m USING (region, year))"""


@query(f"WITH {_UNITS} SELECT region, zone, year, {_LABEL} AS season, round(value, 6) AS index_value, {_CATEGORY} AS category, round(unit_mean, 6) AS unit_mean, round(unit_mean - am, 6) AS anomaly, round(100 * (unit_mean - am) / am, 6) AS anomaly_pct, n_points FROM unit_table")
def unit_anomaly(spark, d):
    out = climate_index.unit_table(yearly(spark, d), _place(spark), index_means(spark, d), "app")
    return out.withColumns({c: F.round(c, 6) for c in ("index_value", "unit_mean", "anomaly", "anomaly_pct")})


@query(f"""WITH {_UNITS}, s AS (SELECT region, zone, regr_sxx(unit_mean, value) AS sxx, regr_sxy(unit_mean, value) AS sxy, regr_syy(unit_mean, value) AS syy, avg(unit_mean) AS mean, count(*) AS n_years FROM unit_table WHERE value IS NOT NULL GROUP BY ALL)
    SELECT region, zone, round(sxy / sxx, 6) AS slope, round(100 * sxy / sxx / mean, 6) AS slope_pct, round(CASE WHEN syy > 0 THEN sxy / sqrt(sxx * syy) ELSE 0 END, 6) AS r, round(mean, 6) AS mean, n_years FROM s""")
def unit_regression(spark, d):
    out = climate_index.unit_regressions(climate_index.unit_table(yearly(spark, d), _place(spark), index_means(spark, d), "app"))
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "slope_pct", "r", "mean")})


_NEUTRAL = "neutral AS (SELECT id, avg(app) AS neutral FROM yearly JOIN means USING (region, year) WHERE value >= -0.7 AND value < 0.5 GROUP BY id)"


@query(f"WITH {YEARLY}, {INDEX}, {MEANS}, {_CHOSEN}, {_NEUTRAL} SELECT event, id, region, round(app - neutral, 6) AS anomaly FROM yearly JOIN chosen USING (region, year) JOIN neutral USING (id)")
def event_anomaly(spark, d):
    y, means = yearly(spark, d), index_means(spark, d)
    return climate_index.event_anomalies(y, _chosen(spark, d), climate_index.neutral_means(y, means, "app"), "app").withColumn("anomaly", F.round("anomaly", 6))


@query(f"WITH {DAILY} SELECT CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS zone, round(avg(rain - tmin), 6) AS mean_difference, round(100 * (sum(rain) FILTER (tmin >= 5) / sum(tmin) FILTER (tmin >= 5) - 1), 6) AS percent FROM daily GROUP BY ALL")
def zone_anomaly(spark, d):
    rows = daily(spark, d).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("zone"), F.col("rain").alias("event_value"), F.col("tmin").alias("reference"))
    return climate_index.zone_anomalies(rows).withColumns({c: F.round(c, 6) for c in ("mean_difference", "percent")})


_PERMS = [[int(v) for v in row] for row in climate_index.block_permutations(6, 60, seed=3)]
_PERM_SQL = "perms AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {i}, {s})" for j, row in enumerate(_PERMS) for i, s in enumerate(row)) + ") t(perm, pos, src))"
_X = [1.0, -0.5, 2.25, 0.0, -1.5, 0.75]
_PSER = "series AS (SELECT id, year - 1995 AS pos, app AS y FROM yearly WHERE year BETWEEN 1995 AND 2000), full_ids AS (SELECT id FROM series GROUP BY id HAVING count(*) = 6), xs AS (SELECT pos, x - avg(x) OVER () AS xc FROM (VALUES " + ", ".join(f"({i}, {x}e0)" for i, x in enumerate(_X)) + ") t(pos, x))"
_PSLOPE = f"""{YEARLY}, {_PERM_SQL}, {_PSER}, yc AS (SELECT id, pos, y - avg(y) OVER (PARTITION BY id) AS yc FROM series SEMI JOIN full_ids USING (id)), ssx AS (SELECT sum(xc * xc) AS ssx FROM xs),
    own AS (SELECT id, sum(yc * xc) / any_value(ssx) AS slope FROM yc JOIN xs USING (pos), ssx GROUP BY id),
    moved AS (SELECT perm, perms.pos, xc FROM perms JOIN xs ON xs.pos = src), other AS (SELECT id, perm, abs(sum(yc * xc) / any_value(ssx)) AS b FROM yc JOIN moved USING (pos), ssx GROUP BY id, perm),
    pslope AS (SELECT id, slope, (count(*) FILTER (b >= abs(slope) - 1e-9) + 1) / (count(*) + 1.0e0) AS p FROM other JOIN own USING (id) GROUP BY id, slope)"""


def _perm_input(spark, d):
    rows = yearly(spark, d).where("year between 1995 and 2000").select("id", (F.col("year") - 1995).alias("pos"), F.col("app").alias("y"))
    whole = rows.groupBy("id").count().where("count = 6").select("id")
    return rows.join(whole, "id", "left_semi")


@query(f"WITH {_PSLOPE} SELECT id, round(slope, 6) AS slope, round(p, 6) AS p FROM pslope")
def permutation_slopes(spark, d):
    index = spark.createDataFrame(list(enumerate(_X)), "pos int, x double")
    perms = spark.createDataFrame([(j, i, s) for j, row in enumerate(_PERMS) for i, s in enumerate(row)], "perm int, pos int, src int")
    return climate_index.permutation_slopes_sql(_perm_input(spark, d), index, perms).select("id", F.round("slope", 6).alias("slope"), F.round("p", 6).alias("p"))


@query(f"WITH {_PSLOPE} SELECT id, round(p, 6) AS p FROM pslope")
def permutation_slopes_matrix(spark, d):
    import numpy as np

    packed = _perm_input(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("y").cast("double").alias("v")))), lambda x: x["v"]).alias("y")).withColumn("region", F.lit("all"))
    found = climate_index.permutation_slopes(packed, {"all": _X}, np.array(_PERMS))
    return climate_index.point_significance(found).select("id", F.round("p", 6).alias("p"))


@query("""WITH p AS (SELECT l_orderkey % 50 AS id, (sum(l_quantity) % 100) / 100.0e0 AS p FROM lineitem GROUP BY 1), h AS (SELECT l_partkey % 40 AS perm, count(*) % 50 AS hits FROM lineitem GROUP BY 1),
    s AS (SELECT avg(CASE WHEN p < 0.05 THEN 1.0e0 ELSE 0 END) AS share_local, count(*) AS n FROM p)
    SELECT any_value(share_local) AS share_local, any_value(n) AS n_points, round(quantile_cont(hits / CAST(n AS DOUBLE), 0.5), 9) AS null_share, avg(CASE WHEN hits / CAST(n AS DOUBLE) >= share_local - 1e-12 THEN 1.0e0 ELSE 0 END) AS field_p FROM h, s""")
def field_significance(spark, d):
    lines = table(spark, d, "lineitem")
    p = lines.groupBy((F.col("l_orderkey") % 50).alias("id")).agg(((F.sum("l_quantity") % 100) / 100.0).alias("p"))
    hits = lines.groupBy((F.col("l_partkey") % 40).alias("perm")).agg((F.count(F.lit(1)) % 50).alias("hits"))
    return climate_index.field_significance(p, hits).withColumn("null_share", F.round("null_share", 9))


@query("""SELECT o_custkey % 20 AS id, list_sort(list(CAST(floor(o_totalprice) AS BIGINT)))[CAST(ceil((count(*) - 1) * 0.95) AS INTEGER) + 1] AS q FROM orders GROUP BY 1""")
def higher_quantile(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("id"), F.floor("o_totalprice").alias("v"))
    return ranks.higher_quantile(rows, ["id"], "v", 0.95)


# ---- grids and rasters ---------------------------------------------------------------------------------------------

_GRID = grid.Grid(lat0=-0.5, lon0=-81.0, step=0.25, rows=64, cols=40)


@query(f"WITH {POINTS} SELECT id, CAST(round_even((-0.5 - lat) / 0.25, 0) AS INTEGER) AS row, CAST(round_even((lon + 81.0) / 0.25, 0) AS INTEGER) AS col, CAST(round_even((-0.5 - lat) / 0.25, 0) * 40 + round_even((lon + 81.0) / 0.25, 0) AS BIGINT) AS gid FROM points")
def grid_index(spark, d):
    return grid.nearest_nodes(points(spark, d), _GRID).select("id", "row", "col", "gid")


_CUBE = "cube AS (SELECT DATE '2001-01-01' + CAST(k AS INTEGER) AS date, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, CASE WHEN (i * 7 + j * 3 + k) % 11 = 0 THEN NULL ELSE ((i * 31 + j * 17 + k * 5) % 64) / 4.0e0 END AS value FROM range(0, 5) a(k), range(0, 64) b(i), range(0, 40) c(j))"


def _cube(spark):
    i, j, k = (F.col("id") / 40 % 64).cast("int"), (F.col("id") % 40).cast("int"), (F.col("id") / 2560).cast("int")
    rows = spark.range(5 * 64 * 40).select(i.alias("row"), j.alias("col"), k.alias("k"))
    v = F.when((F.col("row") * 7 + F.col("col") * 3 + F.col("k")) % 11 == 0, F.lit(float("nan"))).otherwise((F.col("row") * 31 + F.col("col") * 17 + F.col("k") * 5) % 64 / 4.0)
    return rows.select(F.date_add(F.lit("2001-01-01").cast("date"), F.col("k")).alias("date"), "row", "col", grid.clean(v).alias("value"))


@query(f"WITH {POINTS}, {_CUBE} SELECT id, date, value FROM points JOIN cube ON row = id % 64 AND col = id % 40")
def node_extract(spark, d):
    return grid.extract_nodes(_cube(spark), grid.nearest_nodes(points(spark, d), _GRID))


_SITES = "sites AS (SELECT s_suppkey AS id, -81.0e0 + (s_suppkey * 13 % 320) / 32.0e0 AS lon, -0.5e0 - (s_suppkey * 29 % 512) / 32.0e0 AS lat FROM supplier)"
_BILINEAR = f"""{_SITES}, {_CUBE}, f AS (SELECT id, (lon + 81.0e0) / 0.25e0 AS fx, (lat + 0.5e0) / -0.25e0 AS fy FROM sites),
    g AS (SELECT *, least(greatest(CAST(floor(fx) AS INTEGER), 0), 38) AS j, least(greatest(CAST(floor(fy) AS INTEGER), 0), 62) AS i FROM f), w AS (SELECT *, least(greatest(fx - j, 0), 1) AS wx, least(greatest(fy - i, 0), 1) AS wy FROM g),
    corner AS (SELECT id, i + di AS row, j + dj AS col, (CASE di WHEN 1 THEN wy ELSE 1 - wy END) * (CASE dj WHEN 1 THEN wx ELSE 1 - wx END) AS weight FROM w, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(di, dj))"""


def _corners(spark, d):
    k = F.col("s_suppkey")
    sites = table(spark, d, "supplier").select(k.alias("id"), (-81.0 + (k * 13 % 320) / 32.0).alias("lon"), (-0.5 - (k * 29 % 512) / 32.0).alias("lat"))
    return grid.bilinear_corners(sites, -81.0, -0.5, 0.25, -0.25, 40, 64)


@query(f"WITH {_BILINEAR} SELECT id, date, round(sum(weight * value) / sum(weight) FILTER (value IS NOT NULL), 9) AS value FROM corner JOIN cube USING (row, col) WHERE weight > 0 GROUP BY id, date")
def bilinear_renormalize(spark, d):
    return grid.bilinear(_cube(spark), _corners(spark, d)).withColumn("value", F.round("value", 9))


@query(f"WITH {_BILINEAR} SELECT id, date, CASE WHEN count(*) = count(value) THEN round(sum(weight * value) / sum(weight), 9) END AS value FROM corner JOIN cube USING (row, col) WHERE weight > 0 GROUP BY id, date")
def bilinear_propagate(spark, d):
    return grid.bilinear(_cube(spark), _corners(spark, d), "propagate").withColumn("value", F.round("value", 9))


@query("SELECT s_suppkey AS id, DATE '2000-01-01' + CAST(k AS INTEGER) AS date, ((s_suppkey * 3 * 7 + k * 5) % 100) / 4.0e0 AS value FROM supplier, range(0, 10) t(k) WHERE s_suppkey % 2 = 0")
def bucket_remap(spark, d):
    suppliers = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("gid"))
    day = suppliers.select("gid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("day"))
    predictions = day.select(F.pmod("gid", F.lit(4)).cast("int").alias("id_bucket"), "gid", "day", ((F.col("gid") * 7 + F.col("day") * 5) % 100 / 4.0).alias("pred"))
    mapping = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("gid"))
    return grid.predictions_to_daily(predictions, mapping, "2000-01-01", 10, 4)


_GEO = f"{POINTS}, geo AS (SELECT min(lon) - 0.125 AS west, max(lat) + 0.125 AS north FROM points), px AS (SELECT p.*, CAST(trunc((lon - west) / 0.25) AS INTEGER) AS x_idx, CAST(trunc((north - lat) / 0.25) AS INTEGER) AS y_idx FROM points p, geo)"


@query(f"WITH {DAILY}, {_GEO} SELECT y_idx, x_idx, max(CAST(n AS INTEGER)) AS value FROM daily JOIN px USING (id) GROUP BY y_idx, x_idx, id")
def raster_pixels(spark, d):
    p = points(spark, d)
    return raster.rasterize(daily(spark, d).select("id", F.col("n").cast("int").alias("n")), p, raster.geometry(p), "n", "max")


@query("SELECT region, count(*) AS n_pixels FROM (SELECT 'highland' AS region, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'lowland', s_suppkey FROM supplier WHERE s_suppkey % 3 = 1) GROUP BY region")
def region_pixels(spark, d):
    return raster.region_pixels(_regional(spark, d))


def _regional(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.when(k % 3 == 0, "highland").when(k % 3 == 1, "lowland").otherwise("midland").alias("region"), (k / 40).cast("int").alias("y_idx"), (k % 40).cast("int").alias("x_idx"), F.when(k % 3 == 2, F.lit(raster.NODATA)).otherwise(k).cast("int").alias("value"))


@query("SELECT CAST(s_suppkey // 40 AS INTEGER) AS y_idx, CAST(s_suppkey % 40 AS INTEGER) AS x_idx, CAST(s_suppkey AS INTEGER) AS value FROM supplier WHERE s_suppkey % 3 <> 2")
def region_merge(spark, d):
    return raster.merge_regions(_regional(spark, d))


@query("SELECT year(l_shipdate) AS year, CAST(l_suppkey // 40 AS INTEGER) AS y_idx, CAST(l_suppkey % 40 AS INTEGER) AS x_idx, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY ALL")
def all_lands_sum(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("region"), (F.col("l_suppkey") / 40).cast("int").alias("y_idx"), (F.col("l_suppkey") % 40).cast("int").alias("x_idx")).agg(F.sum("l_linenumber").alias("value"))
    return raster.sum_regions(rows)


@query("SELECT CAST(y // 10 AS INTEGER) AS block_y, CAST(x // 10 AS INTEGER) AS block_x, round(avg(CASE WHEN p < 0.05 THEN 1.0e0 ELSE 0 END), 9) AS share FROM (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, (p_partkey * 7 % 13) / 150.0e0 AS p FROM part) GROUP BY ALL HAVING avg(CASE WHEN p < 0.05 THEN 1.0e0 ELSE 0 END) >= 0.5")
def stipple_blocks(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k / 40).cast("int").alias("y_idx"), (k % 40).cast("int").alias("x_idx"), (k * 7 % 13 / 150.0).alias("p"))
    return raster.significant_blocks(rows).withColumn("share", F.round("share", 9))


@query("""WITH v AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0), q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v), r AS (SELECT lo, greatest(hi - lo, 1e-9) / 6 AS raw FROM q),
    u AS (SELECT lo, raw, pow(10, floor(log10(raw))) AS unit FROM r), s AS (SELECT lo, CASE WHEN unit >= raw - 1e-12 THEN unit WHEN 2 * unit >= raw - 1e-12 THEN 2 * unit WHEN 2.5 * unit >= raw - 1e-12 THEN 2.5 * unit WHEN 5 * unit >= raw - 1e-12 THEN 5 * unit ELSE 10 * unit END AS step FROM u)
    SELECT CAST(least(5, greatest(0, floor(v / step) - floor(lo / step))) AS INTEGER) AS class, count(*) AS n FROM v, s GROUP BY ALL""")
def class_breaks(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 0")
    found = classes.magnitude(orders, "o_totalprice", method="linear")
    return orders.groupBy(found.of(F.col("o_totalprice")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _quantile_sql(k: int, where: str) -> str:
    cuts = ", ".join(f"quantile_cont(v, (1 + 98e0 * {i} / {k}) / 100)" for i in range(1, k))
    return f"cuts AS (SELECT unnest([{cuts}]) AS c FROM v {where}), grains AS (SELECT c, 5 * pow(10, floor(log10(c)) - 1) AS g FROM cuts WHERE c > 0), breaks AS (SELECT DISTINCT round_even(c / g, 0) * g AS b FROM grains)"


@query(f"WITH v AS (SELECT pow(o_totalprice / 100000e0, 3e0) * 0.37e0 AS v FROM orders), {_quantile_sql(6, '')} SELECT (SELECT count(*) FROM breaks WHERE b <= v) AS class, count(*) AS n FROM v GROUP BY ALL")
def class_breaks_quantile(spark, d):
    rows = table(spark, d, "orders").select((F.pow(F.col("o_totalprice") / 100000.0, F.lit(3.0)) * 0.37).alias("v"))
    found = classes.magnitude(rows, "v", method="quantile")
    return rows.groupBy(found.of(F.col("v")).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH v AS (SELECT CAST(CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_partkey * l_linenumber END AS DOUBLE) AS v FROM lineitem), {_quantile_sql(5, 'WHERE v > 0')}, limits AS (SELECT 0.5e0 AS b UNION ALL SELECT DISTINCT greatest(1, round_even(b, 0)) FROM breaks) SELECT (SELECT count(*) FROM limits WHERE b <= v) AS class, count(*) AS n FROM v GROUP BY ALL")
def class_breaks_zero(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") <= 2, 0.0).otherwise(F.col("l_partkey") * F.col("l_linenumber").cast("double")).alias("v"))
    found = classes.magnitude(rows, "v", method="quantile")
    return rows.groupBy(found.of(F.col("v")).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT CAST(l_quantity AS DOUBLE) * 1.75e0 - l_linenumber * 9e0 AS v FROM lineitem), a AS (SELECT quantile_cont(abs(v), 0.98) / 3.5e0 AS raw FROM v), u AS (SELECT raw, pow(10, floor(log10(raw))) AS unit FROM a),
    s AS (SELECT CASE WHEN unit >= raw - 1e-12 THEN unit WHEN 2 * unit >= raw - 1e-12 THEN 2 * unit WHEN 2.5e0 * unit >= raw - 1e-12 THEN 2.5e0 * unit WHEN 5 * unit >= raw - 1e-12 THEN 5 * unit ELSE 10 * unit END AS step FROM u),
    limits AS (SELECT k * step AS b FROM s, (VALUES (-3e0), (-2e0), (-1e0), (-0.5e0), (0.5e0), (1e0), (2e0), (3e0)) t(k)) SELECT (SELECT count(*) FROM limits WHERE b <= v) AS class, count(*) AS n FROM v GROUP BY ALL""")
def class_breaks_diverging(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") * 1.75 - F.col("l_linenumber") * 9.0).alias("v"))
    found = classes.around_zero(rows, "v")
    return rows.groupBy(found.of(F.col("v")).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---- catalogue -----------------------------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, a AS (SELECT id, date, q, n FROM daily WHERE n % 5 <> 0), b AS (SELECT id, date, q + CASE WHEN n % 9 = 0 THEN 2 ELSE 0 END AS q, n + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS n FROM daily WHERE n % 7 <> 0),
    j AS (SELECT coalesce(a.id, b.id) AS id, a.q AS aq, b.q AS bq, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.id = b.id AND a.date = b.date), t AS (SELECT count(*) FILTER (x <> y) AS n_ids_changed FROM (SELECT id, max(an) AS x, max(bn) AS y FROM j GROUP BY id))
    SELECT count(*) FILTER (aq IS NOT NULL AND bq IS NOT NULL) AS n_common, count(*) FILTER (bq IS NULL) AS n_only_old, count(*) FILTER (aq IS NULL) AS n_only_new, CAST(max(abs(aq - bq)) AS DOUBLE) AS max_diff_q, CAST(max(abs(an - bn)) AS DOUBLE) AS max_diff_n, any_value(n_ids_changed) AS n_ids_changed FROM j, t""")
def tree_diff(spark, d):
    # tables of both sides and of their comparison lie in one task; shuffled bytes say little of their size
    parts = max(DIFF_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = star.daily_of(table(spark, d, "lineitem"), parts).select("id", "date", "q", "n")
    new = rows.where("n % 7 <> 0").select("id", "date", (F.col("q") + F.when(F.col("n") % 9 == 0, 2).otherwise(0)).alias("q"), (F.col("n") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("n"))
    return catalog.compare_runs(rows.where("n % 5 <> 0"), new, ["q", "n"], count="n")


@query("SELECT CAST(l_orderkey AS BIGINT) AS id, l_linenumber AS line, name AS date, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS d1, l_extendedprice AS d2 FROM lineitem) UNPIVOT (value FOR name IN (d1, d2))")
def unpivot_daily(spark, d):
    wide = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("d1"), F.col("l_extendedprice").alias("d2"))
    return catalog.melt(wide, ["id", "line"], ["d1", "d2"])


@query("SELECT variable, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT l_returnflag AS variable, l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_returnflag, l_linenumber + 1 FROM lineitem WHERE l_returnflag = 'R') GROUP BY variable")
def two_roots(spark, d):
    first = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("k"))
    return catalog.two_roots(first, first.withColumn("k", F.col("k") + 1), ["R"]).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query(f"WITH {DAILY} SELECT CAST(id AS INTEGER) AS id, date, CAST(rain AS FLOAT) AS value FROM daily WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'")
def month_relayout(spark, d):
    rows = daily(spark, d).where(F.col("date").between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date"))).select("id", F.col("date").cast("timestamp").alias("date"), F.col("rain").alias("value"))
    return catalog.relayout(rows, points(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT s_suppkey AS id FROM supplier LIMIT 7)")  # the limit is the feature
def sampled_ids(spark, d):
    return catalog.sample_ids(points(spark, d), 7, seed=5).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
