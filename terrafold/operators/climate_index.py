"""A monthly climate index against seasonal results: season means, categories, regressions and their significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.checks import none_where
from terrafold.operators.season import SEASON_MONTHS

# Index categories, half-open from the lower limit.
CATEGORIES = ((-0.7, "fría"), (0.5, "neutra"), (1.3, "cálida débil"), (2.1, "cálida moderada"), (3.5, "cálida fuerte"), (None, "cálida extraordinaria"))
# Zones by latitude, half-open from the lower limit.
ZONES = ((-90.0, -15.0, "Sur"), (-15.0, -9.0, "Centro"), (-9.0, 90.0, "Norte"))


def category(value: Column) -> Column:
    """A missing value counts as neutral."""
    out = F.when(value.isNull() | F.isnan(value), "neutra")
    for limit, name in CATEGORIES:
        out = out.otherwise(name) if limit is None else out.when(value < limit, name)
    return out


def zone(lat: Column) -> Column:
    out = None
    for low, high, name in ZONES:
        inside = (lat >= low) & (lat < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def season_label(region: Column, year: Column) -> Column:
    return F.when(region == "highland", F.format_string("%d/%02d", year, F.pmod(year + 1, F.lit(100)))).otherwise(year.cast("string"))


def season_means(monthly: DataFrame, years: DataFrame, strict: bool = True) -> DataFrame:
    """(region, year, value): mean of the index over each region's season months. Months without a value: an error, or
    with strict off the season is left out."""
    months = None
    for region, (a, b) in SEASON_MONTHS.items():
        part = years.select(F.lit(region).alias("region"), F.col("year"), F.explode(F.sequence(F.lit(a), F.lit(b))).alias("k"))
        months = part if months is None else months.unionByName(part)
    asked = months.select("region", "year", (F.col("year") + F.floor(F.col("k") / 12)).cast("int").alias("y"), (F.col("k") % 12 + 1).cast("int").alias("m"))
    index = monthly.select(F.col("year").alias("y"), F.col("month").alias("m"), "value")
    found = asked.join(index, ["y", "m"], "left")
    if strict:
        none_where(found, F.col("value").isNull(), "the index has no value for")
    return found.groupBy("region", "year").agg(F.avg("value").alias("value"), F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0").drop("gaps")


def event_seasons(means: DataFrame, events: DataFrame, warm: float = 0.5) -> DataFrame:
    """(event, region, year, value): of each event's years the warmest season of a region; of equals the first year.
    Seasons that are not above `warm` give NULL."""
    rows = events.join(means, "year")
    best = rows.groupBy("event", "region").agg(F.max_by(F.struct("year", "value"), F.struct("value", -F.col("year"))).alias("b"))
    return best.select("event", "region", F.when(F.col("b.value") > warm, F.col("b.year")).alias("year"), F.when(F.col("b.value") > warm, F.col("b.value")).alias("value"))


def block_permutations(n: int, count: int, block: int = 2, seed: int = 0) -> np.ndarray:
    """count permutations of 0..n-1 that keep blocks of neighbours together; where blocks begin is drawn too.

    All at once: every block of every permutation draws a key, and positions are sorted by their block's key; a stable
    sort keeps the order inside a block."""
    rng = np.random.default_rng(seed)
    short = rng.integers(0, block, (count, 1))  # the first block's length, 0: a whole one
    number = (np.arange(n) + (block - short) % block) // block
    keys = rng.random((count, -(-n // block) + 1))
    return np.argsort(np.take_along_axis(keys, number, axis=1), axis=1, kind="stable")


def series_of(yearly: DataFrame, metric: str, years: list[int]) -> DataFrame:
    """(id, region, y): each point's values in the order of years; a point-year that is missing stops the run."""
    rows = yearly.where(F.col("year").isin(years)).dropDuplicates(["id", "year"])
    packed = rows.groupBy("id", "region").agg(F.array_sort(F.collect_list(F.struct("year", F.col(metric).cast("double").alias("v")))).alias("s"))
    none_where(packed, (F.size("s") != len(years)) | F.exists("s", lambda x: x["v"].isNull() | F.isnan(x["v"])), f"missing point-years for {metric}")
    return packed.select("id", "region", F.transform("s", lambda x: x["v"]).alias("y"))


class _Null:
    """What slopes on one index are under permutation: the centred index, as it is and in every permuted order."""

    def __init__(self, x: list[float], perms: np.ndarray):
        centred = np.asarray(x, dtype=np.float64) - np.mean(x)
        self.weights = np.column_stack([centred, centred[perms].T]) / (centred @ centred)

    def judge(self, y: np.ndarray, alpha: float) -> tuple[pd.DataFrame, np.ndarray]:
        """y: (points, years). slope, p, flat and sd of each point; and per permutation how many points it makes significant.

        Sizes of the permuted slopes are sorted once a point: p is where the observed one would stand, and a permuted one
        counts from the value at the next rank above 1 - alpha on. Ties, to 1e-9, count as reached."""
        slopes = (y - y.mean(axis=1, keepdims=True)) @ self.weights
        sizes = np.abs(slopes[:, 1:])
        order = np.sort(sizes, axis=1)
        n = order.shape[1]
        reached = n - (order < np.abs(slopes[:, :1]) - 1e-9).sum(axis=1)
        limit = order[:, [int(np.ceil((n - 1) * (1 - alpha)))]]
        hits = ((sizes >= limit - 1e-9) & (order[:, -1:] > 1e-9)).sum(axis=0)
        spread = np.ptp(y, axis=1) == 0
        return pd.DataFrame({"slope": slopes[:, 0], "p": (reached + 1) / (n + 1), "flat": spread, "sd": y.std(axis=1, ddof=1)}), hits


def permutation_slopes(series: DataFrame, index: dict[str, list[float]], perms: np.ndarray, local_alpha: float = 0.05, block: int = 2000) -> DataFrame:
    """series: id, region, y. Slope on the region's index and its permutation p, per point; and, as rows with id NULL,
    how many points each permutation makes locally significant (hits, one vector per task and region).

    The permuted index is one matrix (years x permutations) per region, sent once; points stream through it `block` at a
    time. Double precision throughout, so that ties with the observed slope count the same everywhere."""
    shared = series.sparkSession.sparkContext.broadcast({region: _Null(x, perms) for region, x in index.items()})
    columns = ["id", "region", "slope", "p", "flat", "sd", "hits"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, np.ndarray] = {}
        for batch in batches:
            for (region, _), rows in batch.groupby([batch["region"], np.arange(len(batch)) // block]):
                found, hits = shared.value[region].judge(np.stack(rows["y"].to_list()), local_alpha)
                counters[region] = counters.get(region, 0) + hits
                yield found.assign(id=rows["id"].to_numpy(), region=region, hits=None)[columns]
        if counters:
            yield pd.DataFrame({"region": list(counters), "hits": [h.tolist() for h in counters.values()]}).reindex(columns=columns)

    return series.mapInPandas(run, "id long, region string, slope double, p double, flat boolean, sd double, hits array<long>")


def point_significance(found: DataFrame, sd_floor: float = 0.5) -> DataFrame:
    """(id, region, slope, p, slope_sd): points that never change get p 1; slopes in units of their standard deviation."""
    rows = found.where("hits is null")
    return rows.select("id", "region", "slope", F.when(F.col("flat"), 1.0).otherwise(F.col("p")).alias("p"), (F.col("slope") / F.greatest("sd", F.lit(sd_floor))).alias("slope_sd"))


def field_significance(points: DataFrame, hits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: share of locally significant points, the median of that share under permutation, and the field p.

    hits: perm, hits (points that the permutation makes significant)."""
    share = points.agg(F.avg((F.col("p") < alpha).cast("double")).alias("share_local"), F.count(F.lit(1)).alias("n_points"))
    null = hits.groupBy("perm").agg(F.sum("hits").alias("hits")).join(F.broadcast(share), how="cross")  # one row
    return null.groupBy("share_local", "n_points").agg(
        F.percentile(F.col("hits") / F.col("n_points"), 0.5).alias("null_share"),
        F.avg((F.col("hits") / F.col("n_points") >= F.col("share_local") - 1e-12).cast("double")).alias("field_p"),
    )


def hits_of(found: DataFrame) -> DataFrame:
    """(perm, hits) from the vectors of permutation_slopes."""
    return found.where("hits is not null").select(F.posexplode("hits").alias("perm", "hits")).groupBy("perm").agg(F.sum("hits").alias("hits"))


def permutation_slopes_sql(series: DataFrame, index: DataFrame, perms: DataFrame) -> DataFrame:
    """The slopes and p by joins, for small tables: series id, pos, y; index pos, x; perms perm, pos, src."""
    w = Window.partitionBy("id")
    y = series.withColumn("yc", F.col("y") - F.avg("y").over(w))
    mean = index.agg(F.avg("x").alias("mx"))
    x = index.join(F.broadcast(mean), how="cross").select("pos", (F.col("x") - F.col("mx")).alias("xc"))
    ssx = x.agg(F.sum(F.col("xc") * F.col("xc")).alias("ssx"))
    own = y.join(F.broadcast(x), "pos").groupBy("id").agg(F.sum(F.col("yc") * F.col("xc")).alias("sxy")).join(F.broadcast(ssx), how="cross")
    own = own.select("id", "ssx", F.try_divide("sxy", "ssx").alias("slope"))
    moved = perms.join(x.withColumnRenamed("pos", "src"), "src").select("perm", "pos", "xc")
    other = y.join(F.broadcast(moved), "pos").groupBy("id", "perm").agg(F.sum(F.col("yc") * F.col("xc")).alias("sxy"))
    both = other.join(own, "id").withColumn("b", F.abs(F.try_divide("sxy", "ssx")))
    return both.groupBy("id", "slope").agg(((F.count_if(F.col("b") >= F.abs("slope") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def unit_table(yearly: DataFrame, points: DataFrame, means: DataFrame, metric: str) -> DataFrame:
    """Per unit (region and zone) and year: mean of the metric, its anomaly from the unit's mean over all years, also in
    percent (NULL for a mean of 0), with the season's index, category and label."""
    rows = yearly.join(points.select("id", zone(F.col("lat")).alias("zone")), "id")
    unit = rows.groupBy("region", "zone", "year").agg(F.avg(metric).alias("unit_mean"), F.count_distinct("id").alias("n_points"))
    mean = F.avg("unit_mean").over(Window.partitionBy("region", "zone"))
    out = unit.withColumn("_m", mean).join(means.withColumnRenamed("value", "index_value"), ["region", "year"], "left")
    anomaly = F.col("unit_mean") - F.col("_m")
    return out.select("region", "zone", "year", season_label(F.col("region"), F.col("year")).alias("season"), "index_value", category(F.col("index_value")).alias("category"), "unit_mean", anomaly.alias("anomaly"), F.when(F.col("_m") != 0, F.try_divide(100 * anomaly, F.col("_m"))).alias("anomaly_pct"), "n_points")


def unit_regressions(table: DataFrame) -> DataFrame:
    """Per unit: slope of its mean on the index, in percent of the mean too, and correlation (0 for a constant unit)."""
    x, y = F.col("index_value"), F.col("unit_mean")
    sums = table.where(x.isNotNull()).groupBy("region", "zone").agg(F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(y).alias("mean"), F.count(y).alias("n_years"))
    slope = F.try_divide("sxy", "sxx")
    return sums.select("region", "zone", slope.alias("slope"), F.when(F.col("mean") != 0, F.try_divide(100 * slope, F.col("mean"))).alias("slope_pct"), F.when(F.col("syy") > 0, F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))).otherwise(0.0).alias("r"), "mean", "n_years")


def unit_significance(table: DataFrame, index: dict[str, list[float]], years: list[int], perms: np.ndarray) -> DataFrame:
    """unit_regressions of the units that have every year, with p: the permutation p of the unit's slope on its region's
    index (1 for a constant unit)."""
    rows = table.where(F.col("year").isin(years) & F.col("unit_mean").isNotNull())
    packed = rows.groupBy("region", "zone").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "unit_mean"))), lambda x: x["unit_mean"]).alias("y")).where(F.size("y") == len(years))
    # units are regions times zones; a number stands for the zone while slopes are worked out
    units = packed.withColumn("id", F.xxhash64("region", "zone"))
    found = point_significance(permutation_slopes(units, index, perms)).select("id", "p")
    return unit_regressions(rows).join(units.select("region", "zone", "id"), ["region", "zone"]).join(found, "id").drop("id")


def neutral_means(yearly: DataFrame, means: DataFrame, metric: str, low: float = -0.7, high: float = 0.5) -> DataFrame:
    """(id, neutral): each point's mean over seasons whose index is neutral."""
    near = means.where((F.col("value") >= low) & (F.col("value") < high)).select("region", "year")
    return yearly.join(F.broadcast(near), ["region", "year"]).groupBy("id").agg(F.avg(metric).alias("neutral"))


def event_anomalies(yearly: DataFrame, chosen: DataFrame, neutral: DataFrame, metric: str) -> DataFrame:
    """(event, id, anomaly): value of the event's season minus the point's neutral mean."""
    rows = yearly.join(F.broadcast(chosen.where("year is not null").select("event", "region", "year")), ["region", "year"])
    return rows.join(neutral, "id").select("event", "id", "region", (F.col(metric) - F.col("neutral")).alias("anomaly"))


def zone_anomalies(values: DataFrame, least: float = 5.0) -> DataFrame:
    """values: zone, event_value, reference. Mean difference (missing left out) and, over points whose reference is at
    least `least`, the ratio of sums in percent."""
    e, r = F.col("event_value"), F.col("reference")
    return values.groupBy("zone").agg(F.avg(e - r).alias("mean_difference"), (100 * (F.try_divide(F.sum(F.when(r >= least, e)), F.sum(F.when(r >= least, r))) - 1)).alias("percent"))


def years_frame(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
