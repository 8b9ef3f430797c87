"""Linear trends per point over years."""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import student

#: Degrees of freedom whose critical values are listed; beyond, an expansion about the normal one is exact to 1e-9.
LISTED = 150
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@lru_cache(maxsize=8)
def _criticals(alpha: float) -> dict[int, float]:
    return {d: student.critical(d, alpha) for d in range(1, LISTED + 1)}


def _critical(dof: Column, alpha: float) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = F.lit(z)
    for k, c in enumerate(terms, 1):
        far = far + F.lit(c) / F.pow(dof.cast("double"), F.lit(float(k)))
    listed = F.create_map(*[x for d, t in _criticals(alpha).items() for x in (F.lit(d), F.lit(t))])
    return F.when(dof <= LISTED, listed[dof]).otherwise(far)


def _moments(metric: str, whole: bool) -> list[Column]:
    """n, the span, and n times the centred sums of x y (a), x x (b) and y y (c).

    Whole numbers are summed as they are and combined exactly, so that each statistic is rounded in its last step only;
    others through the regression aggregates, which centre as they go."""
    if whole:
        y = F.col(metric).cast("decimal(19,0)")
        x = F.when(y.isNotNull(), F.col("year").cast("decimal(5,0)") - 2000)
        n = F.count(y)
        exact = lambda p, q: (n.cast("decimal(10,0)") * F.sum(p * q) - F.sum(p) * F.sum(q)).cast("double")
        a, b, c = exact(x, y), exact(x, x), exact(y, y)
    else:
        y = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
        x = F.when(y.isNotNull(), F.col("year").cast("double"))
        n = F.count(y)
        a, b, c = n * F.regr_sxy(y, x), n * F.regr_sxx(y, x), n * F.regr_syy(y, x)
    return [n.alias(f"n_{metric}"), (F.max(y) - F.min(y)).alias(f"span_{metric}"), a.alias(f"a_{metric}"), b.alias(f"b_{metric}"), c.alias(f"c_{metric}")]


def ols(yearly: DataFrame, metrics: tuple[str, ...], min_years: int = 10, years: tuple[int, int] | None = None, alpha: float = 0.05) -> DataFrame:
    """metric ~ year for every id, all metrics in one pass: slope, p_value, std_err, conf_int_lower, conf_int_upper,
    r_squared and n_years of each, named <statistic>_<metric>.

    Fewer than max(min_years, 3) values, or all in one year: statistics are NULL. A metric that never changes: slope,
    error and interval 0, p 1, r_squared NULL."""
    rows = yearly if years is None else yearly.where(F.col("year").between(*years))
    kinds = dict(rows.dtypes)
    out = rows.groupBy("id").agg(*[c for m in metrics for c in _moments(m, kinds[m] in _WHOLE)])
    for m in metrics:
        n, span, a, b, c = (F.col(f"{k}_{m}") for k in ("n", "span", "a", "b", "c"))
        fine, flat = (n >= max(min_years, 3)) & (b > 0), span == 0
        error = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), b * c - a * a), b * b * (n - 2)))
        out = out.withColumns({
            f"slope_{m}": F.when(fine, F.when(flat, 0.0).otherwise(F.try_divide(a, b))),
            f"std_err_{m}": F.when(fine, F.when(flat, 0.0).otherwise(error)),
            f"r_squared_{m}": F.when(fine & ~flat, F.least(F.lit(1.0), F.try_divide(a * a, b * c))),
        })
    for m in metrics:
        n, slope, error = F.col(f"n_{m}"), F.col(f"slope_{m}"), F.col(f"std_err_{m}")
        dof = (n - 2).cast("int")
        half = _critical(dof, alpha) * error
        p = F.when(F.col(f"span_{m}") == 0, 1.0).when(error == 0, 0.0).otherwise(student.two_sided(slope / error, dof))
        out = out.withColumns({f"p_value_{m}": F.when(slope.isNotNull(), p), f"conf_int_lower_{m}": slope - half, f"conf_int_upper_{m}": slope + half, f"n_years_{m}": n.cast("int")})
    names = ("slope", "p_value", "std_err", "conf_int_lower", "conf_int_upper", "r_squared", "n_years")
    return out.select("id", *[f"{k}_{m}" for m in metrics for k in names])


def on_grid(points: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each point, fitted or not."""
    return points.select("id").join(stats, "id", "left")


def significance(p: Column, slope: Column, threshold: float = 0.05) -> Column:
    """0 no data (and a significant slope of exactly 0), 1 not significant, 2 rising, 3 falling."""
    return F.when(p >= threshold, 1).when((p < threshold) & (slope > 0), 2).when((p < threshold) & (slope < 0), 3).otherwise(0)


def class_shares(rows: DataFrame, column: str = "trend_class") -> DataFrame:
    """Number of points of each class, and its share of those with data in percent (NULL for class 0)."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_points"))
    valid = F.sum(F.when(F.col(column) > 0, F.col("n_points"))).over(Window.partitionBy())  # four rows
    return counts.withColumn("share", F.when(F.col(column) > 0, F.try_divide(100.0 * F.col("n_points"), valid)))


def per_decade(stats: DataFrame, metric: str, threshold: float = 0.05) -> DataFrame:
    """Slope per ten years of the points whose trend is significant."""
    return stats.where(F.col(f"p_value_{metric}") < threshold).select("id", (F.col(f"slope_{metric}") * 10).alias("slope_decade"))
