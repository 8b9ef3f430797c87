"""Student's t without a statistics library: two-sided p as a column, critical values on the driver.

For whole degrees of freedom the distribution is a finite trigonometric sum (Abramowitz and Stegun 26.7.3 and 26.7.4)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|)."""
    angle = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    s, c2 = F.sin(angle), F.pow(F.cos(angle), F.lit(2.0))
    odd = dof % 2 == 1
    terms = F.floor(F.when(odd, (dof - 1) / 2).otherwise(dof / 2)).cast("int")
    # each term is the one before times c2 * (2k-1)/(2k), for odd degrees c2 * 2k/(2k+1)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, k: Column) -> Column:
        kk = k.cast("double")
        nxt = a["term"] * c2 * F.when(odd, 2 * kk / (2 * kk + 1)).otherwise((2 * kk - 1) / (2 * kk))
        return F.struct((a["sum"] + a["term"]).alias("sum"), nxt.alias("term"))

    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, add)["sum"]).otherwise(0.0)
    inside = F.when(odd, (angle + s * F.cos(angle) * total) * (2 / math.pi)).otherwise(s * total)
    return F.greatest(F.lit(0.0), 1.0 - inside)


def _inside(t: float, dof: int) -> float:
    angle = math.atan(t / math.sqrt(dof))
    c, s = math.cos(angle), math.sin(angle)
    total, term = 0.0, 1.0
    for k in range(1, (dof - 1 if dof % 2 else dof) // 2 + 1):
        total += term
        term *= c * c * ((2 * k) / (2 * k + 1) if dof % 2 else (2 * k - 1) / (2 * k))
    return (angle + s * c * total) * 2 / math.pi if dof % 2 else s * total


def critical(dof: int, alpha: float = 0.05) -> float:
    """The t that |T| exceeds with probability alpha."""
    low, high = 0.0, 1.0
    while _inside(high, dof) < 1 - alpha:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _inside(mid, dof) < 1 - alpha else (low, mid)
    return (low + high) / 2
