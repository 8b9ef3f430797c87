"""Sunrise and sunset in decimal hours of a fixed-offset clock, as column expressions.

The public NOAA solar calculator: Julian century at noon, declination, equation of time, hour angle at the official
zenith. Polar days and nights give NULL. Expressions depend on (date, latitude, longitude) only: callers that have
many points per date compute `day_terms` on the distinct dates and join them.
"""

from __future__ import annotations

import datetime
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZENITH = 90.833


def _poly(t: Column, *c: float) -> Column:
    out = F.lit(c[-1])
    for a in reversed(c[:-1]):
        out = F.lit(a) + t * out
    return out


def day_terms(date: Column) -> dict[str, Column]:
    """declination (degrees) and equation_of_time (minutes) of a date."""
    t = (F.unix_date(date) + F.lit(2440588.0) - 2451545.0) / 36525.0
    # Polynomial coefficients of the public algorithm.
    mean_long = _poly(t, 280.46646, 36000.76983, 0.0003032) % 360.0
    anomaly = _poly(t, 357.52911, 35999.05029, -0.0001537)
    ecc = _poly(t, 0.016708634, -0.000042037, -0.0000001267)
    node = F.radians(_poly(t, 125.04, -1934.136))
    obliquity = F.radians(_poly(t, 23.0 + 26.0 / 60 + 21.448 / 3600, -46.815 / 3600, -0.00059 / 3600, 0.001813 / 3600) + 0.00256 * F.cos(node))
    m, l0 = F.radians(anomaly), F.radians(mean_long)
    centre = F.sin(m) * _poly(t, 1.914602, -0.004817, -0.000014) + F.sin(2 * m) * _poly(t, 0.019993, -0.000101) + F.sin(3 * m) * 0.000289
    apparent = F.radians(mean_long + centre - 0.00569 - 0.00478 * F.sin(node))
    y = F.pow(F.tan(obliquity / 2), F.lit(2.0))
    minutes = y * F.sin(2 * l0) - 2 * ecc * F.sin(m) + 4 * ecc * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * ecc * ecc * F.sin(2 * m)
    return {"declination": F.degrees(F.asin(F.sin(obliquity) * F.sin(apparent))), "equation_of_time": 4 * F.degrees(minutes)}


def sun_hours(lat: Column, lon: Column, declination: Column, equation_of_time: Column, offset: float = -5.0, zenith: float = ZENITH) -> tuple[Column, Column]:
    """(sunrise, sunset) for the terms of a day."""
    d, p = F.radians(declination), F.radians(lat)
    cosine = F.cos(F.radians(F.lit(zenith))) / (F.cos(p) * F.cos(d)) - F.tan(p) * F.tan(d)
    angle = F.degrees(F.acos(F.when(F.abs(cosine) <= 1, cosine)))
    noon = 720.0 - 4.0 * lon - equation_of_time + offset * 60.0
    return (noon - 4 * angle) / 60.0, (noon + 4 * angle) / 60.0


def standard_offset(zone: str) -> float:
    """Offset in hours of a time zone outside daylight saving, as of January 2000."""
    at = datetime.datetime(2000, 1, 15, 12, tzinfo=zoneinfo.ZoneInfo(zone)).utcoffset()
    if at is None:
        raise ValueError(f"no offset known for {zone!r}")
    return at.total_seconds() / 3600
