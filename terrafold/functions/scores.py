"""Daily scores from decision tables, as CASE expressions that Spark compiles.

A table row is a list of (limit, score): the first limit that is not exceeded decides, else the last score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("s", "ms", "mr", "r", "hr")

# Humid hours to blight units, by temperature band (low, high]; the last score is for longer wetness.
# Classes mr, r and hr share one column.
BLIGHT = (
    ((22.5, 27.0), {"s": ((6, 0), (9, 1), (12, 2), (15, 3), (18, 4), (None, 5)), "ms": ((9, 0), (18, 1), (None, 2)), "r": ((15, 0), (None, 1))}),
    ((12.5, 22.5), {"s": ((6, 0), (9, 5), (12, 6), (None, 7)), "ms": ((6, 0), (7, 1), (8, 2), (9, 3), (10, 4), (12, 5), (None, 6)), "r": ((6, 0), (7, 1), (8, 2), (9, 3), (12, 4), (None, 5))}),
    ((7.5, 12.5), {"s": ((6, 0), (7, 1), (9, 2), (10, 3), (12, 4), (15, 5), (24, 6), (None, 0)), "ms": ((6, 0), (9, 1), (12, 2), (15, 3), (18, 4), (None, 5)), "r": ((9, 0), (12, 1), (15, 2), (None, 3))}),
    ((3.0, 7.5), {"s": ((9, 0), (12, 1), (15, 2), (18, 3), (None, 4)), "ms": ((12, 0), (None, 1)), "r": ((18, 0), (None, 1))}),
)
# Rain (mm) to fungicide units, by day of the season up to the given one.
WASHOFF = (
    (1, ((1.45, 4), (3.45, 5), (6, 6), (None, 7))),
    (2, ((1.45, 3), (4.45, 4), (8, 5), (None, 6))),
    (3, ((2.45, 3), (5, 4), (None, 5))),
    (5, ((2.45, 3), (8, 4), (None, 5))),
    (9, ((4, 3), (None, 4))),
    (14, ((1.45, 2), (8, 3), (None, 4))),
    (None, ((8, 2), (None, 3))),
)
# Sums from which a treatment is due, by class.
BLIGHT_DUE = {"s": 30, "ms": 35, "mr": 40, "r": 45, "hr": 50}
WASHOFF_DUE = {"s": 15, "ms": 20, "mr": 25, "r": 35, "hr": 45}


def _first(value: Column, steps) -> Column:
    out = None
    for limit, score in steps:
        if limit is None:
            return out.otherwise(score) if out is not None else F.lit(score)
        out = F.when(value <= limit, score) if out is None else out.when(value <= limit, score)
    return out


def blight_units(hours: Column, temperature: Column, kind: str) -> Column:
    """Units of a day; 0 outside the bands and where the temperature is missing. The lowest band includes its low end."""
    if kind not in CLASSES:
        raise ValueError(f"unknown class {kind!r}")
    column = kind if kind in ("s", "ms") else "r"
    out = None
    for (low, high), table in BLIGHT:
        inside = (temperature > low if low > 3 else temperature >= low) & (temperature <= high)
        score = _first(hours, table[column])
        out = F.when(inside, score) if out is None else out.when(inside, score)
    return out.otherwise(0).cast("int")


def washoff_units(rain: Column, day: Column) -> Column:
    """Units of a day of the season: below 1 mm, but not dry, it is 1; dry days follow the table."""
    out = F.when((rain > 0) & (rain < 1), 1)
    for last, steps in WASHOFF:
        out = out.otherwise(_first(rain, steps)) if last is None else out.when(day <= last, _first(rain, steps))
    return out.cast("int")


def narrow(value: Column) -> Column:
    """As a signed byte that wraps, for outputs compatible with an 8-bit layout."""
    return (F.pmod(value + 128, F.lit(256)) - 128).cast("int")


def _sql_first(value: str, steps) -> str:
    whens = " ".join(f"WHEN {value} <= {limit} THEN {score}" for limit, score in steps if limit is not None)
    return f"CASE {whens} ELSE {steps[-1][1]} END"


def blight_sql(hours: str, temperature: str, kind: str) -> str:
    """The same as SQL text, for checks by another engine."""
    column = kind if kind in ("s", "ms") else "r"
    bands = " ".join(f"WHEN {temperature} {'>' if low > 3 else '>='} {low} AND {temperature} <= {high} THEN {_sql_first(hours, t[column])}" for (low, high), t in BLIGHT)
    return f"(CASE {bands} ELSE 0 END)"


def washoff_sql(rain: str, day: str) -> str:
    days = " ".join(f"WHEN {day} <= {last} THEN {_sql_first(rain, steps)}" for last, steps in WASHOFF if last is not None)
    return f"(CASE WHEN {rain} > 0 AND {rain} < 1 THEN 1 {days} ELSE {_sql_first(rain, WASHOFF[-1][1])} END)"
