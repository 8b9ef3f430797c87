"""Hourly temperature and humidity of a day from its extremes, and what of the hours is humid.

The curve of a day has four parts: a rise after sunrise, a sine to sunset, a square-root fall to midnight and the rest
of the night before, which starts from the previous day's sunset. A window runs from 13:00 to 12:00 of the next day.
`humid_window` computes whole windows in numpy from the rows' own and neighbouring values (Arrow batches, 24 columns
wide, no array crosses to the JVM); `hours_column` is the same curve as a pure SQL array, for other uses and as a check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FALL = 0.39
BEFORE_SUNSET = 4.0
# Buck's saturation pressure.
BUCK = (0.61121, 18.678, 234.5, 257.14)


def hours_column(tn: Column, tx: Column, tp: Column, rise: Column, set_: Column, tn_b: Column, tx_b: Column, rise_b: Column, set_b: Column) -> Column:
    """Temperatures at hours 1..24. tp: the next day's minimum; _b: of the day before."""
    half_pi = F.lit(float(np.pi / 2))
    peak, at_set, at_set_b = set_ - BEFORE_SUNSET, tx - FALL * (tx - tp), tx_b - FALL * (tx_b - tn_b)

    def hour(h: Column) -> Column:
        h = h.cast("double")
        morning = tn + (tx - tn) * ((h - rise) / (peak - rise)) * half_pi
        day = at_set + (tx - at_set) * F.sin(half_pi + (h - peak) / 4.0 * half_pi)
        evening = at_set + (tp - at_set) / F.sqrt(rise + 24.0 - set_) * F.sqrt(F.greatest(h - set_, F.lit(0.0)))
        night = at_set_b + (tn - at_set_b) / F.sqrt(rise_b + 24.0 - set_b) * F.sqrt(F.greatest(h + 24.0 - set_b, F.lit(0.0)))
        return F.when(h <= rise, night).when(h <= peak, morning).when(h <= set_, day).otherwise(evening)

    return F.transform(F.sequence(F.lit(1), F.lit(24)), hour)


def vapour(t):
    a, b, c, d = BUCK
    return a * np.exp((b - t / c) * t / (d + t))


def _curve(h: np.ndarray, tn, tx, tp, rise, set_, tn_b, tx_b, rise_b, set_b) -> np.ndarray:
    tn, tx, tp, rise, set_, tn_b, tx_b, rise_b, set_b = (np.asarray(v, dtype=np.float64)[:, None] for v in (tn, tx, tp, rise, set_, tn_b, tx_b, rise_b, set_b))
    peak, at_set, at_set_b = set_ - BEFORE_SUNSET, tx - FALL * (tx - tp), tx_b - FALL * (tx_b - tn_b)
    out = at_set + (tp - at_set) / np.sqrt(rise + 24 - set_) * np.sqrt(np.maximum(h - set_, 0))
    day = at_set + (tx - at_set) * np.sin(np.pi / 2 + (h - peak) / 4 * (np.pi / 2))
    out = np.where(h <= set_, day, out)
    out = np.where(h <= peak, tn + (tx - tn) * ((h - rise) / (peak - rise)) * (np.pi / 2), out)
    night = at_set_b + (tn - at_set_b) / np.sqrt(rise_b + 24 - set_b) * np.sqrt(np.maximum(h + 24 - set_b, 0))
    return np.where(h <= rise, night, out)


def humid_window(threshold: float = 90.0):
    """A vectorised function of 15 columns: of the row tn, tx, td, rise, set; of the row before the same; of the row
    before that tn, tx, rise, set; of the row after tn. Gives struct<hours:int, tmean:double>: how many hours of the
    window that ends at the row's noon are humid, and their mean temperature (of all 24 if none is)."""

    @F.pandas_udf("hours int, tmean double")
    def window(tn: pd.Series, tx: pd.Series, td: pd.Series, rise: pd.Series, set_: pd.Series, tn1: pd.Series, tx1: pd.Series, td1: pd.Series, rise1: pd.Series, set1: pd.Series, tn2: pd.Series, tx2: pd.Series, rise2: pd.Series, set2: pd.Series, tn_next: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            late = _curve(np.arange(13, 25, dtype=np.float64)[None, :], tn1, tx1, tn, rise1, set1, tn2, tx2, rise2, set2)
            early = _curve(np.arange(1, 13, dtype=np.float64)[None, :], tn, tx, tn_next, rise, set_, tn1, tx1, rise1, set1)
            t = np.concatenate([late, early], axis=1)
            e = np.concatenate([np.repeat(vapour(np.asarray(td1, dtype=np.float64))[:, None], 12, axis=1), np.repeat(vapour(np.asarray(td, dtype=np.float64))[:, None], 12, axis=1)], axis=1)
            humid = 100.0 * e / vapour(t) >= threshold
            hours = humid.sum(axis=1)
            mean = np.where(hours > 0, np.where(humid, t, 0.0).sum(axis=1) / np.maximum(hours, 1), t.mean(axis=1))
        return pd.DataFrame({"hours": hours.astype("int32"), "tmean": mean})

    return window
