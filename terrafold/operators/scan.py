"""Treatment decisions along a series: accumulated scores that a decision resets.

The state depends on the data, so no window frame expresses it. `by_batches` deals whole series to grouped Arrow
functions by a hash of the key and steps through the days with all series of a batch side by side; `by_arrays` is the
same scan as a fold over each series' array, without Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import scores

MIN_DAYS = 5
FORCED_DAY = 25


def scored(humid: DataFrame, kind: str = "r", keys: tuple[str, ...] = ("id", "season")) -> DataFrame:
    """humid days with their two scores. The day that the rain table asks for is the day of the series, counted here
    where the rows do not have it."""
    if "day" not in humid.columns:
        humid = humid.withColumn("day", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    return humid.withColumns({"bu": scores.blight_units(F.col("humid_hours"), F.col("humid_tmean"), kind), "fu": scores.washoff_units(F.col("rain"), F.col("day"))})


def _fold(bu: np.ndarray, fu: np.ndarray, live: np.ndarray, due_b: int, due_f: int, min_days: int, forced_day: int):
    """Arrays (series, day). Returns fu after resets, the sums at treatments, and the running count."""
    n, days = bu.shape
    sb, sf, since, count = (np.zeros(n, dtype=np.int64) for _ in range(4))
    treated_once = np.zeros(n, dtype=bool)
    out_fu, at_b, at_f, apps = fu.copy(), np.zeros_like(bu), np.zeros_like(bu), np.zeros_like(bu)
    for k in range(days):
        on = live[:, k]
        since += on
        sb += np.where(on, bu[:, k], 0)
        sf += np.where(on, fu[:, k], 0)
        due = ((sb >= due_b) | (sf > due_f)) & (since > min_days) & treated_once
        hit = on & (due | (k == forced_day))
        at_b[:, k], at_f[:, k] = np.where(hit, sb, 0), np.where(hit, sf, 0)
        out_fu[hit, k] = 0
        count += hit
        treated_once |= hit
        sb[hit], sf[hit], since[hit] = 0, 0, 0
        apps[:, k] = count
    return out_fu, at_b, at_f, apps


def by_batches(days: DataFrame, kind: str = "r", keys: tuple[str, ...] = ("id", "season"), min_days: int = MIN_DAYS, forced_day: int = FORCED_DAY, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """days: keys, date, day (1..n), bu, fu and more. Adds acc_bu, acc_fu (sums at a treatment, else 0) and
    applications (running count); fu is 0 on treatment days.

    dealt: tasks already hold whole series in order, as after climate.humid_days; they are not shuffled again, and a
    series that is out of order is an error. Else series are dealt by their keys."""
    due_b, due_f = scores.BLIGHT_DUE[kind], scores.WASHOFF_DUE[kind]
    extra = "acc_bu int, acc_fu int, applications int"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema) + ", " + extra
    order = [*keys, "day"]

    def run(batches):
        """Rows come sorted by series and day; a series that a batch cuts waits for its rest."""
        rest: pd.DataFrame | None = None
        for batch in batches:
            data = batch if rest is None or rest.empty else pd.concat([rest, batch], ignore_index=True)
            if data.empty:
                continue
            starts = np.flatnonzero(data["day"].to_numpy() == 1)
            cut = int(starts[-1]) if len(starts) else 0
            rest = data.iloc[cut:]
            if cut:
                yield treat(data.iloc[:cut])
        if rest is not None and not rest.empty:
            yield treat(rest)

    def treat(rows: pd.DataFrame) -> pd.DataFrame:
        day = rows["day"].to_numpy() - 1
        if day[0] or ((np.diff(day) != 1) & (day[1:] != 0)).any():
            raise ValueError("days of a series are missing or out of order")
        series = np.cumsum(day == 0) - 1
        shape = (int(series[-1]) + 1, int(day.max()) + 1)
        bu, fu, live = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        bu[series, day], fu[series, day], live[series, day] = rows["bu"], rows["fu"], True
        out_fu, at_b, at_f, apps = (a[series, day].astype(np.int32) for a in _fold(bu, fu, live, due_b, due_f, min_days, forced_day))
        return rows.assign(fu=out_fu, acc_bu=at_b, acc_fu=at_f, applications=apps)

    if not dealt:
        days = (days.repartition(parts, *keys) if parts else days.repartition(*keys)).sortWithinPartitions(*order)
    return days.mapInPandas(run, schema)


def by_arrays(days: DataFrame, kind: str = "r", keys: tuple[str, ...] = ("id", "season"), min_days: int = MIN_DAYS, forced_day: int = FORCED_DAY, run: int = 64) -> DataFrame:
    """The same as by_batches for the columns keys, date, day, bu, fu, acc_bu, acc_fu, applications.

    A fold that appends copies what it has so far; so a series is cut into runs of days, each folded into an array of its
    own that starts from the sums of the run before, and what is copied stays within a run."""
    due_b, due_f = scores.BLIGHT_DUE[kind], scores.WASHOFF_DUE[kind]
    series = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "date", "bu", "fu"))).alias("rows"))
    zero = F.lit(0)
    out_type = "array<struct<day:int,date:date,bu:int,fu:int,acc_bu:int,acc_fu:int,applications:int>>"
    nothing = F.array().cast(out_type)
    sums = ("sb", "sf", "since", "count")

    def step(a, x):
        sb, sf, since = a["sb"] + x["bu"], a["sf"] + x["fu"], a["since"] + 1
        hit = (x["day"] == forced_day + 1) | (((sb >= due_b) | (sf > due_f)) & (since > min_days) & (a["count"] > 0))
        row = F.struct(
            x["day"].alias("day"), x["date"].alias("date"), x["bu"].alias("bu"), F.when(hit, zero).otherwise(x["fu"]).alias("fu"),
            F.when(hit, sb).otherwise(zero).alias("acc_bu"), F.when(hit, sf).otherwise(zero).alias("acc_fu"), (a["count"] + hit.cast("int")).alias("applications"),
        )
        return F.struct(
            F.when(hit, zero).otherwise(sb).alias("sb"), F.when(hit, zero).otherwise(sf).alias("sf"), F.when(hit, zero).otherwise(since).alias("since"),
            (a["count"] + hit.cast("int")).alias("count"), F.concat(a["out"], F.array(row)).alias("out"),
        )

    def fold(state, part):
        start = F.struct(*[state[s].alias(s) for s in sums], nothing.alias("out"))
        done = F.aggregate(part, start, step)
        # bound to a variable, so that a run is folded once
        return F.transform(F.array(done), lambda d: F.struct(*[d[s].alias(s) for s in sums], F.concat(state["runs"], F.array(d["out"])).alias("runs")))[0]

    parts = F.transform(F.sequence(zero, F.floor((F.size("rows") - 1) / run).cast("int")), lambda i: F.slice("rows", i * run + 1, run))
    begin = F.struct(*[zero.alias(s) for s in sums], F.array().cast(f"array<{out_type}>").alias("runs"))
    folded = series.select(*keys, F.explode(F.flatten(F.aggregate(parts, begin, fold)["runs"])).alias("r"))
    return folded.select(*keys, "r.*")
