"""Treatment decisions on a stream: the state of each series lives in Spark's state store.

`decide` takes days that come in order within a series (a stream partitioned by series keeps it); days of one micro-batch
are sorted. `decide_late` takes days in any order within a delay: they wait in the state until the watermark has passed
them. The outcome for a finite input is that of the batch scan, however the input is cut into micro-batches; of
`decide_late`, up to the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrafold.functions import scores
from terrafold.operators.scan import FORCED_DAY, MIN_DAYS

OUT = "id long, season int, date date, day int, bu int, fu int, acc_bu int, acc_fu int, applications int"
SUMS = "sum_b long, sum_f long, since int, day int, count int"


class _Treatments:
    """The decisions of one series so far, and the rule for the next day."""

    def __init__(self, kind: str, min_days: int, forced_day: int, sums: tuple[int, ...] = (0, 0, 0, 0, 0)):
        self.due_b, self.due_f, self.min_days, self.forced_day = scores.BLIGHT_DUE[kind], scores.WASHOFF_DUE[kind], min_days, forced_day
        self.sum_b, self.sum_f, self.since, self.day, self.count = sums

    @property
    def sums(self) -> tuple[int, ...]:
        return self.sum_b, self.sum_f, self.since, self.day, self.count

    def next(self, bu: int, fu: int) -> tuple[int, ...]:
        """day, bu, fu, acc_bu, acc_fu, applications of the next day."""
        self.day, self.since, self.sum_b, self.sum_f = self.day + 1, self.since + 1, self.sum_b + bu, self.sum_f + fu
        hit = self.day == self.forced_day + 1 or ((self.sum_b >= self.due_b or self.sum_f > self.due_f) and self.since > self.min_days and self.count > 0)
        self.count += hit
        out = (self.day, bu, 0 if hit else fu, self.sum_b if hit else 0, self.sum_f if hit else 0, self.count)
        if hit:
            self.sum_b = self.sum_f = self.since = 0
        return out


_COLUMNS = ["id", "season", "date", "day", "bu", "fu", "acc_bu", "acc_fu", "applications"]


def decide(days: DataFrame, kind: str = "r", min_days: int = MIN_DAYS, forced_day: int = FORCED_DAY) -> DataFrame:
    """days: a stream of id, season, date, bu, fu. Adds the day of the series, sums at treatments and the count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = _Treatments(kind, min_days, forced_day, *([state.get] if state.exists else []))
        rows = pd.concat(list(batches)).sort_values("date")
        out = [(*key, date, *series.next(int(bu), int(fu))) for date, bu, fu in zip(rows["date"], rows["bu"], rows["fu"])]
        state.update(series.sums)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return days.groupBy("id", "season").applyInPandasWithState(step, OUT, SUMS, "append", GroupStateTimeout.NoTimeout)


_DAY_MS = 86_400_000


def decide_late(days: DataFrame, kind: str = "r", delay_days: int = 10, idle_days: int = 120, min_days: int = MIN_DAYS, forced_day: int = FORCED_DAY) -> DataFrame:
    """The same for days that come up to `delay_days` later than the latest day of the stream; later ones are dropped.

    A day is decided when the watermark has passed it, in the order of days; what waits is at most the days of the delay.
    A series that has had no day for `idle_days` is over, and its state goes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, last, waiting = ((*state.get[:5],), state.get[5], list(zip(*state.get[6:]))) if state.exists else ((0, 0, 0, 0, 0), 0, [])
        for rows in batches:
            if len(rows):
                at = pd.to_datetime(rows["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
                waiting += list(zip(at.tolist(), rows["bu"].astype(int).tolist(), rows["fu"].astype(int).tolist()))
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [x for x in waiting if x[0] * _DAY_MS <= passed]
        waiting = waiting[len(ready) :]
        series = _Treatments(kind, min_days, forced_day, sums)
        out = [(*key, pd.Timestamp(at, unit="D").date(), *series.next(bu, fu)) for at, bu, fu in ready]
        last = ready[-1][0] if ready else last
        if not waiting and state.hasTimedOut and (last + idle_days) * _DAY_MS <= passed:
            state.remove()
        else:
            state.update((*series.sums, last, *([list(x) for x in zip(*waiting)] or [[], [], []])))
            state.setTimeoutTimestamp(max(passed + 1, waiting[0][0] * _DAY_MS if waiting else (last + idle_days) * _DAY_MS))
        yield pd.DataFrame(out, columns=_COLUMNS)

    timed = days.select("id", "season", "date", "bu", "fu", F.col("date").cast("timestamp").alias("at")).withWatermark("at", f"{delay_days} days")
    held = f"{SUMS}, last int, dates array<int>, bu array<int>, fu array<int>"
    return timed.groupBy("id", "season").applyInPandasWithState(step, OUT, held, "append", GroupStateTimeout.EventTimeTimeout)
