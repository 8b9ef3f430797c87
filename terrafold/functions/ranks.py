"""Order statistics of a whole column without gathering it: histograms that narrow down to the wanted ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 2048
FEW = 10_000


def at_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """values: one column `v` of numbers, no NULL. The v of each rank (from 0) in their order.

    Each round counts the values of every interval that still holds a wanted rank in BINS parts, one aggregation with at
    most that many rows for each; the parts that hold a rank are the next intervals, from their least to their greatest
    value. What an interval of at most FEW values holds is read."""
    facts = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()
    out: dict[int, float] = {}
    # interval: least value, greatest value, how many, and how many lie below it
    open_ = {(float(facts["low"]), float(facts["high"]), int(facts["n"]), 0): sorted(set(ranks))} if facts["n"] else {}
    while open_:
        for key in [k for k in open_ if k[0] == k[1]]:
            out |= dict.fromkeys(open_.pop(key), key[0])
        for key in [k for k in open_ if k[2] <= FEW]:
            low, high, _, before = key
            held = sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())
            out |= {r: float(held[r - before]) for r in open_.pop(key)}
        if not open_:
            break
        keys = list(open_)
        inside = F.coalesce(*[F.when(F.col("v").between(low, high), F.lit(i)) for i, (low, high, _, _) in enumerate(keys)])
        part = F.coalesce(*[F.when(inside == i, F.floor((F.col("v") - low) / (high - low) * BINS)) for i, (low, high, _, _) in enumerate(keys)])
        counts = values.select("v", inside.alias("i"), part.alias("part")).where("i is not null").groupBy("i", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
        below = [k[3] for k in keys]
        nxt: dict[tuple, list[int]] = {}
        for r in sorted(counts.collect(), key=lambda r: (r["i"], r["part"])):
            i, first = r["i"], below[r["i"]]
            mine = [x for x in open_[keys[i]] if first <= x < first + r["n"]]
            if mine:
                nxt[(float(r["low"]), float(r["high"]), int(r["n"]), first)] = mine
            below[i] += r["n"]
        open_ = nxt
    return out


def percentiles(values: DataFrame, shares: list[float]) -> list[float] | None:
    """Of a column `v` the values at these shares (0 to 1) of the way through its order, between two neighbours in
    proportion; None of an empty table."""
    n = values.count()
    if not n:
        return None
    at = [s * (n - 1) for s in shares]
    found = at_ranks(values, [int(x) for a in at for x in (math.floor(a), math.ceil(a))])
    return [found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) for a in at]


def higher_quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, q: per key the value at the rank that is next above `share` of the way through its values, itself one of them.

    Equal values are counted before they move, and the running count of a key is sorted and read as a stream."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_v"))
    total = F.sum("_n").over(w)
    reached = counts.select(*keys, "_v", upto.alias("_upto"), total.alias("_total")).where(F.col("_upto") > F.ceil((F.col("_total") - 1) * F.lit(share)))
    return reached.groupBy(*keys).agg(F.min("_v").alias("q"))
