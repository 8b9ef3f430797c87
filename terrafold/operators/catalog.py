"""What is there and what is missing: layouts, resumption, comparison of runs, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.checks import none_where


def months(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(year, month) of whole years."""
    seq = F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-01").cast("date"), F.expr("interval 1 month")))
    return spark.range(1).select(seq.alias("d")).select(F.year("d").alias("year"), F.month("d").alias("month"))


def missing_months(present: DataFrame, asked: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, year, month) that are asked for and not there."""
    names = asked.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    return asked.join(F.broadcast(names), how="cross").join(present.select("variable", "year", "month").distinct(), ["variable", "year", "month"], "left_anti")


def layout_report(present: DataFrame, asked: DataFrame, variables: list[str]) -> DataFrame:
    """Per variable: n_present, first and last month (yyyymm), n_missing of the months asked for."""
    gone = missing_months(present, asked, variables).groupBy("variable").agg(F.count(F.lit(1)).alias("n_missing"))
    stamp = F.col("year") * 100 + F.col("month")
    there = present.select("variable", stamp.alias("stamp")).distinct().groupBy("variable").agg(F.count(F.lit(1)).alias("n_present"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))
    names = asked.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    out = names.join(there, "variable", "left").join(gone, "variable", "left")
    return out.select("variable", F.coalesce("n_present", F.lit(0)).alias("n_present"), "first", "last", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def to_do(asked: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is asked for and not done yet."""
    return asked.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unexpected(rows: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """rows, unless one has a key that is not expected."""
    none_where(rows.select(key).distinct().join(expected.select(key), key, "left_anti"), F.lit(True), f"unexpected {key}")
    return rows


def relayout(rows: DataFrame, expected: DataFrame, id_: str = "id", date: str = "date", value: str = "value") -> DataFrame:
    """A foreign month table in the engine's layout: days without a time, narrow types, sorted by id and date."""
    out = rows.select(F.col(id_).cast("int").alias("id"), F.to_date(date).alias("date"), F.col(value).cast("float").alias("value"))
    return unexpected(out, expected).repartitionByRange("id").sortWithinPartitions("id", "date")


def two_roots(first: DataFrame, second: DataFrame, variables_of_second: list[str]) -> DataFrame:
    """One view over two trees: the named variables come from the second, all others from the first."""
    inside = F.col("variable").isin(variables_of_second)
    return first.where(~inside).unionByName(second.where(inside))


def compare_runs(old: DataFrame, new: DataFrame, columns: list[str], keys: tuple[str, ...] = ("id", "date"), count: str = "applications") -> DataFrame:
    """One row: rows in common, rows on one side only, largest difference of each column, and ids whose greatest count differs.

    The keys are unique on each side. Both sides are grouped in one pass instead of joined."""
    sides = [df.select(*keys, *[F.col(c).alias(f"_{side}_{c}") for c in columns], F.lit(side).alias("_side")) for side, df in (("a", old), ("b", new))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy(*keys).agg(
        F.bool_or(F.col("_side") == "a").alias("_old"), F.bool_or(F.col("_side") == "b").alias("_new"), *[F.max(f"_{side}_{c}").alias(f"_{side}_{c}") for side in "ab" for c in columns]
    )
    # sums by id first: the second shuffle moves a row an id and task
    by_id = both.groupBy(keys[0]).agg(
        F.count_if(F.col("_old") & F.col("_new")).alias("n_common"), F.count_if(~F.col("_new")).alias("n_only_old"), F.count_if(~F.col("_old")).alias("n_only_new"),
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).cast("double").alias(f"max_diff_{c}") for c in columns],
        F.coalesce(F.max(f"_a_{count}") != F.max(f"_b_{count}"), F.lit(False)).alias("_changed"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by_id.agg(*[total(c) for c in ("n_common", "n_only_old", "n_only_new")], *[F.max(f"max_diff_{c}").alias(f"max_diff_{c}") for c in columns], F.count_if("_changed").alias("n_ids_changed"))


def sample_ids(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n ids without replacement, the same ones for a seed at every partitioning."""
    return points.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def melt(wide: DataFrame, keys: list[str], days: list[str], name: str = "date", value: str = "value") -> DataFrame:
    """One column a day to one row a day."""
    return wide.unpivot(keys, days, name, value)
