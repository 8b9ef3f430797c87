"""Rows and series that break rules are set aside with their reasons, and the run goes on without them.

A rule is a name and a condition that is true for a bad row; one that is NULL is not broken. All rules ride along with one pass over the
rows: a row carries the names of the rules that it breaks, counts come from an observation of the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terrafold.checks import require

REASONS = "reasons"


def judged(rows: DataFrame, rules: dict[str, Column], name: str = REASONS) -> DataFrame:
    """rows with the names of the rules that each row breaks, in the order of the rules; empty for a good row."""
    if not rules:
        return rows.withColumn(name, F.array().cast("array<string>"))
    return rows.withColumn(name, F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()])))


def counted(rows: DataFrame, rules: list[str], seen: Observation, name: str = REASONS) -> DataFrame:
    """rows, counted on their way: seen.get has `rows`, `rejected` and a count for each rule once an action has run."""
    each = [F.count_if(F.array_contains(name, rule)).alias(rule) for rule in rules]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(name) > 0).alias("rejected"), *each)


def repeated(rows: DataFrame, *keys: str, name: str = "repeated") -> DataFrame:
    """rows with a boolean: another row has the same key. Keys with a NULL are not compared.

    Only keys that occur more than once are joined back; a very common one is split by the engine's skew handling."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    again = rows.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(name))
    return rows.join(again, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def series_report(rows: DataFrame, keys: tuple[str, ...], rules: dict[str, Column], unique: str | None = None) -> DataFrame:
    """The series that break a rule: keys, reasons (sorted), n_bad and n_rows. A row breaks a rule; with `unique`, a series with two
    rows of one value there breaks the rule "repeated". One aggregation by series, partial before its shuffle."""
    marked = judged(require(rows, *keys), rules, "_reasons")
    if unique is None:
        sums = marked.groupBy(*keys)
        broken = F.array_distinct(F.flatten(F.collect_set("_reasons")))
        found = sums.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("_reasons") > 0).alias("n_bad"), broken.alias(REASONS))
    else:
        by_value = marked.groupBy(*keys, unique).agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(F.size("_reasons") > 0).alias("_bad"), F.flatten(F.collect_set("_reasons")).alias("_reasons"),
        )
        twice = F.when(F.col("_n") > 1, F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>"))
        by_value = by_value.withColumns({"_reasons": F.array_distinct(F.concat("_reasons", twice)), "_bad": F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.col("_bad"))})
        found = by_value.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.sum("_bad").alias("n_bad"), F.array_distinct(F.flatten(F.collect_set("_reasons"))).alias(REASONS))
    return found.where(F.size(REASONS) > 0).select(*keys, F.array_sort(REASONS).alias(REASONS), "n_bad", "n_rows")


def without(rows: DataFrame, report: DataFrame, *keys: str) -> DataFrame:
    """rows of the series that no report names; a key with a NULL is a series like any other."""
    same = F.lit(True)
    side = report.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(side, same, "left_anti")
