"""Data assertions: a predicate that must hold for no row, or keys that must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """The input breaks a rule that the operator relies on."""


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns; else an error that names the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def none_where(df: DataFrame, bad: Column, what: str, show: int = 3) -> DataFrame:
    """Fails, with a few examples, if any row is bad. One job, which stops at the first examples it finds."""
    found = df.where(bad).limit(show).collect()
    if found:
        raise DataError(f"{what}: {', '.join(str(r.asDict()) for r in found)}")
    return df


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """Fails if two rows have the same key."""
    none_where(df.groupBy(*keys).count(), F.col("count") > 1, f"repeated key {', '.join(keys)}")
    return df


def lazily(value: Column, bad: Column, message: str) -> Column:
    """value, or a run-time error where bad: the check rides along with the plan instead of a job of its own."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def option(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def nan_to_null(c: Column) -> Column:
    """Missing values as NULL; comparisons with NaN are true in Spark, so they must not get that far."""
    return F.when(~F.isnan(c), c)
