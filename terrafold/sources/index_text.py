"""Monthly index series from white-space separated text with comment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, comment: str = "%") -> DataFrame:
    """(year, month, value) of lines `year month value`; empty lines and comments are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(~F.col("line").startswith(comment) & (F.length("line") > 0))
    part = F.split("line", r"\s+")
    return lines.select(part[0].cast("int").alias("year"), part[1].cast("int").alias("month"), part[2].cast("double").alias("value"))
