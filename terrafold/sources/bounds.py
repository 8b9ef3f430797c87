"""Bounds on the integer axes of a Python data source, given when the table is opened.

They are options and not filters that Spark pushes: Spark 4.1.2 keeps what it pushed into a Python source with the table,
so that a second use of one table in a plan (a join with itself, a union) reads by the other use's filters. A table that is
opened with bounds has them for good, and each opening is a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

ALL = 1 << 62


class Box:
    """For each axis the first index and the one after the last; all of an axis where nothing is said."""

    axes: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.box = {name: (int(options.get(f"{name}_from", "0")), int(options.get(f"{name}_until", str(ALL)))) for name in self.axes}


def load(spark: SparkSession, source: type[DataSource], path: str, within: dict[str, tuple[int | None, int | None]] | None = None, **options) -> DataFrame:
    """The source's table of a path. within: for some axes the first index and the one after the last, None for no bound."""
    spark.dataSource.register(source)
    read = spark.read.format(source.name()).option("path", path)
    for name, (first, until) in (within or {}).items():
        options |= {f"{name}_from": first, f"{name}_until": until}
    for name, value in options.items():
        read = read if value is None else read.option(name, str(value))
    return read.load()
