"""Writing tables in the engine's layouts: months, seasons, coverage, reports, and new columns for old results."""

from __future__ import annotations

import json
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.checks import DataError


def write_months(long: DataFrame, path: str, mode: str = "overwrite", files: int | None = None, group_rows: int | None = None) -> None:
    """variable, year, month, id, date, value as Parquet by variable and month, sorted by id and date inside files, so
    that filters on ids skip row groups; group_rows bounds the rows of a group, such as ids times days.

    With "overwrite" the months at hand are replaced, whole, and others stay: a rerun leaves the same rows. A month is staged
    beside the table and takes its place when all tasks are done, so a run that fails before leaves it as it was. With
    "append" rows are added to the months, by every run again."""
    rows = long.select("variable", "year", "month", F.col("id").cast("int").alias("id"), "date", F.col("value").cast("float").alias("value"))
    keys = ["variable", "year", "month", "id"]
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    out = dealt.sortWithinPartitions(*keys, "date").write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", str(group_rows))
    out.partitionBy("variable", "year", "month").parquet(path)


def write_seasons(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Daily results by season and region; with "overwrite" only the seasons at hand are replaced."""
    keys = ["season", "region", "id"]
    out = results.repartitionByRange(*keys).sortWithinPartitions(*keys, "date").write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("season", "region").parquet(path)


def write_coverage(report: DataFrame, path: str) -> None:
    """One JSON record per season."""
    report.repartition(1).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, digits: int = 5) -> None:
    """A small table as one CSV file with a header, floats rounded."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*rounded).repartition(1).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A JSON document through Spark's file systems."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, sort_keys=True),)], "value string").repartition(1).write.mode("overwrite").text(path)


def provenance(sources: dict | None = None, layout: DataFrame | None = None, failures: list[str] | None = None, notes: str | None = None, **facts) -> dict:
    """What made a table: its sources, the layout report (a row a variable), what failed, notes, other facts, and the
    commit where there is one."""
    given = {"sources": sources, "layout": layout and [r.asDict() for r in layout.orderBy("variable").collect()], "failures": failures, "notes": notes}
    facts = {**facts, **{k: v for k, v in given.items() if v is not None}}
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = ""
    return {**facts, "commit": commit or None}


def swap(spark: SparkSession, path: str, new: str) -> None:
    """Puts the table at `new` in the place of the one at `path`. The old one is moved aside and goes last, so that a run
    that stops in between leaves both."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}-old"
    if not fs.rename(place(path), place(aside)):
        raise DataError(f"{path} cannot be moved")
    if not fs.rename(place(new), place(path)):
        fs.rename(place(aside), place(path))
        raise DataError(f"{new} cannot be moved")
    fs.delete(place(aside), True)
    spark.catalog.refreshByPath(path)


def backfill(spark: SparkSession, path: str, points: DataFrame, columns: tuple[str, ...], force: bool = False, group_rows: int | None = None) -> str:
    """Adds columns of the points to results written before. The new table is written beside the old one and takes its
    place when it has as many rows. Present columns are left alone unless `force` is set."""
    from terrafold.operators.season import strict_lookup

    old = spark.read.parquet(path)
    todo = [c for c in columns if force or c not in old.columns]
    if not todo:
        return path
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    parts = [c for c in ("season", "region") if c in old.columns]
    out = strict_lookup(old, points, *todo).write.option("compression", "zstd")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", str(group_rows))
    (out.partitionBy(*parts) if parts else out).parquet(target)
    before, after = old.count(), spark.read.parquet(target).count()
    if before != after:
        raise DataError(f"{after} rows instead of {before}")
    swap(spark, path, target)
    return path
