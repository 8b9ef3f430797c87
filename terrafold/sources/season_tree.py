"""Result trees of the form root/year/period/region/file, whose folders are not named key=value."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.checks import DataError


def read(spark: SparkSession, root: str, file: str = "*.parquet") -> DataFrame:
    """All files of the tree, with season, period and region from their folders."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).parquet(root)
    part = lambda k: F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -k)
    return rows.select("*", part(4).cast("int").alias("season"), part(3).alias("period"), part(2).alias("region"))


def read_coverage(spark: SparkSession, root: str, file: str = "coverage.json") -> DataFrame:
    """The coverage records beside the files, a JSON document each: season, period, region, truncated (NULL where it is not said)."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(root, wholetext=True)
    part = lambda k: F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -k)
    record = F.from_json("value", "truncated boolean, n_days int, n_ids int, first string, last string")
    return text.select(part(4).cast("int").alias("season"), part(3).alias("period"), part(2).alias("region"), record.alias("r")).select("season", "period", "region", "r.*")


def unreadable(spark: SparkSession, root: str, file: str = "*.parquet") -> DataFrame:
    """(path, reason) of files whose footer cannot be read. Tasks read the ends of their files by offset, not the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for batch in batches:
            bad = []
            for path in batch["path"]:
                try:
                    fs, at = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if not path.startswith("file://") else path)
                    with fs.open_input_file(unquote(at) if path.startswith("file:") else at) as f:
                        pq.read_metadata(f)
                except (OSError, pa.ArrowException) as e:
                    bad.append((path, str(e)[:200]))
            yield pd.DataFrame(bad, columns=["path", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file).load(root)
    return files.select("path").mapInPandas(run, "path string, reason string")


def year_paths(found: dict[tuple[str, str, str], list[str]], year: int, folders: dict[str, str], strict: bool = True) -> dict[str, str | None]:
    """period -> path of the year's one raster there. found: paths by (year, period, region); folders: period -> region.
    A period with more than one is an error; one with none too with `strict`, else it has no path, but not all of them."""
    per = {p: found.get((str(year), p, r), []) for p, r in folders.items()}
    for what, periods in (("more than one raster", [p for p, x in per.items() if len(x) > 1]), ("no raster", [p for p, x in per.items() if not x])):
        if periods and (strict or what != "no raster" or len(periods) == len(per)):
            raise DataError(f"{what} in {year}: {', '.join(periods)}")
    return {p: x[0] if x else None for p, x in per.items()}


def raster_paths(spark: SparkSession, root: str, first: int, last: int, folders: dict[str, str], pattern: str = "BU*.tif*", strict: bool = True) -> tuple[dict[int, dict[str, str | None]], dict[int, str]]:
    """The rasters root/year/period/region/pattern of each year, and why other years are left out. One listing of names
    (as many as years times periods); no year at all is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*/*/{pattern}")
    listed = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    found: dict[tuple[str, str, str], list[str]] = {}
    for path in sorted(s.getPath().toString() for s in listed or []):
        year, period, region = path.split("/")[-4:-1]
        found.setdefault((year, period, region), []).append(path)
    years: dict[int, dict[str, str | None]] = {}
    skipped: dict[int, str] = {}
    for y in range(first, last + 1):
        try:
            years[y] = year_paths(found, y, folders, strict)
        except DataError as e:
            skipped[y] = str(e)
    if not years:
        raise DataError("no year has its rasters")
    return years, skipped
