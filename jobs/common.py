"""What the jobs share: configuration files, tables that may not be there yet, and logging."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str) -> dict:
    """A JSON file, from any file system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def written(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The table at path, or nothing where none has been written yet."""
    try:
        spark.read.format("parquet").load(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return spark.read.schema(schema).parquet(path)


def start_logging() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
