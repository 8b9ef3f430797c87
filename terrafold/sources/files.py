"""Bytes of a file on any file system that Arrow knows (local, HDFS, object stores), by offset, on the driver and in tasks."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyarrow import NativeFile
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import SparkSession


def locate(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return LocalFileSystem(), unquote(path.removeprefix("file:").replace("///", "/", 1))
    if "://" in path:
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path


def open_at(path: str) -> NativeFile:
    """For reading by offset: seek and read, or read_at."""
    fs, at = locate(path)
    return fs.open_input_file(at)


def open_new(path: str) -> NativeFile:
    """For writing from the start on."""
    fs, at = locate(path)
    return fs.open_output_stream(at)


def rename(path: str, to: str) -> None:
    fs, at = locate(path)
    fs.move(at, locate(to)[1])


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call, under spark.checkpoint.dir, which driver and executors share. Where that is unset,
    a folder of this machine in local mode; an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    out = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
    return out
