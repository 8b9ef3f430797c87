"""Tiled GeoTIFF files with overviews (cloud-optimised), put together by tasks.

Pixels become tiles as rows, each filled, differenced and deflated in a task; an overview has every second, fourth or
eighth pixel of each row and column. The driver sees the sizes of the tiles alone, a number each, lays out the file and
writes its head; then one task streams the compressed tiles behind it, in order, a batch at a time, to a file beside the
path, which takes its place at the end. Tiles without pixels are left out, as the format allows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.checks import DataError, none_where
from terrafold.operators.raster import NODATA, Geometry
from terrafold.sinks.tiff import KINDS, directory, facts
from terrafold.sources.files import open_new, rename

TILE = 256
OVERVIEWS = (2, 4, 8)


def _encode(values: np.ndarray) -> bytes:
    """Deflated after differencing: of neighbours (integers), of bytes by significance (floats)."""
    if values.dtype.kind == "f":
        planes = values.astype(">f4").view(np.uint8).reshape(len(values), -1, 4).transpose(0, 2, 1).reshape(len(values), -1)
        return zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).tobytes(), 6)
    first = np.zeros((len(values), 1), values.dtype)
    return zlib.compress(np.diff(values, axis=1, prepend=first).astype(values.dtype).tobytes(), 6)


def tiles_of(pixels: DataFrame, kind: str, overviews: tuple[int, ...] = OVERVIEWS) -> DataFrame:
    """pixels (y_idx, x_idx, value) to (level, ty, tx, data): the compressed tiles of the raster and its overviews.

    A tile has at most TILE x TILE pixels, so the groups are bounded."""
    dtype = KINDS[kind][0]
    steps = (1, *overviews)
    level = F.explode(F.array(*[F.when((F.col("y_idx") % s == 0) & (F.col("x_idx") % s == 0), F.struct(F.lit(k).alias("level"), F.floor(F.col("y_idx") / s).alias("y"), F.floor(F.col("x_idx") / s).alias("x"))) for k, s in enumerate(steps)]))
    each = pixels.where(F.col("value").isNotNull()).select(level.alias("at"), F.col("value").cast("double").alias("v")).where("at IS NOT NULL")
    keys = [F.col("at.level").alias("level"), F.floor(F.col("at.y") / TILE).cast("int").alias("ty"), F.floor(F.col("at.x") / TILE).cast("int").alias("tx")]
    each = each.select(*keys, (F.col("at.y") % TILE * TILE + F.col("at.x") % TILE).cast("int").alias("cell"), "v")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if rows["cell"].duplicated().any():
            raise ValueError("two values for one pixel")
        tile = np.full(TILE * TILE, NODATA, dtype)
        tile[rows["cell"].to_numpy()] = rows["v"].to_numpy()
        return pd.DataFrame({"level": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [_encode(tile.reshape(TILE, TILE))]})

    return each.groupBy("level", "ty", "tx").applyInPandas(fill, "level int, ty int, tx int, data binary")


def layout(g: Geometry, kind: str, sizes: dict[tuple[int, int, int], int], description: str, tags: dict[str, str] | None, overviews: tuple[int, ...] = OVERVIEWS) -> bytes:
    """The file's head: one directory for the raster and each overview, whose tiles follow, the smallest overview first."""

    def heads(start: int) -> bytes:
        at, places = start, {}
        for key in sorted(sizes, key=lambda k: (-k[0], k[1], k[2])):
            places[key] = at
            at += sizes[key]
        if at >= 1 << 32:
            raise DataError("the raster is too large for a classic TIFF file")
        out = struct.pack("<2sHI", b"II", 42, 8)
        for level, step in enumerate((1, *overviews)):
            rows, cols = -(-g.rows // step), -(-g.cols // step)
            order = [(level, y, x) for y in range(-(-rows // TILE)) for x in range(-(-cols // TILE))]
            body = [(254, 4, [int(level > 0)]), (317, 3, [3 if KINDS[kind][1] == 3 else 2]), (322, 3, [TILE]), (323, 3, [TILE]), (324, 4, [places.get(k, 0) for k in order]), (325, 4, [sizes.get(k, 0) for k in order])]
            own = facts(g, kind, 8, rows, cols, description, tags) if not level else [e for e in facts(g, kind, 8, rows, cols) if e[0] not in (33550, 33922, 34735)]
            out += directory(own, body, len(out), last=level == len(overviews))
        return out

    return heads(len(heads(0)))


def write(pixels: DataFrame, g: Geometry, path: str, kind: str = "int16", description: str = "", tags: dict[str, str] | None = None, overviews: tuple[int, ...] = OVERVIEWS) -> None:
    """pixels: y_idx, x_idx, value; missing pixels get NODATA. Pixels outside the geometry, or two at one place, are an error.
    An older file stays as it is until the new one is whole."""
    none_where(pixels, ~(F.col("y_idx").between(0, g.rows - 1) & F.col("x_idx").between(0, g.cols - 1)), "pixels outside the raster")
    spark = pixels.sparkSession
    kept = f"{path}.tiles"
    tiles_of(pixels, kind, overviews).write.mode("overwrite").parquet(kept)
    tiles = spark.read.parquet(kept)
    sizes = {(r["level"], r["ty"], r["tx"]): r["n"] for r in tiles.select("level", "ty", "tx", F.length("data").alias("n")).collect()}
    head = layout(g, kind, sizes, description, tags, overviews)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        with open_new(f"{path}.part") as f:
            written += f.write(head) or len(head)
            for batch in batches:
                for data in batch["data"]:
                    written += f.write(data) or len(data)
        yield pd.DataFrame({"bytes": [written]})

    in_order = tiles.orderBy(F.desc("level"), "ty", "tx").select("data").coalesce(1)
    total = in_order.mapInPandas(stream, "bytes long").first()["bytes"]
    if total != len(head) + sum(sizes.values()):
        raise DataError(f"{path}: {total} bytes written, {len(head) + sum(sizes.values())} expected")
    rename(f"{path}.part", path)
    at = spark._jvm.org.apache.hadoop.fs.Path(kept)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
