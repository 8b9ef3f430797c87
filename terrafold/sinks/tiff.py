"""Plain GeoTIFF files from pixel tables: one band, one strip a row, uncompressed, WGS 84.

A raster is a dense array with a size given by its geometry, so it is put together on the driver: rows arrive sorted,
one at a time, and only one row is held."""

from __future__ import annotations

import struct
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.raster import NODATA, Geometry
from terrafold.sources import geotiff
from terrafold.sources.files import open_new

#: Sample types by name, with the number that the format has for them.
KINDS = {"int16": (np.dtype("<i2"), 2), "float32": (np.dtype("<f4"), 3)}
_FORMATS = {2: "s", 3: "H", 4: "I", 12: "d"}


def _metadata(description: str, tags: dict[str, str] | None) -> str:
    root = ElementTree.Element("GDALMetadata")
    for name, value in (tags or {}).items():
        ElementTree.SubElement(root, "Item", name=name).text = str(value)
    if description:
        ElementTree.SubElement(root, "Item", name="DESCRIPTION", sample="0", role="description").text = description
    return ElementTree.tostring(root, encoding="unicode")


def facts(g: Geometry, kind: str, compression: int, rows: int, cols: int, description: str = "", tags: dict[str, str] | None = None) -> list[tuple[int, int, list | bytes]]:
    """(tag, type, values) that any layout has: size, samples, place, description, items and the missing value."""
    dtype, sample = KINDS[kind]
    text = lambda x: x.encode() + b"\0"
    out = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [dtype.itemsize * 8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (339, 3, [sample])]
    out += [(270, 2, text(description))] if description else []
    # a geographic model, pixels are areas, EPSG 4326
    out += [(33550, 12, [g.dx, g.dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, g.west, g.north, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326])]
    out += [(42112, 2, text(_metadata(description, tags)))] if description or tags else []
    return [*out, (42113, 2, text(str(NODATA)))]


def directory(common: list, own: list, at: int, last: bool = True) -> bytes:
    """A directory of tags that stands at an offset of the file, and behind it the values that do not fit into it."""
    entries = sorted([*common, *own], key=lambda e: e[0])
    head = at + 2 + 12 * len(entries) + 4
    table, pool = b"", b""
    for code, kind, values in entries:
        data = values if kind == 2 else struct.pack("<" + _FORMATS[kind] * len(values), *values)
        if len(data) <= 4:
            table += struct.pack("<HHI", code, kind, len(values)) + data.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", code, kind, len(values), head + len(pool))
            pool += data + b"\0" * (len(data) % 2)
    return struct.pack("<H", len(entries)) + table + struct.pack("<I", 0 if last else head + len(pool)) + pool


def write(pixels: DataFrame, g: Geometry, path: str, kind: str = "int16", description: str = "", tags: dict[str, str] | None = None) -> None:
    """pixels: y_idx, x_idx, value; missing pixels get NODATA. Pixels outside the geometry are an error. The description of
    the band and the tags go into the file as metadata items."""
    dtype = KINDS[kind][0]
    row_bytes = g.cols * dtype.itemsize
    common = facts(g, kind, 1, g.rows, g.cols, description, tags)

    def head(start: int) -> bytes:
        strips = [(273, 4, [start + k * row_bytes for k in range(g.rows)]), (278, 4, [1]), (279, 4, [row_bytes] * g.rows)]
        return struct.pack("<2sHI", b"II", 42, 8) + directory(common, strips, 8)

    by_row = pixels.groupBy("y_idx").agg(F.sort_array(F.collect_list(F.struct("x_idx", F.col("value").cast("double").alias("v")))).alias("cells")).orderBy("y_idx")
    with open_new(path) as f:
        f.write(head(len(head(0))))
        at = 0
        empty = np.full(g.cols, NODATA, dtype)
        for r in by_row.toLocalIterator():
            if not 0 <= r["y_idx"] < g.rows:
                raise ValueError("a pixel lies outside the raster")
            f.write(empty.tobytes() * (r["y_idx"] - at))
            line = empty.copy()
            line[[c["x_idx"] for c in r["cells"]]] = [c["v"] for c in r["cells"]]
            f.write(line.tobytes())
            at = r["y_idx"] + 1
        f.write(empty.tobytes() * (g.rows - at))


def read_tags(path: str) -> dict[str, str]:
    """The metadata items of a file, the band's description among them."""
    return geotiff.items(path)


def read(path: str) -> tuple[np.ndarray, Geometry]:
    """A small raster as one array, on the driver; sources.geotiff reads large ones in tasks."""
    image, g = geotiff.images(path)[0], geotiff.geometry(path)
    out = np.full(image.shape, NODATA, image.kind)
    for batch in geotiff.RasterReader({"path": path}).read(geotiff.Windows(path, 0, image.windows())):
        out[batch["y_idx"].to_numpy(), batch["x_idx"].to_numpy()] = batch["value"].to_numpy()
    return out, g
