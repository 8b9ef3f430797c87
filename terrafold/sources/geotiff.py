"""GeoTIFF rasters of any writer as a Spark data source of pixels.

`bounds.load(spark, GeoTiff, path)` gives (y_idx, x_idx, value) of one band's valid pixels. Each tile, or strip, of the file is a
window; windows are dealt to input partitions and read by offset, on any file system that Arrow knows. Bounds on y_idx
and x_idx, given to bounds.load(), leave out windows.

Options: path; band (from 1); level (0: the raster itself, 1 and on: its overviews); windows (of a partition, 16). Read are
classic and big files of either byte order; tiles and strips; no compression, LZW, deflate and PackBits; predictors
1 to 3; integers and floats of 8 to 64 bits; bands side by side or apart."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.operators.raster import Geometry
from terrafold.sources.bounds import Box
from terrafold.sources.files import open_at

# The format's field types, and the tags that are used here.
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 254, 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_KIND = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, METADATA, NODATA_TEXT = 33550, 33922, 42112, 42113


@dataclass
class Image:
    """One image of a file: its tags, and the byte order of its values."""

    tags: dict[int, tuple]
    order: str

    def get(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self.get(HEIGHT), self.get(WIDTH)

    @property
    def block(self) -> tuple[int, int]:
        rows, cols = self.shape
        return (self.get(TILE_HEIGHT), self.get(TILE_WIDTH)) if TILE_AT in self.tags else (min(self.get(STRIP_ROWS, rows), rows), cols)

    @property
    def kind(self) -> np.dtype:
        return np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[self.get(SAMPLE_KIND, 1)] + str(self.get(BITS, 1) // 8))

    @property
    def nodata(self) -> float | None:
        text = self.get(NODATA_TEXT)
        return float(text.rstrip(b"\0 ").decode().strip("\0 ")) if text else None

    def windows(self) -> list[tuple[int, int, int]]:
        """(first row, first column, number) of each tile or strip of a band."""
        (rows, cols), (high, wide) = self.shape, self.block
        across = -(-cols // wide)
        return [(y * high, x * wide, y * across + x) for y in range(-(-rows // high)) for x in range(across)]


def images(path: str) -> list[Image]:
    """All images of a file, in its order; only heads and tags are read."""
    out = []
    with open_at(path) as f:
        head = f.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError(f"{path} is not a TIFF file")
        order = "<" if head[:2] == b"II" else ">"
        big = struct.unpack_from(order + "H", head, 2)[0] == 43
        word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
        at = struct.unpack_from(order + word, head, 8 if big else 4)[0]
        while at:
            count_size = 8 if big else 2
            n = struct.unpack(order + ("Q" if big else "H"), f.read_at(count_size, at))[0]
            table = f.read_at(n * entry + inline, at + count_size)
            tags = {}
            for k in range(n):
                code, kind, count = struct.unpack_from(order + "HH" + word, table, k * entry)
                if kind not in _FIELDS:
                    continue
                fmt = f"{order}{count}s" if kind == 2 else order + _FIELDS[kind] * count
                size, value = struct.calcsize(fmt), k * entry + 4 + struct.calcsize("<" + word)
                data = table[value : value + size] if size <= inline else f.read_at(size, struct.unpack_from(order + word, table, value)[0])
                tags[code] = struct.unpack(fmt, data)
            out.append(Image(tags, order))
            at = struct.unpack_from(order + word, table, n * entry)[0]
    return out


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, before, out = list(start), 9, 0, 0, b"", bytearray()
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(start), 9, b""
            continue
        piece = table[code] if code < len(table) else before + before[:1]
        out += piece
        if before:
            table.append(before + piece[:1])
        before = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def decode(image: Image, data: bytes, rows: int, samples: int) -> np.ndarray:
    """A window's bytes as an array (row, column, sample)."""
    how = image.get(COMPRESSION, 1)
    if how not in _UNPACK:
        raise ValueError(f"compression {how} is not read")
    kind, cols = image.kind, image.block[1]
    raw, predictor = np.frombuffer(_UNPACK[how](data), np.uint8), image.get(PREDICTOR, 1)
    raw = raw[: rows * cols * samples * kind.itemsize]
    if predictor == 3:  # bytes of a row by significance, each the difference to the one before
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, samples)
    values = raw.view(kind).reshape(rows, cols, samples)
    return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else values


@dataclass
class Windows(InputPartition):
    path: str
    level: int
    numbers: list[tuple[int, int, int]]


class RasterReader(Box, DataSourceReader):
    axes = ("y_idx", "x_idx")

    def __init__(self, options: dict):
        super().__init__(options)
        self.path, self.band, self.level = options["path"], int(options.get("band", "1")), int(options.get("level", "0"))
        self.each = int(options.get("windows", "16"))

    def partitions(self):
        image = images(self.path)[self.level]
        (y0, y1), (x0, x1), (high, wide) = self.box["y_idx"], self.box["x_idx"], image.block
        met = [w for w in image.windows() if w[0] < y1 and w[0] + high > y0 and w[1] < x1 and w[1] + wide > x0]
        return [Windows(self.path, self.level, met[k : k + self.each]) for k in range(0, len(met), self.each)] or [Windows(self.path, self.level, [])]

    def read(self, part: Windows):
        import pyarrow as pa

        image = images(part.path)[part.level]
        rows, cols = image.shape
        high, wide = image.block
        tiled, samples, apart = TILE_AT in image.tags, image.get(SAMPLES, 1), image.get(PLANAR, 1) == 2
        at, sizes = (image.tags[t] for t in ((TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES)))
        (y0, y1), (x0, x1) = self.box["y_idx"], self.box["x_idx"]
        if not 1 <= self.band <= samples:
            raise ValueError(f"{part.path} has no band {self.band}")
        with open_at(part.path) as f:
            for top, left, n in part.numbers:
                n += (self.band - 1) * len(image.windows()) if apart else 0
                if not sizes[n]:
                    continue  # a window that was never written
                lines = high if tiled else min(high, rows - top)
                block = decode(image, f.read_at(sizes[n], at[n]), lines, 1 if apart else samples)[: rows - top, : cols - left, 0 if apart else self.band - 1]
                keep = np.isfinite(block) if block.dtype.kind == "f" else np.ones(block.shape, bool)
                if image.nodata is not None:
                    keep &= block != image.nodata
                y, x = np.nonzero(keep)
                y, x, value = (y + top).astype(np.int32), (x + left).astype(np.int32), block[keep].astype(np.float64)
                inside = (y >= y0) & (y < y1) & (x >= x0) & (x < x1)
                yield pa.RecordBatch.from_arrays([pa.array(y[inside]), pa.array(x[inside]), pa.array(value[inside])], names=["y_idx", "x_idx", "value"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "y_idx int, x_idx int, value double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def geometry(path: str) -> Geometry:
    """Where the raster's pixels lie."""
    image = images(path)[0]
    dx, dy, _ = image.tags[SCALE]
    x, y = image.tags[TIE][3:5]
    return Geometry(x, y, dx, dy, *image.shape)


def items(path: str) -> dict[str, str]:
    """The metadata items of a file, the band's description among them."""
    found = images(path)[0].get(METADATA)
    return {e.get("name"): e.text or "" for e in ElementTree.fromstring(found.rstrip(b"\0"))} if found else {}
