"""Point tables from a GeoPackage (SQLite with well-known binary) or a shapefile, without a geometry library.

Features are read in tasks: those of a shapefile by ranges of its index (.shx), from any file system that Arrow knows;
those of a GeoPackage by ranges of row numbers, from a path that all machines have mounted, as SQLite needs. Other
shapes than points stand at their centroid: of an area the centre of mass of its rings without their holes, of lines the
midpoints of their pieces weighed by length, of several points their mean; an area without extent counts as its lines, and
lines without length as their points. In a shapefile the direction of a ring says whether it is a hole."""

from __future__ import annotations

import sqlite3
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.sources.bounds import load
from terrafold.sources.files import open_at

EACH = 10_000
Place = tuple[float, float] | None


# ---- centroids -----------------------------------------------------------------------------------------------------


def of_points(parts: list[np.ndarray]) -> Place:
    known = [p for p in parts if len(p)]
    return tuple(np.concatenate(known).mean(axis=0).tolist()) if known else None


def of_lines(parts: list[np.ndarray]) -> Place:
    """parts: the vertices (x, y) of each line."""
    total, x, y = 0.0, 0.0, 0.0
    for p in parts:
        length = np.hypot(*np.diff(p, axis=0).T)
        middle = (p[1:] + p[:-1]) / 2
        total, x, y = total + length.sum(), x + (length * middle[:, 0]).sum(), y + (length * middle[:, 1]).sum()
    return (x / total, y / total) if total > 0 else of_points(parts)


def of_area(rings: list[tuple[np.ndarray, int]]) -> Place:
    """rings: closed vertices and what they count: 1 for an outer ring, -1 for a hole, 0 by the ring's own direction."""
    known = [(p, kind) for p, kind in rings if len(p) > 2]
    if not known:
        return of_lines([p for p, _ in rings])
    origin = known[0][0][0]  # near the shape, so that no digits are lost
    area, x, y = 0.0, 0.0, 0.0
    for p, kind in known:
        q = p - origin
        cross = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
        own = cross.sum()
        turn = 1.0 if not kind else kind * (1.0 if own >= 0 else -1.0)
        area += turn * own
        x += turn * ((q[:-1, 0] + q[1:, 0]) * cross).sum()
        y += turn * ((q[:-1, 1] + q[1:, 1]) * cross).sum()
    if area == 0:
        return of_lines([p for p, _ in rings])
    return (float(origin[0] + x / (3 * area)), float(origin[1] + y / (3 * area)))


# ---- shapefile -----------------------------------------------------------------------------------------------------


def shape_place(record: bytes) -> Place:
    """The centroid of a shape record's content."""
    kind = struct.unpack_from("<i", record)[0] % 10 if len(record) >= 4 else 0
    if kind == 1:
        return struct.unpack_from("<dd", record, 4)
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return of_points([np.frombuffer(record, "<f8", 2 * n, 40).reshape(n, 2)])
    if kind in (3, 5):
        n_parts, n = struct.unpack_from("<ii", record, 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
        xy = np.frombuffer(record, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
        parts = [xy[a:b] for a, b in zip(starts, starts[1:])]
        return of_lines(parts) if kind == 3 else of_area([(p, 0) for p in parts])
    if kind:
        raise ValueError(f"shapes of kind {struct.unpack_from('<i', record)[0]} are not read")
    return None


@dataclass
class Columns:
    """The head of a .dbf table."""

    rows: int
    head: int
    size: int
    fields: list[tuple[str, str, int, int]]  # name, kind, width, decimals

    def types(self) -> list[str]:
        return [("double" if decimals or kind == "F" else "bigint") if kind in "NF" else "string" for _, kind, _, decimals in self.fields]

    def values(self, row: bytes) -> list:
        at, out = 1, []
        for (_, _, width, _), kind in zip(self.fields, self.types()):
            text = row[at : at + width].decode("utf-8", "replace").strip().strip("\0")
            at += width
            empty = not text or set(text) == {"*"}
            out.append(text if kind == "string" else None if empty else float(text) if kind == "double" else int(text))
        return out


def dbf_columns(path: str) -> Columns:
    with open_at(path) as f:
        rows, head, size = struct.unpack_from("<IHH", f.read_at(12, 0), 4)
        table = f.read_at(head - 32, 32)
    fields, at = [], 0
    while at + 32 <= len(table) and table[at] != 0x0D:
        fields.append((table[at : at + 11].split(b"\0")[0].decode(), chr(table[at + 11]), table[at + 16], table[at + 17]))
        at += 32
    return Columns(rows, head, size, fields)


@dataclass
class Span(InputPartition):
    first: int
    until: int


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"].removesuffix(".shp"), int(options.get("each", str(EACH)))

    def partitions(self):
        with open_at(f"{self.path}.shx") as f:
            n = (f.size() - 100) // 8
        return [Span(a, min(a + self.each, n)) for a in range(0, n, self.each)] or [Span(0, 0)]

    def read(self, span: Span):
        n = span.until - span.first
        if not n:
            return
        columns = dbf_columns(f"{self.path}.dbf")
        with open_at(f"{self.path}.shx") as index, open_at(f"{self.path}.shp") as shapes, open_at(f"{self.path}.dbf") as table:
            places = struct.unpack(f">{2 * n}i", index.read_at(8 * n, 100 + 8 * span.first))
            rows = table.read_at(n * columns.size, columns.head + span.first * columns.size)
            for k in range(n):
                at = shape_place(shapes.read_at(places[2 * k + 1] * 2, places[2 * k] * 2 + 8)) or (None, None)
                yield (*at, *columns.values(rows[k * columns.size : (k + 1) * columns.size]))


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        columns = dbf_columns(self.options["path"].removesuffix(".shp") + ".dbf")
        return ", ".join(["lon double", "lat double", *[f"`{f[0]}` {t}" for f, t in zip(columns.fields, columns.types())]])

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(dict(self.options))


def read_shapefile(spark: SparkSession, path: str, each: int = EACH) -> DataFrame:
    """lon, lat and the columns of the .dbf beside the .shp; lon and lat are NULL where a feature has no shape."""
    return load(spark, Shapefile, path, each=each)


# ---- GeoPackage ----------------------------------------------------------------------------------------------------


class _Wkb:
    """Reads one geometry after another from well-known binary."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.order = data, at, "<"

    def count(self) -> int:
        self.at += 4
        return struct.unpack_from(self.order + "I", self.data, self.at - 4)[0]

    def vertices(self, n: int, wide: int) -> np.ndarray:
        out = np.frombuffer(self.data, self.order + "f8", n * wide, self.at).reshape(n, wide)[:, :2]
        self.at += 8 * n * wide
        return out.astype(np.float64)

    def shape(self, points: list, lines: list, rings: list) -> None:
        self.order = "<" if self.data[self.at] else ">"
        self.at += 1
        kind = self.count()
        # Z and M by thousands, or by the two high bits
        wide = 2 + ((kind % 0x10000000) // 1000 in (1, 2)) + 2 * ((kind % 0x10000000) // 1000 == 3) + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind = kind % 0x10000000 % 1000
        if kind == 1:
            p = self.vertices(1, wide)
            points.extend([p] if np.isfinite(p).all() else [])
        elif kind == 2:
            lines.append(self.vertices(self.count(), wide))
        elif kind == 3:
            for k in range(self.count()):
                rings.append((self.vertices(self.count(), wide), -1 if k else 1))
        elif kind in (4, 5, 6, 7):
            for _ in range(self.count()):
                self.shape(points, lines, rings)
        else:
            raise ValueError(f"geometries of kind {kind} are not read")


def wkb_place(blob: bytes | None) -> Place:
    """The centroid of a GeoPackage geometry; None for an empty one. Of a collection, areas count before lines before points."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return None
    points, lines, rings = [], [], []
    _Wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]).shape(points, lines, rings)
    return of_area(rings) if rings else of_lines(lines) if lines else of_points(points)


def _layer(con: sqlite3.Connection, layer: str | None) -> tuple[str, str]:
    found = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns" + (" WHERE table_name = ?" if layer else ""), (layer,) if layer else ()).fetchone()
    if not found:
        raise ValueError(f"no layer{f' named {layer!r}' if layer else ''}")
    return found


def _connect(path: str) -> sqlite3.Connection:
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError("a GeoPackage is read from a mounted path")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class PackageReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.layer, self.each, self.columns = options["path"], options.get("layer"), int(options.get("each", str(EACH))), columns

    def partitions(self):
        with _connect(self.path) as con:
            table, _ = _layer(con, self.layer)
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        return [Span(a, min(a + self.each, high + 1)) for a in range(low, high + 1, self.each)] if low is not None else [Span(0, 0)]

    def read(self, span: Span):
        with _connect(self.path) as con:
            table, geometry = _layer(con, self.layer)
            names = ", ".join(f'"{c}"' for c in [geometry, *self.columns])
            for shape, *values in con.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (span.first, span.until)):
                at = wkb_place(shape)
                if at:
                    yield (*at, *values)


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _columns(self) -> list[tuple[str, str]]:
        with _connect(self.options["path"]) as con:
            table, geometry = _layer(con, self.options.get("layer"))
            found = [(name, kind.upper()) for _, name, kind, *_ in con.execute(f'PRAGMA table_info("{table}")') if name != geometry]
        return [(name, "bigint" if "INT" in kind or kind == "BOOLEAN" else "double" if kind in ("REAL", "DOUBLE", "FLOAT") else "binary" if kind.startswith("BLOB") else "string") for name, kind in found]

    def schema(self) -> str:
        return ", ".join(["lon double", "lat double", *[f"`{name}` {kind}" for name, kind in self._columns()]])

    def reader(self, schema) -> PackageReader:
        return PackageReader(dict(self.options), [name for name, _ in self._columns()])


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, each: int = EACH) -> DataFrame:
    """lon, lat and the layer's other columns; rows without a geometry are left out."""
    return load(spark, GeoPackage, path, layer=layer, each=each)

