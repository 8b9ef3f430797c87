"""Gridded daily cubes in NetCDF, as a Spark data source.

`bounds.load(spark, Netcdf, path)` gives (time, row, col, value) of one variable with dimensions (time, lat, lon). Files of
the classic layout (formats 1, 2 and 5) are read by blocks of time steps, those based on HDF5 (NetCDF-4) by runs of chunks:
each block or run is one input partition, read by offset from the file, which may lie on any file system that Arrow knows,
with numpy and without a library.

Bounds on time, row and col, given to bounds.load(), reach the file: time bounds leave out partitions, row bounds bytes of
each step, col bounds cells; of chunks those are read that the bounds meet."""

from __future__ import annotations

import datetime as dt
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.checks import DataError
from terrafold.sources import hdf5
from terrafold.sources.bounds import Box
from terrafold.sources.files import open_at

_TYPES = {1: "b", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}

# Names that files use for their axes.
TIME_NAMES = ("time", "T", "z")
LAT_NAMES = ("latitude", "lat")
LON_NAMES = ("longitude", "lon")
_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attrs: dict
    kind: np.dtype
    size: int
    begin: int


class Header:
    """Dimensions, attributes and variables of a file, from its first bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at, self.version = data, 4, data[3]
        self.records = self._count()
        self.dims = self._list(10, lambda: (self._name(), self._count()))
        self.attrs = dict(self._list(12, self._attr))
        self.vars = {v.name: v for v in self._list(11, self._var)}
        self.record_size = sum(v.size for v in self.vars.values() if v.dims and self.dims[v.dims[0]][1] == 0)

    def _int(self, fmt: str) -> int:
        value = struct.unpack_from(fmt, self.data, self.at)[0]
        self.at += struct.calcsize(fmt)
        return value

    def _count(self) -> int:
        return self._int(">q" if self.version == 5 else ">i")

    def _name(self) -> str:
        n = self._count()
        out = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return out

    def _list(self, tag: int, read) -> list:
        found, n = self._int(">i"), self._count()
        if found not in (0, tag):
            raise ValueError("the file's header is broken")
        return [read() for _ in range(n)]

    def _attr(self):
        name = self._name()
        kind, n = np.dtype(_TYPES[self._int(">i")]), self._count()
        raw = self.data[self.at : self.at + n * kind.itemsize]
        self.at += len(raw) + -len(raw) % 4
        return name, raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()

    def _var(self) -> Variable:
        name = self._name()
        dims = [self._count() for _ in range(self._count())]
        attrs = dict(self._list(12, self._attr))
        kind = np.dtype(_TYPES[self._int(">i")])
        size = self._count()
        begin = self._int(">i" if self.version == 1 else ">q")
        return Variable(name, dims, attrs, kind, size, begin)

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[k][1] or self.records for k in v.dims]


@dataclass
class Block(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class Run(InputPartition):
    """Chunks of an HDF5-based file."""

    path: str
    chunks: list[hdf5.Chunk]


class CubeReader(Box, DataSourceReader):
    axes = ("time", "row", "col")

    def __init__(self, options: dict):
        super().__init__(options)
        self.path, self.variable = options["path"], options.get("variable")
        self.steps, self.each = int(options.get("steps", "31")), int(options.get("chunks", "8"))

    def _open(self):
        header = _header(self.path)
        names = [n for n, v in header.vars.items() if len(v.dims) == 3]
        name = self.variable or (names[0] if names else "")
        if name not in header.vars or len(header.vars[name].dims) != 3:
            raise ValueError(f"no variable of three dimensions named {name!r}")
        return header, header.vars[name]

    def partitions(self):
        header, v = self._open()
        if isinstance(header, hdf5.File) and v.tree is not None:
            met = [c for c in header.chunks(v) if all(a < hi and a + n > lo for a, n, (lo, hi) in zip(c.start, v.chunk, self.box.values()))]
            return [Run(self.path, met[k : k + self.each]) for k in range(0, len(met), self.each)] or [Run(self.path, [])]
        first, last = self.box["time"][0], min(self.box["time"][1], header.shape(v)[0])
        # blocks begin at the same steps whatever the filter
        begin = first - first % self.steps
        blocks = [Block(self.path, max(a, first), min(a + self.steps, last)) for a in range(begin, last, self.steps)]
        return blocks or [Block(self.path, 0, 0)]

    def read(self, part: Block | Run):
        header, v = self._open()
        size = header.shape(v)
        box = [(lo, min(hi, n)) for (lo, hi), n in zip(self.box.values(), size)]
        if any(lo >= hi for lo, hi in box):
            return
        with open_at(part.path) as f:
            if isinstance(part, Run):
                for c in part.chunks:
                    block = hdf5.unpack(v, f.read_at(c.length, c.at), c.skipped)
                    inside = [(max(a, lo), min(a + n, hi)) for a, n, (lo, hi) in zip(c.start, v.chunk, box)]
                    yield self._cells(v, block[tuple(slice(lo - a, hi - a) for a, (lo, hi) in zip(c.start, inside))], [lo for lo, _ in inside])
                return
            _, rows, cols = size
            line = cols * v.kind.itemsize
            step = header.record_size if isinstance(header, Header) and header.dims[v.dims[0]][1] == 0 else rows * line
            (r0, r1), (c0, c1) = box[1:]
            for t in range(part.first, part.last):
                raw = np.frombuffer(f.read_at((r1 - r0) * line, v.begin + t * step + r0 * line), v.kind).reshape(1, r1 - r0, cols)
                yield self._cells(v, raw[:, :, c0:c1], [t, r0, c0])

    @staticmethod
    def _cells(v, raw: np.ndarray, first: list[int]):
        """A block of the array as rows; what is missing is NULL."""
        import pyarrow as pa

        fill = v.attrs.get("_FillValue", v.attrs.get("missing_value", [None]))[0]
        scale, offset = v.attrs.get("scale_factor", [1.0])[0], v.attrs.get("add_offset", [0.0])[0]
        axes_ = [pa.array((a + first[k]).ravel().astype(np.int32)) for k, a in enumerate(np.indices(raw.shape, dtype=np.int32))]
        raw = raw.ravel()
        value = raw.astype(np.float64) * scale + offset
        gone = np.isnan(value) | (np.abs(value) > 1e30)
        if fill is not None:
            gone |= raw == np.asarray(fill, raw.dtype)
        return pa.RecordBatch.from_arrays([*axes_, pa.array(value, mask=gone)], names=["time", "row", "col", "value"])


class Netcdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return "time int, row int, col int, value double"

    def reader(self, schema) -> CubeReader:
        return CubeReader(dict(self.options))


def _header(path: str) -> Header | hdf5.File:
    """The header, however long: more of the file is read until all of it is there."""
    with open_at(path) as f:
        if f.read_at(8, 0) == hdf5.SIGNATURE:
            return hdf5.File(path)
        length, size = f.size(), 1 << 16
        while True:
            try:
                return Header(f.read_at(min(size, length), 0))
            except (struct.error, ValueError):
                if size >= length or f.read_at(3, 0) != b"CDF":
                    raise
                size *= 4


def axes(path: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Coordinate variables of a file, on the driver; nothing else of it is read."""
    header = _header(path)
    if isinstance(header, hdf5.File):
        return {n: hdf5.values(header, header.vars[n]).astype(np.float64) for n in names}
    out = {}
    with open_at(path) as f:
        for n in names:
            v = header.vars[n]
            count = int(np.prod(header.shape(v)))
            records = header.dims[v.dims[0]][1] == 0
            step, each = (header.record_size, 1) if records else (0, count)
            got = []
            for k in range(count if records else 1):
                got.append(np.frombuffer(f.read_at(each * v.kind.itemsize, v.begin + k * step), v.kind))
            out[n] = np.concatenate(got).astype(np.float64) if got else np.zeros(0)
    return out


def _cube_variable(header: Header | hdf5.File, name: str | None) -> Variable | hdf5.Variable:
    found = [v for v in header.vars.values() if len(v.dims) == 3 and name in (None, v.name)]
    if not found:
        raise DataError(f"no variable of three dimensions{f' named {name!r}' if name else ''}")
    return found[0]


def check_grid(path: str, lat0: float, lon0: float, rows: int, cols: int, variable: str | None = None, tolerance: float = 1e-6) -> None:
    """Fails unless the variable's dimensions are (time, latitude, longitude), as many rows and columns as said, from this origin."""
    header = _header(path)
    v = _cube_variable(header, variable)
    order = [header.dims[k][0] for k in v.dims]
    if order[1] not in LAT_NAMES or order[2] not in LON_NAMES:
        raise DataError(f"dimensions are {', '.join(order)}, not time, latitude, longitude")
    shape = header.shape(v)[1:]
    if shape != [rows, cols]:
        raise DataError(f"the cube has {shape[0]} x {shape[1]} nodes, not {rows} x {cols}")
    known = [n for n in order[1:] if n in header.vars]
    for n, first in zip(order[1:], (lat0, lon0)):
        if n not in known:
            raise DataError(f"no coordinates named {n}")
        at = axes(path, (n,))[n][0]
        if abs(at - first) > tolerance:
            raise DataError(f"{n} begins at {at}, not at {first}")


def days_of(path: str, start: dt.date | None = None, variable: str | None = None, names: tuple[str, ...] = TIME_NAMES) -> list[dt.date]:
    """The day of each step. The time axis is the first of `names` that the file has; with units `... since ...` it tells
    the day, else, or where there is no axis, steps are days from `start` on."""
    header = _header(path)
    steps = header.shape(_cube_variable(header, variable))[0]
    name = next((n for n in names if n in header.vars and len(header.vars[n].dims) == 1), None)
    attrs = header.vars[name].attrs if name else {}
    unit, _, since = str(attrs.get("units", "")).partition(" since ")
    if not since:
        if start is None:
            raise DataError("the time axis names no first day: give one")
        return [start + dt.timedelta(days=k) for k in range(steps)]
    if attrs.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
        raise DataError(f"days of the calendar {attrs['calendar']!r} are not read")
    seconds = _SECONDS.get(unit.strip().lower().rstrip("s"))
    if seconds is None:
        raise DataError(f"steps in {unit!r} are not read")
    day, *clock = since.strip().replace("T", " ").split()
    origin = dt.datetime(*(int(x) for x in day.split("-")))
    for x, width in zip((clock or ["0"])[0].rstrip("Z").split(":"), (3600, 60, 1)):
        origin += dt.timedelta(seconds=float(x) * width)
    return [(origin + dt.timedelta(seconds=float(t) * seconds)).date() for t in axes(path, (name,))[name]]


def check_days(days: list[dt.date]) -> None:
    """Fails if a month's steps are torn: each step has to be the day after the one before it, once a month has begun."""
    for a, b in zip(days, days[1:]):
        if b <= a or (a.year, a.month) == (b.year, b.month) and b != a + dt.timedelta(days=1):
            raise DataError(f"the steps of a month are not contiguous: {b} after {a}")


def start_date(units: str) -> str | None:
    """The first day of `days since ...` units; None where the units name none, and steps count from a given day."""
    return units.split(" since ", 1)[1].strip()[:10] if " since " in units else None
