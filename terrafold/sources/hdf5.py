"""Where the values of an HDF5-based NetCDF file lie: its variables, their attributes, and the index of their chunks.

Only heads are read here, by offset: superblock, object headers, groups by symbol table or by links in their header, and
the B-trees that lead from a chunk's place in the array to its bytes. Tasks then read and unpack the chunks they are dealt
(sources/cube.py). Files with newer chunk indexes than B-trees, with groups or attributes in fractal heaps, with other
filters than deflate, shuffle and Fletcher's sum, or with compound types are refused by name."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from terrafold.sources.files import open_at

NOWHERE = (1 << 64) - 1
# The format's signatures, message types and filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, SYMBOLS = 0x1, 0x2, 0x3, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


@dataclass
class Variable:
    name: str
    address: int
    size: tuple[int, ...]
    kind: np.dtype
    attrs: dict = field(default_factory=dict)
    begin: int | None = None  # of values in one piece
    tree: int | None = None  # of chunks
    chunk: tuple[int, ...] = ()
    filters: list[int] = field(default_factory=list)
    dims: list[int] = field(default_factory=list)


@dataclass
class Chunk:
    """A chunk's first index on each axis, and its bytes."""

    start: tuple[int, ...]
    at: int
    length: int
    skipped: int  # filters that were not applied, a bit each


def _kind(data: bytes, at: int = 0) -> np.dtype | str:
    """The type of values; "text" and "vlen" for strings, "refs" for lists of references."""
    what, flags, size = data[at] & 15, data[at + 1], struct.unpack_from("<I", data, at + 4)[0]
    if what in (0, 1):
        return np.dtype((">" if flags & 1 else "<") + ("f" if what else "i" if flags & 8 else "u") + str(size))
    if what == 3:
        return np.dtype(f"S{size}")
    if what == 9:
        return "vlen" if flags & 15 == 1 else "refs"
    if what == 7:
        return "ref"
    raise ValueError(f"values of HDF5's type class {what} are not read")


def _shape(data: bytes, at: int = 0) -> tuple[int, ...]:
    version, rank = data[at], data[at + 1]
    return struct.unpack_from(f"<{rank}Q", data, at + (8 if version == 1 else 4))


class File:
    """Variables of the root group by name, and dimensions in the order in which they are met."""

    def __init__(self, path: str):
        self.path = path
        with open_at(path) as f:
            self.f = f
            head = f.read_at(128, 0)
            if head[:8] != SIGNATURE:
                raise ValueError(f"{path} is not an HDF5 file")
            if head[8] > 3 or head[13 if head[8] < 2 else 9] != 8:
                raise ValueError("superblocks of this version or with other offsets than of 8 bytes are not read")
            root = struct.unpack_from("<Q", head, {0: 64, 1: 68}.get(head[8], 36))[0]
            self.vars: dict[str, Variable] = {}
            for name, address in self._links(root).items():
                found = self._variable(name, address)
                if found:
                    self.vars[name] = found
            self._dimensions()
            del self.f

    # ---- object headers ----

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, content) of all messages of an object, those of continued blocks too."""
        head = self.f.read_at(64, address)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + 16 * bool(head[5] & 0x20) + 4 * bool(head[5] & 0x10)
            width = 1 << (flags & 3)
            size = int.from_bytes(head[at : at + width], "little")
            blocks, entry = [(address + at + width, size)], 4 + 2 * bool(flags & 4)
        else:
            blocks, entry = [(address + 16, struct.unpack_from("<I", head, 8)[0])], 8
        while blocks:
            start, size = blocks.pop(0)
            data, at = self.f.read_at(size, start), 0
            while at + entry <= len(data):
                kind, length = struct.unpack_from("<HH", data, at) if entry == 8 else struct.unpack_from("<BH", data, at)
                content = data[at + entry : at + entry + length]
                at += entry + length
                if kind == MORE:
                    begin, whole = struct.unpack_from("<QQ", content)
                    # a block of the newer kind has its signature before and a sum behind
                    blocks.append((begin, whole) if entry == 8 else (begin + 4, whole - 8))
                elif kind:
                    out.append((kind, content))
        return out

    def _links(self, address: int) -> dict[str, int]:
        """Names of a group with the addresses of their objects."""
        out: dict[str, int] = {}
        for kind, data in self.messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", data)
                names = struct.unpack_from("<Q", self.f.read_at(32, heap), 24)[0]
                for node in self._leaves(tree, 0):
                    count = struct.unpack_from("<H", self.f.read_at(8, node), 6)[0]
                    rows = self.f.read_at(40 * count, node + 8)
                    for k in range(count):
                        name, target = struct.unpack_from("<QQ", rows, 40 * k)
                        out[self.f.read_at(256, names + name).split(b"\0")[0].decode()] = target
            elif kind == LINK_INFO:
                heap = struct.unpack_from("<Q", data, 2 + 8 * bool(data[1] & 1))[0]
                if heap != NOWHERE:
                    raise ValueError("groups with so many variables that they lie in a fractal heap are not read")
            elif kind == LINK:
                flags, at = data[1], 2
                hard = not flags & 8 or data[at] == 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                size = int.from_bytes(data[at : at + width], "little")
                name = data[at + width : at + width + size].decode()
                if hard:
                    out[name] = struct.unpack_from("<Q", data, at + width + size)[0]
        return out

    def _leaves(self, address: int, rank: int) -> list:
        """What a B-tree leads to: addresses of symbol nodes (rank 0), or chunks of an array of that rank."""
        head = self.f.read_at(24, address)
        if head[:4] != b"TREE":
            raise ValueError("the file's index is broken")
        level, count = head[5], struct.unpack_from("<H", head, 6)[0]
        key = 8 if not rank else 8 + 8 * (rank + 1)
        data, out = self.f.read_at(count * (key + 8), address + 24), []
        for k in range(count):
            at = k * (key + 8)
            child = struct.unpack_from("<Q", data, at + key)[0]
            if level:
                out += self._leaves(child, rank)
            elif rank:
                length, skipped = struct.unpack_from("<II", data, at)
                out.append(Chunk(struct.unpack_from(f"<{rank}Q", data, at + 8), child, length, skipped))
            else:
                out.append(child)
        return out

    # ---- variables ----

    def _variable(self, name: str, address: int) -> Variable | None:
        own = Variable(name, address, (), np.dtype("u1"))
        known = set()
        for kind, data in self.messages(address):
            known.add(kind)
            if kind == SPACE:
                own.size = _shape(data)
            elif kind == TYPE:
                own.kind = _kind(data)
            elif kind == FILL and "fill" not in own.attrs:
                own.attrs["fill"] = self._fill(data)
            elif kind == LAYOUT:
                self._layout(own, data)
            elif kind == FILTERS:
                own.filters = self._filters(data)
            elif kind == ATTRIBUTE:
                self._attribute(own.attrs, data)
        raw = own.attrs.pop("fill", None)
        if raw and "_FillValue" not in own.attrs and isinstance(own.kind, np.dtype) and own.kind.itemsize == len(raw):
            own.attrs["_FillValue"] = np.frombuffer(raw, own.kind).tolist()
        return own if LAYOUT in known and isinstance(own.kind, np.dtype) else None

    @staticmethod
    def _fill(data: bytes) -> bytes:
        if data[0] == 3:
            return data[6 : 6 + struct.unpack_from("<I", data, 2)[0]] if data[1] & 0x20 else b""
        return data[8 : 8 + struct.unpack_from("<I", data, 4)[0]] if data[0] == 1 or data[3] else b""

    @staticmethod
    def _layout(own: Variable, data: bytes) -> None:
        version, kind = data[0], data[1]
        if version not in (3, 4) or kind == 0 or version == 4 and kind == 2:
            raise ValueError(f"{own.name}: values laid out by version {version}, class {kind} are not read")
        if kind == 1:
            own.begin = struct.unpack_from("<Q", data, 2)[0]
        else:
            rank = data[2] - 1
            own.tree = struct.unpack_from("<Q", data, 3)[0]
            own.chunk = struct.unpack_from(f"<{rank}I", data, 11)

    @staticmethod
    def _filters(data: bytes) -> list[int]:
        version, count, at, out = data[0], data[1], 8 if data[0] == 1 else 2, []
        for _ in range(count):
            number = struct.unpack_from("<H", data, at)[0]
            named = version == 1 or number >= 256
            size = struct.unpack_from("<H", data, at + 2)[0] if named else 0
            values = struct.unpack_from("<H", data, at + (6 if named else 4))[0]
            at += (8 if named else 6) + (size + -size % 8 if version == 1 else size) + 4 * (values + (values % 2 if version == 1 else 0))
            out.append(number)
        unknown = set(out) - {DEFLATE, SHUFFLE, FLETCHER}
        if unknown:
            raise ValueError(f"filters {sorted(unknown)} are not read")
        return out

    def _attribute(self, attrs: dict, data: bytes) -> None:
        version = data[0]
        name_size, type_size, space_size = struct.unpack_from("<HHH", data, 2)
        at = 9 if version == 3 else 8
        pad = (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
        name = data[at : at + name_size].split(b"\0")[0].decode()
        at += pad(name_size)
        try:
            kind = _kind(data, at)
        except ValueError:
            return
        space = at + pad(type_size)
        count = int(np.prod(_shape(data, space), dtype=np.int64))
        at = space + pad(space_size)
        if isinstance(kind, np.dtype):
            values = np.frombuffer(data, kind, count, at)
            attrs[name] = values[0].split(b"\0")[0].decode("utf-8", "replace") if kind.kind == "S" and count else values.tolist()
        elif kind in ("vlen", "refs"):
            pieces = [self._heap(*struct.unpack_from("<IQI", data, at + 16 * k)) for k in range(count)]
            attrs[name] = [struct.unpack_from("<Q", p)[0] if len(p) >= 8 else 0 for p in pieces] if kind == "refs" else pieces[0].decode("utf-8", "replace") if pieces else ""

    def _heap(self, length: int, address: int, index: int) -> bytes:
        """An object of a global heap."""
        if not length or address in (0, NOWHERE):
            return b""
        size = struct.unpack_from("<Q", self.f.read_at(16, address), 8)[0]
        data, at = self.f.read_at(size, address), 16
        while at + 16 <= len(data):
            number, _, _, n = struct.unpack_from("<HHIQ", data, at)
            if number == index:
                return data[at + 16 : at + 16 + n]
            if not number:
                break
            at += 16 + n + -n % 8
        return b""

    def _dimensions(self) -> None:
        """Dimensions are what variables of one axis stand for; others name theirs, or have them by their sizes."""
        axes = [v for v in self.vars.values() if len(v.size) == 1 and "DIMENSION_LIST" not in v.attrs]
        self.dims: list[tuple[str, int]] = [(v.name, v.size[0]) for v in axes]
        place = {v.address: k for k, v in enumerate(axes)}
        for v in self.vars.values():
            named = v.attrs.pop("DIMENSION_LIST", None)
            if named and all(a in place for a in named):
                v.dims = [place[a] for a in named]
            elif v in axes:
                v.dims = [axes.index(v)]
            else:
                left = list(range(len(self.dims)))
                for n in v.size:
                    k = next((k for k in left if self.dims[k][1] == n), None)
                    if k is None:
                        self.dims.append((f"axis {len(self.dims)}", n))
                        k = len(self.dims) - 1
                    else:
                        left.remove(k)
                    v.dims.append(k)

    def shape(self, v: Variable) -> list[int]:
        return list(v.size)

    def chunks(self, v: Variable) -> list[Chunk]:
        """All chunks that were ever written, by their place in the array."""
        if v.tree in (None, NOWHERE):
            return []
        with open_at(self.path) as f:
            self.f = f
            out = sorted(self._leaves(v.tree, len(v.size)), key=lambda c: c.start)
            del self.f
        return out


def unpack(v: Variable, data: bytes, skipped: int = 0) -> np.ndarray:
    """The values of a chunk."""
    for k in reversed(range(len(v.filters))):
        if skipped >> k & 1:
            continue
        if v.filters[k] == DEFLATE:
            data = zlib.decompress(data)
        elif v.filters[k] == FLETCHER:
            data = data[:-4]
        else:  # bytes of all values by significance
            size = v.kind.itemsize
            n = len(data) // size
            data = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]
    return np.frombuffer(data, v.kind, int(np.prod(v.chunk))).reshape(v.chunk)


def values(file: File, v: Variable) -> np.ndarray:
    """All values of a small variable, such as an axis."""
    with open_at(file.path) as f:
        if v.begin is not None:
            count = int(np.prod(v.size))
            return np.frombuffer(f.read_at(count * v.kind.itemsize, v.begin), v.kind).reshape(v.size) if v.begin != NOWHERE else np.zeros(v.size, v.kind)
        out = np.full(v.size, v.attrs.get("_FillValue", [0])[0], v.kind)
        for c in file.chunks(v):
            block = unpack(v, f.read_at(c.length, c.at), c.skipped)
            inside = tuple(slice(a, min(a + n, m)) for a, n, m in zip(c.start, v.chunk, v.size))
            out[inside] = block[tuple(slice(0, s.stop - s.start) for s in inside)]
        return out
