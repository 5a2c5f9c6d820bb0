"""Shapefiles and FlatGeobuf files, read by ranges of bytes in many tasks.

A task gets ranges of feature numbers.  The file's own index says where these
features lie (the ``.shx`` file, or the leaves of the packed R-tree), so no task
reads the file up to its part.  A box, in the file's coordinates, goes to the tree:
the driver reads one level of at most ``MOST_NODES`` nodes, and tasks read only
the leaves and features under nodes that meet the box.

Defined cases: a feature without a shape has a null geometry; shapes that are no
points, lines or polygons are empty collections, which cleaning drops and counts;
rows that a table marks as deleted go; Z and M are read past; with a box, features
without a shape go; a FlatGeobuf file without an index is one task.
"""

from __future__ import annotations

import datetime
import decimal
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.functions import geometry as geo
from gridloom.types import GEOMETRY

Box = tuple[float, float, float, float]
#: Reads ``length`` bytes at ``offset``.
Fetch = Callable[[int, int], bytes]
#: Bytes of features for each task, and of one read.
TASK_BYTES, READ_BYTES = 32 << 20, 8 << 20
#: Nodes of the tree's level that the driver looks at (40 bytes each), and leaves that a task takes at once.
MOST_NODES, LEAVES = 4096, 8192


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _size(path: str) -> int | None:
    system, own = _place(path)
    info = system.get_file_info(own)
    return info.size if info.type == fs.FileType.File else None


def opened(path: str) -> Fetch:
    system, own = _place(path)
    file = system.open_input_file(own)

    def fetch(offset: int, length: int) -> bytes:
        data = file.read_at(length, offset)
        if len(data) < length:
            raise ValueError(f"{path} ends before byte {offset + length}")
        return data

    return fetch


def _runs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of items that lie one behind the other, of up to READ_BYTES together where one item is not larger itself."""
    first = 0
    for k in range(1, len(start) + 1):
        if k == len(start) or start[k] != end[k - 1] or end[k] - start[first] > READ_BYTES:
            if k > first:
                yield first, k
            first = k


def _meets(boxes: np.ndarray, box: Box) -> np.ndarray:
    return (boxes[:, 0] <= box[2]) & (boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[3]) & (boxes[:, 3] >= box[1])


def _scan(spark: SparkSession, tasks: list, fields: list[T.StructField], crs: str | None, rows: Callable) -> DataFrame:
    """A partition for each of ``tasks``; ``rows(task)`` gives columns of values, the geometry last.

    A column whose name stands before it, or is the geometry's, in any case of letters, gets a number behind its name.
    """
    taken, own = {GEOMETRY}, []
    for f in fields:
        name = next(n for k in range(len(fields) + 2) if (n := f"{f.name}_{k}" if k else f.name).lower() not in taken)
        taken.add(name.lower())
        own.append(T.StructField(name, f.dataType))
    schema = T.StructType([*own, T.StructField(GEOMETRY, T.BinaryType(), True, {"crs": crs} if crs else {})])
    if not tasks:
        return spark.createDataFrame([], schema)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for columns in rows(tasks[k]):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)


# Shapefiles


def _shape(raw: bytes) -> geo.Geometry | None:
    """The geometry of a record's content."""
    (kind,) = struct.unpack_from("<i", raw)
    if kind == 0:
        return None
    if kind > 30:
        return "collection", []
    kind %= 10  # with Z and with M, X and Y stand at the same place
    if kind == 1:
        if len(raw) < 20:
            raise ValueError("a record ends inside its shape")
        p = np.frombuffer(raw, "<f8", 2, 4).reshape(1, 2)
        return "point", [] if np.isnan(p).any() else [p]
    if kind == 8:
        (n,) = struct.unpack_from("<i", raw, 36)
        return "multipoint", [("point", [p.reshape(1, 2)]) for p in np.frombuffer(raw, "<f8", 2 * n, 40).reshape(n, 2)]
    if kind not in (3, 5):
        return "collection", []
    parts, n = struct.unpack_from("<ii", raw, 36)
    cuts = np.append(np.frombuffer(raw, "<i4", parts, 44), n)
    points = np.frombuffer(raw, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    pieces = [points[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    if kind == 3:
        return ("line", pieces) if len(pieces) == 1 else ("multiline", [("line", [p]) for p in pieces])
    found = geo.nested(pieces) if len(pieces) > 1 else [("polygon", pieces)]
    return found[0] if len(found) == 1 else ("multipolygon", found)


def _bounds(raw: bytes) -> tuple[float, ...] | None:
    """A record's box, without its positions."""
    (kind,) = struct.unpack_from("<i", raw)
    if kind == 0:
        return None
    return struct.unpack_from("<2d", raw, 4) * 2 if kind in (1, 11, 21) else struct.unpack_from("<4d", raw, 4)


def _dbf(fetch: Fetch, encoding: str) -> tuple[list[tuple[T.StructField, str, int, int]], int, int, int]:
    """([(field, kind, begin, length)], rows, bytes before the rows, bytes of a row)."""
    head = fetch(0, 32)
    (rows,) = struct.unpack_from("<I", head, 4)
    before, width = struct.unpack_from("<HH", head, 8)
    raw, at, fields = fetch(32, before - 32), 1, []
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        name, kind, length, decimals = raw[k : k + 11].split(b"\0")[0].decode(encoding, "replace"), chr(raw[k + 11]), raw[k + 16], raw[k + 17]
        whole = kind == "N" and not decimals and length <= 18
        own = T.LongType() if whole else T.DoubleType() if kind in "NF" else T.BooleanType() if kind == "L" else T.DateType() if kind == "D" else T.StringType()
        fields.append((T.StructField(name, own), kind, at, length))
        at += length
    return fields, rows, before, width


def _values(raw: list[bytes], kind: T.DataType, encoding: str) -> list:
    """Values of one column; blank ones, and numbers and dates that are none, are null."""

    def value(v: bytes):
        if isinstance(kind, T.StringType):
            return v.rstrip(b" \0").decode(encoding, "replace") or None
        v = v.strip(b" \0")
        try:
            if isinstance(kind, T.LongType):
                return int(v)
            if isinstance(kind, T.DoubleType):
                return float(v)
            if isinstance(kind, T.DateType):
                return datetime.datetime.strptime(v.decode(), "%Y%m%d").date()
        except ValueError:
            return None
        return True if v in (b"T", b"t", b"Y", b"y") else False if v in (b"F", b"f", b"N", b"n") else None

    return [value(v) for v in raw]


def crs_of_prj(text: str) -> str | None:
    """The EPSG code that a ``.prj`` text names: by its last authority, else by a few usual names."""
    if codes := re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]\]\s*$', text.strip()):
        return f"EPSG:{codes[-1]}"
    if zone := re.match(r'PROJCS\["WGS_1984_UTM_Zone_(\d+)([NS])"', text.strip()):
        return f"EPSG:{(32600 if zone[2] == 'N' else 32700) + int(zone[1])}"
    # How texts of systems without an authority begin.
    for begin, code in (('GEOGCS["GCS_WGS_1984"', 4326), ('GEOGCS["GCS_North_American_1983"', 4269), ('PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere"', 3857), ('PROJCS["NZGD_2000_New_Zealand_Transverse_Mercator"', 2193)):
        if text.strip().startswith(begin):
            return f"EPSG:{code}"
    return None


def _text(path: str) -> str | None:
    size = _size(path)
    return None if size is None else opened(path)(0, size).decode("utf-8", "replace")


def shape_rows(shp: Fetch, shx: Fetch, first: int, last: int, box: Box | None) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """(numbers, WKB) of the records first..last-1, some at a time; with a box, of those that may meet it."""
    for low in range(first, last, LEAVES):
        high = min(low + LEAVES, last)
        place = np.frombuffer(shx(100 + 8 * low, 8 * (high - low)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        start, end = place[:, 0], place[:, 0] + 8 + place[:, 1]
        for a, b in _runs(start, end):
            raw = memoryview(shp(int(start[a]), int(end[b - 1] - start[a])))
            records = [raw[s + 8 : e] for s, e in zip((start[a:b] - start[a]).tolist(), (end[a:b] - start[a]).tolist(), strict=True)]
            keep = list(range(b - a))
            if box:
                bounds = [_bounds(r) for r in records]
                keep = [k for k in keep if bounds[k] is not None and bounds[k][0] <= box[2] and bounds[k][2] >= box[0] and bounds[k][1] <= box[3] and bounds[k][3] >= box[1]]
            yield np.array(keep, np.int64) + low + a, [None if (g := _shape(records[k])) is None else geo.encode(g) for k in keep]


def read_shapefile(spark: SparkSession, path: str, bbox: Box | None = None) -> DataFrame:
    """The records of a shapefile; ``bbox`` keeps those whose box meets it."""
    base = path[:-4]
    beside = lambda end: next((p for p in (base + end, base + end.upper()) if _size(p) is not None), None)
    shx, dbf, prj, cpg = (beside(end) for end in (".shx", ".dbf", ".prj", ".cpg"))
    size = _size(path)
    if size is None or shx is None:
        raise ValueError(f"{path} or the .shx file beside it is missing")
    if struct.unpack(">i", opened(path)(0, 4))[0] != 9994:
        raise ValueError(f"{path} is not a shapefile")
    # Encodings by the names that .cpg files use.
    encoding = {"": "utf-8", "88591": "latin-1", "ANSI 1252": "cp1252", "1252": "cp1252"}.get(own := (_text(cpg) or "").strip() if cpg else "", own)
    fields, rows, before, width = _dbf(opened(dbf), encoding) if dbf else ([], 0, 0, 1)
    n = (_size(shx) - 100) // 8
    if dbf and rows != n:
        raise ValueError(f"{path} has {n} shapes and {rows} rows")
    step = max(1, n * TASK_BYTES // max(size + rows * width, 1))

    def read(task):
        shapes, index, table = opened(path), opened(shx), opened(dbf) if dbf else None
        for numbers, wkb in shape_rows(shapes, index, *task, bbox):
            if not len(numbers):
                continue
            columns = []
            if table:
                low, high = int(numbers[0]), int(numbers[-1]) + 1
                raw = np.frombuffer(table(before + low * width, (high - low) * width), np.uint8).reshape(-1, width)[numbers - low]
                keep = np.flatnonzero(raw[:, 0] != ord("*"))
                raw, wkb = raw[keep], [wkb[k] for k in keep]
                for field, _, at, length in fields:
                    columns.append(_values([r.tobytes() for r in raw[:, at : at + length]], field.dataType, encoding))
            yield [*columns, wkb]

    return _scan(spark, [(k, min(k + step, n)) for k in range(0, n, step)], [f for f, *_ in fields], crs_of_prj(_text(prj)) if prj else None, read)


# FlatGeobuf

# The format's column types, as (struct letter, Spark type); from String on, a length and bytes.
COLUMNS = [
    ("b", T.ByteType()), ("B", T.ShortType()), ("?", T.BooleanType()), ("h", T.ShortType()), ("H", T.IntegerType()), ("i", T.IntegerType()), ("I", T.LongType()), ("q", T.LongType()),
    ("Q", T.DecimalType(20, 0)), ("f", T.FloatType()), ("d", T.DoubleType()), ("", T.StringType()), ("", T.StringType()), ("", T.StringType()), ("", T.BinaryType()),
]


class Table:
    """A table of a flat buffer: fields by number, absent ones give the default."""

    def __init__(self, raw, at: int):
        self.raw, self.at = raw, at
        self.fields = at - struct.unpack_from("<i", raw, at)[0]
        self.end = self.fields + struct.unpack_from("<H", raw, self.fields)[0]

    def _where(self, k: int) -> int:
        place = self.fields + 4 + 2 * k
        own = struct.unpack_from("<H", self.raw, place)[0] if place < self.end else 0
        return self.at + own if own else 0

    def number(self, k: int, letter: str, default: int = 0):
        at = self._where(k)
        return struct.unpack_from(f"<{letter}", self.raw, at)[0] if at else default

    def _target(self, k: int) -> int:
        at = self._where(k)
        return at + struct.unpack_from("<I", self.raw, at)[0] if at else 0

    def array(self, k: int, kind: str) -> np.ndarray:
        at = self._target(k)
        return np.frombuffer(self.raw, kind, struct.unpack_from("<I", self.raw, at)[0], at + 4) if at else np.zeros(0, kind)

    def text(self, k: int) -> str:
        return self.array(k, "u1").tobytes().decode("utf-8", "replace")

    def table(self, k: int) -> Table | None:
        at = self._target(k)
        return Table(self.raw, at) if at else None

    def tables(self, k: int) -> list[Table]:
        at = self._target(k)
        places = [at + 4 + 4 * j for j in range(struct.unpack_from("<I", self.raw, at)[0])] if at else []
        return [Table(self.raw, p + struct.unpack_from("<I", self.raw, p)[0]) for p in places]


def _root(raw) -> Table:
    return Table(raw, struct.unpack_from("<I", raw)[0])


def _fgb_geometry(own: Table, kind: int) -> geo.Geometry:
    kind = kind or own.number(6, "B")
    points = own.array(1, "<f8").reshape(-1, 2)
    ends = own.array(0, "<u4").astype(np.int64)
    pieces = np.split(points, ends[:-1]) if len(ends) else [points] if len(points) else []
    if kind in (1, 2, 3):
        return geo.KINDS[kind], pieces
    if kind in (4, 5):
        return geo.KINDS[kind], [("point", [p.reshape(1, 2)]) for p in points] if kind == 4 else [("line", [p]) for p in pieces]
    if kind in (6, 7):
        return geo.KINDS[kind], [_fgb_geometry(p, 3 if kind == 6 else 0) for p in own.tables(7)]
    return "collection", []


class FlatGeobuf:
    """A file's header and where its tree and features are."""

    def __init__(self, fetch: Fetch):
        head = fetch(0, 12)
        if head[:4] != b"fgb\x03":
            raise ValueError("not a FlatGeobuf file of version 3")
        length = struct.unpack_from("<I", head, 8)[0]
        top = _root(fetch(12, length))
        self.kind, self.n, self.node = top.number(2, "B"), top.number(8, "Q"), top.number(9, "H", 16)
        self.columns = [(c.text(0), c.number(1, "B")) for c in top.tables(7)]
        crs = top.table(10)
        code = crs.number(1, "i") if crs else 0
        self.crs = f"{crs.text(0) or 'EPSG'}:{code}" if code else None
        self.tree = 12 + length
        self.counts: list[int] = []  # nodes of each level of the tree, leaves first
        if self.n and self.node > 1:
            self.counts = [self.n]
            while len(self.counts) < 2 or self.counts[-1] > 1:
                self.counts.append(-(-self.counts[-1] // self.node))
        self.features = self.tree + 40 * sum(self.counts)

    def nodes(self, fetch: Fetch, level: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(boxes, offsets) of nodes of a level; the root stands first in the file."""
        raw = np.frombuffer(fetch(self.tree + 40 * (sum(self.counts[level + 1 :]) + first), 40 * (last - first)), np.dtype([("box", "<f8", 4), ("at", "<u8")]))
        return raw["box"], raw["at"].astype(np.int64)

    def ranges(self, fetch: Fetch, box: Box | None) -> list[tuple[int, int]]:
        """Ranges of leaves that hold all features that meet the box."""
        if box is None:
            return [(0, self.n)]
        level = next(k for k, count in enumerate(self.counts) if count <= MOST_NODES)
        boxes, _ = self.nodes(fetch, level, 0, self.counts[level])
        span = self.node**level
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(_meets(boxes, box)).tolist():
            low, high = k * span, min((k + 1) * span, self.n)
            if out and out[-1][1] == low:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def raw(self, fetch: Fetch, first: int, last: int, box: Box | None, size: int) -> Iterator[list[memoryview]]:
        """The features of leaves first..last-1, some at a time."""
        for low in range(first, last, LEAVES):
            high = min(low + LEAVES, last)
            more = high < self.n  # the next leaf tells where the last feature ends
            boxes, at = self.nodes(fetch, 0, low, high + more)
            end = np.append(at[1:], at[-1] if more else size - self.features)[: high - low]
            at, boxes = at[: high - low], boxes[: high - low]
            odd = np.flatnonzero(end <= at)  # leaves that are not in the order of the features
            for k in odd:
                end[k] = at[k] + 4 + struct.unpack("<I", fetch(self.features + int(at[k]), 4))[0]
            keep = np.flatnonzero(_meets(boxes, box)) if box else np.arange(high - low)
            at, end = at[keep], end[keep]
            for a, b in _runs(at, end):
                data = memoryview(fetch(self.features + int(at[a]), int(end[b - 1] - at[a])))
                yield [data[p + 4 : p + 4 + struct.unpack_from("<I", data, p)[0]] for p in (at[a:b] - at[a]).tolist()]

    def stream(self, fetch: Fetch, size: int) -> Iterator[list[memoryview]]:
        at = self.features
        while at < size:
            length = struct.unpack("<I", fetch(at, 4))[0]
            data = memoryview(fetch(at, min(max(READ_BYTES, 4 + length), size - at)))
            found, p = [], 0
            while p + 4 <= len(data) and p + 4 + (length := struct.unpack_from("<I", data, p)[0]) <= len(data):
                found.append(data[p + 4 : p + 4 + length])
                p += 4 + length
            if not found:
                raise ValueError(f"a feature ends behind byte {size}")
            yield found
            at += p

    def rows(self, features: list[memoryview], box: Box | None) -> list[list]:
        columns: list[list] = [[None] * len(features) for _ in self.columns]
        shapes: list[bytes | None] = []
        keep = []
        for k, raw in enumerate(features):
            own = _root(raw)
            shape = own.table(0)
            g = None if shape is None else _fgb_geometry(shape, self.kind)
            bounds = geo.bounds(g) if box else None
            if box and (bounds is None or not _meets(np.array([bounds]), box)[0]):
                continue
            keep.append(k)
            shapes.append(None if g is None else geo.encode(g))
            values, p = own.array(1, "u1").tobytes(), 0
            while p < len(values):
                (column,) = struct.unpack_from("<H", values, p)
                letter, kind = COLUMNS[self.columns[column][1]]
                p += 2
                if letter:
                    (v,) = struct.unpack_from(f"<{letter}", values, p)
                    p += struct.calcsize(f"<{letter}")
                    v = decimal.Decimal(v) if letter == "Q" else v
                else:
                    (length,) = struct.unpack_from("<I", values, p)
                    v = values[p + 4 : p + 4 + length]
                    p += 4 + length
                    v = v if isinstance(kind, T.BinaryType) else v.decode("utf-8", "replace")
                columns[column][k] = v
        return [*[[c[k] for k in keep] for c in columns], shapes]


def read_flatgeobuf(spark: SparkSession, path: str, bbox: Box | None = None) -> DataFrame:
    """The features of a FlatGeobuf file; ``bbox`` keeps those whose box meets it."""
    size = _size(path)
    if size is None:
        raise ValueError(f"{path} is missing")
    fetch = opened(path)
    file = FlatGeobuf(fetch)
    fields = [T.StructField(name, COLUMNS[kind][1]) for name, kind in file.columns]
    tasks: list[list[tuple[int, int]]] = []
    if file.counts:
        share = max(1, file.n * TASK_BYTES // max(size - file.features, 1))
        free = 0
        for low, high in file.ranges(fetch, bbox):
            while low < high:
                if not free:
                    tasks.append([])
                    free = share
                take = min(free, high - low)
                tasks[-1].append((low, low + take))
                low, free = low + take, free - take
    elif size > file.features:
        tasks.append([])

    def read(task):
        source = opened(path)
        found = (part for low, high in task for part in file.raw(source, low, high, bbox, size)) if file.counts else file.stream(source, size)
        for part in found:
            yield file.rows(part, bbox)

    return _scan(spark, tasks, fields, file.crs, read)
