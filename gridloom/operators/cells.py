"""Cells of features: point lookup, polygon fill, line trace, hierarchy and compaction.

Geometries are never cut for a fill.  A polygon becomes rows of (feature, block
of up to 5,000 cells, the edges that matter there); these are spread over the
cluster, so one huge polygon is work for all executors, each cell centre is tested
exactly once, and all rows of a polygon together hold little more than its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import a5, geohash, geometry as geo, h3, rhealpix, s2
from gridloom.types import DEFAULT_CELLS_PER_PIECE, GEOMETRY, RESOLUTIONS, check_resolution, column_name, parent_resolution

GRIDS = {"geohash": geohash, "s2": s2, "rhp": rhealpix, "h3": h3}


def grid(dggs: str):
    """The grid's module, with its positions on the sphere."""
    if dggs == "a5":
        raise ImportError("positions on A5 need its projection, which this version has not; parent, children, representative, compaction and expansion of A5 cells work; other grids: " + ", ".join(sorted(GRIDS)))
    return hierarchy(dggs)


def hierarchy(dggs: str):
    """The grid's module; of A5 only the arithmetic of its ids."""
    if dggs == "a5":
        return a5
    if dggs not in GRIDS:
        raise ValueError(f"unknown grid {dggs!r}; known: {', '.join(sorted([*GRIDS, 'a5']))}")
    return GRIDS[dggs]


def _near(module, cells: np.ndarray, level: int, middle: np.ndarray, reach: float) -> np.ndarray:
    """Cells whose circle meets the circle around ``middle``."""
    angle = np.arccos(np.clip(module.middle(cells, level) @ middle, -1, 1))
    return cells[angle <= reach + module.radius(level) + 1e-12]


def _divided(module, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of cells, and for each the number of its parent."""
    own = np.arange(len(cells))
    if module is h3:
        five = h3.are_pentagons(cells[:, 0])
        return module.divide(cells), np.concatenate([own if d != 1 else own[~five] for d in range(7)])
    kids = module.divide(cells)
    return kids, np.tile(own, len(kids) // max(1, len(cells)))


def _cap(rings: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
    """(centre, radius) of a circle that holds the positions, and the positions as unit vectors."""
    p = s2.xyz(*np.concatenate(rings).T)
    middle = p.mean(0)
    middle = middle / n if (n := np.linalg.norm(middle)) > 1e-9 else p[0]
    reach = float(np.arccos(np.clip(p @ middle, -1, 1)).max())
    return middle, reach, p


def _box_cap(rings: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """A circle that holds the longitude-latitude box of the rings."""
    p = np.concatenate(rings)
    (x0, y0), (x1, y1) = p.min(0), p.max(0)
    if x1 - x0 > 120 or y1 - y0 > 120:
        return np.array([0.0, 0.0, 1.0]), float(np.pi)
    edge = np.linspace(0, 1, 17)
    ring = np.concatenate([np.stack([x0 + edge * (x1 - x0), np.full(17, y)], 1) for y in (y0, (y0 + y1) / 2, y1)] + [np.stack([np.full(17, x), y0 + edge * (y1 - y0)], 1) for x in (x0, x1)])
    middle, reach, _ = _cap([ring])
    return middle, reach * 1.02 + 1e-9


class Flat:
    """The plane of a polygon's edges: longitude and latitude, or for great-circle edges the gnomonic one about its middle."""

    def __init__(self, module, rings: list[np.ndarray]):
        self.west = None  # where the plane begins, if a ring crosses 180 degrees
        if module is h3:
            around, crosses, polar = geo.unwrapped(rings)
            if crosses:
                rings, self.west = around, -180.0 if polar else float(around[0][:, 0].min())
        self.middle, self.reach = _cap(rings)[:2] if module is s2 else _box_cap(rings)
        # A polygon beyond 85 degrees of its middle does not fit the gnomonic plane; its edges are taken on the other one.
        self.gnomonic = module is s2 and self.reach <= np.radians(85)
        self.rings = rings

    def head(self) -> np.ndarray:
        return np.array([self.gnomonic, np.nan if self.west is None else self.west, self.reach, *self.middle], float)

    @classmethod
    def of(cls, head: np.ndarray) -> Flat:
        out = cls.__new__(cls)
        out.gnomonic, out.west, out.reach, out.middle = bool(head[0]), None if np.isnan(head[1]) else head[1], head[2], head[3:6]
        return out

    def xy(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plane positions of unit vectors; those behind a gnomonic plane have none."""
        if not self.gnomonic:
            lon, lat = s2.lonlat(p)
            return lon if self.west is None else self.west + (lon - self.west) % 360, lat
        east = np.cross([0.0, 0.0, 1.0], self.middle)
        east = east / n if (n := np.linalg.norm(east)) > 1e-9 else np.array([1.0, 0.0, 0.0])
        depth = p @ self.middle
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (p @ east) / depth, (p @ np.cross(self.middle, east)) / depth
        return np.where(depth > 1e-9, x, np.nan), np.where(depth > 1e-9, y, np.nan)

    def edges(self) -> np.ndarray:
        return geo.edges_of([np.stack(self.xy(s2.xyz(*r.T)), 1) for r in self.rings] if self.gnomonic else self.rings)

    def box(self, centre: np.ndarray, angle: float) -> tuple[float, float, float, float] | None:
        """A box of the plane around a circle on the sphere; none where the circle has none of use."""
        if angle > 0.5 or not self.gnomonic and (abs(centre[2]) > 0.99 or self.west is None and np.arctan2(np.hypot(centre[1], 0), -centre[0]) < 2 * angle / max(1e-9, np.hypot(*centre[:2]))):
            return None
        side = np.cross(centre, [1.0, 0.0, 0.0] if abs(centre[0]) < 0.9 else [0.0, 1.0, 0.0])
        side /= np.linalg.norm(side)
        turn = np.linspace(0, 2 * np.pi, 33)[:, None]
        angle *= 1.05
        x, y = self.xy(np.cos(angle) * centre + np.sin(angle) * (np.cos(turn) * side + np.sin(turn) * np.cross(centre, side)))
        if np.isnan(x).any() or self.gnomonic and max(np.abs(x).max(), np.abs(y).max()) > 50 or self.west is not None and np.ptp(x) > 180:
            return None
        mx, my = 0.02 * np.ptp(x), 0.02 * np.ptp(y)
        return x.min() - mx, y.min() - my, x.max() + mx, y.max() + my


def blocks(module, rings: list[np.ndarray], res: int) -> Iterator[tuple[list[int], bytes]]:
    """(block, what its fill needs) for blocks of cells that may hold centres inside the polygon; blocks wholly outside are left out."""
    if module is geohash:
        edges, band, local = geo.edges_of(rings), None, None
        p = np.concatenate(rings)
        nx, ny = geohash._bits(res)
        x = lambda k: k * 360 / (1 << nx) - 180
        y = lambda k: k * 180 / (1 << ny) - 90
        for t in geohash.tiles((*p.min(0), *p.max(0)), res, DEFAULT_CELLS_PER_PIECE):  # row by row
            if t[1] != band:
                band, local = t[1], geo.near_edges(edges, (-np.inf, y(t[1]), np.inf, y(t[3] + 1)))
            if len(own := geo.near_edges(local, (x(t[0]), y(t[1]), x(t[2] + 1), y(t[3] + 1)))):
                yield list(t), own.tobytes()
        return
    # Down the hierarchy each cell takes from its parent's edges those that matter to it; a cell that none matters to is outside.
    flat = Flat(module, rings)
    edges, head = flat.edges(), flat.head()
    cells, level, want = module.roots(), 0, res - (6 if module is s2 else 4)
    local = [edges] * len(cells)
    while len(cells):
        keep, kept = [], []
        angle = np.arccos(np.clip((centre := module.middle(cells, level)) @ flat.middle, -1, 1))
        for k in np.flatnonzero(angle <= flat.reach + module.radius(level) + 1e-12).tolist():
            box = flat.box(centre[k], module.radius(level))
            if len(own := local[k] if box is None else geo.near_edges(local[k], box)):
                keep.append(k)
                kept.append(own)
        cells = cells[keep]
        if level >= want:
            for cell, own in zip(cells.tolist(), kept, strict=True):
                yield [level, *cell], np.concatenate([head, own.ravel()]).tobytes()
            return
        if len(cells):
            cells, parent = _divided(module, cells)
            local = [kept[k] for k in parent.tolist()]
        level += 1


def fill_block(module, block: list[int], need: bytes, res: int) -> np.ndarray:
    """Names of the block's cells whose centre is inside the polygon."""
    numbers = np.frombuffer(need, float)
    if module is geohash:
        x, y, name = geohash.tile_cells(tuple(block), res)
        return name[geo.within(numbers.reshape(-1, 4), x, y)]
    flat, edges = Flat.of(numbers[:6]), numbers[6:].reshape(-1, 4)
    level, *cell = block
    cells = np.array([cell], np.int64)
    while level < res and len(cells):
        cells, level = _near(module, module.divide(cells), level + 1, flat.middle, flat.reach), level + 1
    if not len(cells):
        return np.zeros(0, str)
    x, y = flat.xy(module.middle(cells, res))
    if module is rhealpix:  # centres on the cut at 180 degrees come out a rounding beside it
        x = np.where(180 - np.abs(x) < 1e-9, np.copysign(180.0, x), x)
    front = ~np.isnan(x)
    cells = cells[front]
    return module.named(cells[geo.within(edges, x[front], y[front])], res) if len(cells) else np.zeros(0, str)


def trace(module, line: np.ndarray, res: int) -> list[str]:
    """Distinct cells along a line, in order of first visit."""
    if len(line) == 1:
        return module.encode(line[:, 0], line[:, 1], res).tolist()
    if module is s2:
        return sorted(_cover_lines([line], res)[0])
    if module is h3:
        out: dict[str, None] = {}
        for a, b in zip(line[:-1], line[1:], strict=True):
            out.update(dict.fromkeys(h3.path(tuple(a), tuple(b), res)))
        return h3.named(np.array(list(out), np.int64)[:, None], res).tolist()
    return traces(module, [line], res)[0]


def traces(module, lines: list[np.ndarray], res: int) -> list[list[str]]:
    """``trace`` of every line; many are traced together."""
    out: list[list[str]] = []
    if module in (geohash, rhealpix):
        for k in range(0, len(lines), 2048):
            own = lines[k : k + 2048]
            segment, cells = module.named_paths(np.concatenate([line[:-1] for line in own]), np.concatenate([line[1:] for line in own]), res)
            ends = np.searchsorted(segment, np.cumsum([len(line) - 1 for line in own])).tolist()
            names = cells.tolist()
            out += [list(dict.fromkeys(names[i:j])) if len(line) > 1 else trace(module, line, res) for line, i, j in zip(own, [0, *ends[:-1]], ends, strict=True)]
        return out
    if module is h3:
        for k in range(0, len(lines), 2048):
            own = lines[k : k + 2048]
            found = iter(h3.paths(np.concatenate([line[:-1] for line in own]), np.concatenate([line[1:] for line in own]), res))
            for line in own:
                cells = dict.fromkeys(c for _ in line[1:] for c in next(found))
                out.append(h3.named(np.array(list(cells), np.int64)[:, None], res).tolist() if cells else trace(module, line, res))
        return out
    for k in range(0, len(lines), 256):
        out += [sorted(found) for found in _cover_lines(lines[k : k + 256], res)]
    return out


def _cover_lines(lines: list[np.ndarray], res: int) -> list[set[str]]:
    """For each line all S2 cells at ``res`` that it, of great-circle edges, meets."""
    found: list[set[str]] = [set() for _ in lines]
    owner, ends = [], []
    for k, line in enumerate(lines):
        p = s2.xyz(line[:, 0], line[:, 1])
        for a, b in zip(p[:-1], p[1:], strict=True):
            angle = float(np.arccos(np.clip(a @ b, -1, 1)))
            if angle < 1e-15:
                continue
            n = int(np.ceil(angle / np.radians(10)))
            t = np.linspace(0, 1, n + 1)[:, None]
            knots = (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)
            knots[0], knots[-1] = a, b
            owner += [k] * n
            ends.append(np.stack([knots[:-1], knots[1:]], 1))
    for k in sorted(set(range(len(lines))) - set(owner)):  # lines of no length
        found[k] = set(s2.encode(lines[k][:, 0], lines[k][:, 1], res).tolist())
    if not owner:
        return found
    u, v = np.concatenate(ends).transpose(1, 0, 2)
    middle = (u + v) / np.linalg.norm(u + v, axis=1, keepdims=True)
    half = np.arccos(np.clip((u * middle).sum(1), -1, 1))
    normal = np.cross(u, v)
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    cells, arc = np.tile(s2.roots(), (len(u), 1)), np.repeat(np.arange(len(u)), 6)
    for level in range(res + 1):
        if level:
            cells, arc = s2.divide(cells), np.tile(arc, 4)
        centre = s2.middle(cells, level)
        angle = np.arccos(np.clip((centre * middle[arc]).sum(1), -1, 1))
        away = np.abs(np.arcsin(np.clip((centre * normal[arc]).sum(1), -1, 1)))
        near = (angle <= half[arc] + s2.radius(level) + 1e-12) & (away <= s2.radius(level) + 1e-12)
        cells, arc = cells[near], arc[near]
    met = s2.meets(cells, res, u[arc], v[arc])
    for k, name in zip(arc[met].tolist(), s2.named(cells[met], res).tolist(), strict=True):
        found[owner[k]].add(name)
    return found


def polyfill(df: DataFrame, dggs: str, res: int, partitions: int | None = None, mode: str = "centre") -> DataFrame:
    """A row for each (feature, cell): the cells of every point, line and polygon of ``df``; ``geometry`` goes.

    Expects cleaned parts (see ``prepare.cleaned``).  Repeated rows of one feature's parts are made one.  With mode
    ``intersects`` (S2 only) a polygon has all cells it meets: those whose centre is inside and those its rings cross.
    """
    if mode not in ("centre", "intersects") or mode == "intersects" and dggs != "s2":
        raise ValueError(f"mode {mode!r} is not one of {dggs}")
    module, name = grid(dggs), column_name(dggs, check_resolution(dggs, res))
    at = df.columns.index(GEOMETRY)
    keep = [k for k in range(len(df.columns)) if k != at]
    fields = [df.schema.fields[k] for k in keep]
    own = [T.StructField("_block", T.ArrayType(T.LongType())), T.StructField("_need", T.BinaryType())]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, needs, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                taken = batch.take(pa.array(rows, pa.int64()))
                return pa.record_batch([*[taken.column(k) for k in keep], pa.array(out, pa.list_(pa.int64())), pa.array(needs, pa.binary())], names=[*[batch.schema.names[k] for k in keep], "_block", "_need"])

            for k, raw in enumerate(batch.column(at).to_pylist()):
                for part in geo.flat(geo.decode(raw)):
                    edge = [([], geo.encode(("line", [geo.closed(r)]))) for r in part[1]] if mode == "intersects" and part[0] == "polygon" else []
                    for b, need in [*edge, *blocks(module, part[1], res)] if part[0] == "polygon" else [([], geo.encode(part))]:
                        rows.append(k)
                        out.append(b)
                        needs.append(need)
                        size += len(need) + 100
                        if size > 1 << 24:
                            yield made()
                            rows, out, needs, size = [], [], [], 0
            yield made()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            lines: list[tuple[int, np.ndarray]] = []
            for k, (block, need) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)):
                if block:
                    found = fill_block(module, block, need, res).tolist()
                    rows += [k] * len(found)
                    out += found
                else:
                    lines.append((k, geo.decode(need)[1][0]))
            for (k, _), found in zip(lines, traces(module, [line for _, line in lines], res), strict=True):
                rows += [k] * len(found)
                out += found
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([pa.array(out, pa.string()), *[taken.column(k) for k in range(len(keep))]], names=[name, *batch.schema.names[: len(keep)]])

    spread = df.mapInArrow(tiles, T.StructType([*fields, *own]))
    # Round robin: a block's cost does not show in its bytes, so partitions must not be coalesced by size.
    spread = spread.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField(name, T.StringType()), *fields])
    return spread.mapInArrow(cells, schema).dropDuplicates()


def point_cells(df: DataFrame, lon: Column, lat: Column, dggs: str, res: int) -> DataFrame:
    """``df`` with the cell of a position: expressions only, no Python on the executors."""
    return df.withColumn(column_name(dggs, check_resolution(dggs, res)), grid(dggs).point(lon, lat, res))


def with_parent(cells: DataFrame, dggs: str, res: int, parent: int | None = None) -> DataFrame:
    parent = parent_resolution(dggs, res, parent)
    return cells.withColumn(column_name(dggs, parent), hierarchy(dggs).parent(F.col(column_name(dggs, res)), parent))


def leaves(module, cell: Column, from_res: int, res: int) -> Column | int:
    """The number of descendants of a cell; on H3, pentagons have fewer."""
    return module.leaves_of(cell, from_res, res) if module is h3 else module.leaf_count(from_res, res)


def dealt(rows: DataFrame, key: str, grown: int) -> DataFrame:
    """``rows`` by ``key``, in as many partitions as keep each near a million rows once every row has become ``grown``.

    For rows that are about to be multiplied: a small file is one task, whatever comes of its rows.  Partitions are
    never fewer than the cores, and their number grows with the table (one count), so a task's share does not.
    """
    n = -(-rows.count() * grown // 1_000_000)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), key)


def compact(cells: DataFrame, dggs: str, res: int, parent: int, id_field: str, placed: bool = False) -> DataFrame:
    """Complete sibling sets of each feature merge upward, not beyond ``parent``.

    A leaf's result is its coarsest ancestor all of whose leaves are present for
    the same id.  The row of the ancestor's representative leaf stays and carries
    the ancestor; the other merged rows go, level by level.  One exchange, on the
    parent and the id, and one sort, by the ancestors from the coarsest, serve the
    windows of all levels; null ids and cells go.  Rows that are ``placed``, in
    partitions by the id (see ``dealt``), are not exchanged.
    """
    module, name, parent_name = hierarchy(dggs), column_name(dggs, res), column_name(dggs, parent)
    rows = cells.where(F.col(id_field).isNotNull() & F.col(name).isNotNull())
    if parent_name not in rows.columns:
        rows = rows.withColumn(parent_name, module.parent(F.col(name), parent))
    columns = rows.columns
    if not placed:
        rows = rows.repartition(parent_name, id_field)
    ups = {parent: parent_name} | {k: f"_up{k}" for k in range(parent + 1, res)}
    rows = rows.withColumns({up: module.parent(F.col(name), k) for k, up in ups.items() if k > parent})
    keys = lambda k: [id_field, *[up for at, up in ups.items() if at <= k]]
    first = F.row_number().over(Window.partitionBy(*keys(res), name).orderBy(F.lit(0)))
    # Merged so far: a row stands for a whole cell of the level above its last window.
    rows = rows.withColumns({"_first": (first == 1).cast("int"), "_whole": F.lit(True), "_out": F.col(name)})
    for k in range(res - 1, parent - 1, -1):
        up = F.col(ups[k])
        n = F.sum(F.when(F.col("_whole"), F.col("_first"))).over(Window.partitionBy(*keys(k)))
        rows = rows.withColumn("_whole", F.col("_whole") & (F.coalesce(n, F.lit(0)) == leaves(module, up, k, k + 1)))
        rows = rows.where(F.when(F.col("_whole"), module.representative(up, res) == F.col(name)).otherwise(True))
        rows = rows.withColumn("_out", F.when(F.col("_whole"), up).otherwise(F.col("_out")))
    return rows.withColumn(name, F.col("_out")).select(*columns)


def compact_all(cells: DataFrame, dggs: str, id_field: str, finest: int | None = None, placed: bool = False) -> DataFrame:
    """(id, cell): complete sibling sets merged to the coarsest level, whatever the levels of the input.

    One exchange, on the id and the coarsest ancestor, beyond which nothing merges, and one sort, by the ancestors from the
    coarsest, serve the windows of all levels.  ``finest`` is the finest level that occurs, if the caller knows it (a finer
    cell is an error then); levels below it have no windows.  ``placed``: see ``compact``.
    """
    module = hierarchy(dggs)
    low, high = RESOLUTIONS[dggs].low, RESOLUTIONS[dggs].high if finest is None else check_resolution(dggs, finest)
    rows = cells.where("cell is not null").select(id_field, "cell", module.parent(F.col("cell"), low).alias("_up0"), module.resolution(F.col("cell")).cast("int").alias("_level"))
    if finest is not None:
        rows = rows.withColumn("_level", F.when(F.col("_level") <= high, F.col("_level")).otherwise(F.raise_error(F.concat(F.lit(f"finer than level {high}: "), F.col("cell"))).cast("int")))
    if not placed:
        rows = rows.repartition(id_field, "_up0")
    # A cell is its own ancestor at its level, so it lies in one window with its children; it has none at finer levels.
    rows = rows.withColumns({f"_up{k - low}": F.when(F.col("_level") > k, module.parent(F.col("cell"), k)).when(F.col("_level") == k, F.col("cell")) for k in range(low + 1, high)})
    keys = lambda k: [id_field, *[f"_up{at}" for at in range(k - low + 1)]]
    first = F.row_number().over(Window.partitionBy(*keys(high - 1), "cell").orderBy(F.lit(0)))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    for k in range(high - 1, low - 1, -1):
        up = F.col(f"_up{k - low}")
        whole = Window.partitionBy(*keys(k))
        child = F.col("_level") == k + 1
        rows = rows.withColumns({"_n": F.count(F.when(child, True)).over(whole), "_own": F.count(F.when(F.col("_level") == k, True)).over(whole)})
        full = child & (F.col("_n") == leaves(module, up, k, k + 1))
        # Of a whole set one row stays, unless the cell itself is there already.
        rows = rows.withColumn("_full", full).where(F.when(F.col("_full"), (F.col("_own") == 0) & (module.representative(up, k + 1) == F.col("cell"))).otherwise(True))
        rows = rows.withColumns({"cell": F.when(F.col("_full"), up).otherwise(F.col("cell")), "_level": F.when(F.col("_full"), F.lit(k)).otherwise(F.col("_level"))})
    return rows.select(id_field, "cell")


def expand(cells: DataFrame, dggs: str, res: int, column: str) -> DataFrame:
    """Every cell replaced by its descendants at ``res`` (a row for each); the inverse of compaction."""
    module = hierarchy(dggs)
    level = module.resolution(F.col(column))
    out = F.array(F.col(column))
    for k in range(RESOLUTIONS[dggs].low, res):
        out = F.when(level == k, module.children(F.col(column), k, res)).otherwise(out)
    rest = [F.explode(out).alias(column) if c == column else F.col(c) for c in cells.columns]
    return cells.select(*rest)


def cell_geometry(cells: DataFrame, dggs: str, column: str, mode: str) -> DataFrame:
    """``cells`` with a WKB ``geometry``: the cell's centre (point), its outline (polygon) or none."""
    if mode == "none":
        return cells
    if mode not in ("point", "polygon"):
        raise ValueError(f"geometry mode must be none, point or polygon, not {mode!r}")
    module, at = grid(dggs), cells.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(at).to_pylist()
            if mode == "point":
                raw = [geo.encode(("point", [np.array([p])])) for p in zip(*module.centers(names), strict=True)]
            else:
                raw = [geo.encode(("polygon", [module.boundary(c)])) for c in names]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, GEOMETRY])

    schema = T.StructType([*cells.schema.fields, T.StructField(GEOMETRY, T.BinaryType())])
    return cells.where(F.col(column).isNotNull()).mapInArrow(run, schema)


def morton(lon: Column, lat: Column, bits: int = 16) -> Column:
    """A sort key that keeps near positions together: interleaved bits."""
    x = F.least(F.floor((lon + 180.0) / 360.0 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k + 1) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k)
    return out


#: A cell with more points than this, and than one in MOST_PLACES of all, is taken apart by the join below.
CROWD, MOST_PLACES = 100_000, 4096
#: Levels that a crowded cell is taken apart by, and points that meet a polygon's edges together.
DEEPER, BLOCK = 4, 256


def crowds(placed: DataFrame, n: int, res: int, deepest: int) -> dict[str, int]:
    """Crowded geohash cells of ``placed(deep)`` at levels res..deepest, with how often each is crowded; at most MOST_PLACES a level."""
    most = max(CROWD, n // MOST_PLACES)
    if n <= most:
        return {}
    counted = placed.groupBy("deep").agg(F.count("*").alias("k"))
    levels = F.explode(F.array(*[F.substring("deep", 1, level) for level in range(res, deepest + 1)]))
    rows = counted.select(levels.alias("cell"), "k").groupBy("cell").agg(F.sum("k").alias("k")).where(F.col("k") > most).collect()
    return {r.cell: -(-r.k // most) for r in rows}


def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", res: int = 4) -> DataFrame:
    """Pairs of rows of ``points(lon, lat, ...)`` and ``polygons(geometry, ...)`` where the point is strictly inside.

    Both sides meet by geohash cell: a polygon has one row for each cell that it may reach into, with the edges of each of its parts
    that matter there, so the test of a pair costs those edges only and no pair comes twice; repeated rows of either side each have
    their pairs.  A crowded cell is taken apart, level by level, on both sides; if it is still crowded ``DEEPER`` levels below, as many
    equal points are, its points are dealt to several copies of its polygons' rows.  Points go in blocks of one cell, so edges are sent
    once for each block and not with each point.  Columns of both sides stay under their names, but for the geometry.
    """
    at = polygons.columns.index(GEOMETRY)
    keep = [k for k in range(len(polygons.columns)) if k != at]
    deepest = min(res + DEEPER, RESOLUTIONS["geohash"].high)
    x, y = (points[c].cast("double") for c in (lon, lat))
    # Columns go by number meanwhile, as both sides may have the same names.
    placed = points.where(x.isNotNull() & y.isNotNull()).select(*[points[c].alias(f"p{k}") for k, c in enumerate(points.columns)], x.alias("x"), y.alias("y"), geohash.point(x, y, deepest).alias("deep"))
    crowd = crowds(placed.select("deep"), points.count(), res, deepest)
    copies = {c: k for c, k in crowd.items() if len(c) == deepest}

    def parts_of(edges: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> Iterator[tuple[str, bytes]]:
        nx, ny = geohash._bits(level)
        for name, a, b in zip(geohash.names(i, j, level), i.tolist(), j.tolist(), strict=True):
            # Positions beyond the limits belong to the outermost cells, so these have no end there.
            west, east = (a * 360 / (1 << nx) - 180 if a else -np.inf), ((a + 1) * 360 / (1 << nx) - 180 if a + 1 < 1 << nx else np.inf)
            south, north = (b * 180 / (1 << ny) - 90 if b else -np.inf), ((b + 1) * 180 / (1 << ny) - 90 if b + 1 < 1 << ny else np.inf)
            own = geo.near_edges(edges, (west, south, east, north))
            if not len(own):
                continue
            if name not in crowd or level == deepest:
                yield name, own.tobytes()
                continue
            dx, dy = (1 << (m - n) for m, n in zip(geohash._bits(level + 1), (nx, ny), strict=True))
            u, v = np.meshgrid(np.arange(a * dx, (a + 1) * dx), np.arange(b * dy, (b + 1) * dy))
            yield from parts_of(own, u.ravel(), v.ravel(), level + 1)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(at).to_pylist()):
                needs: dict[str, list[bytes]] = {}
                for kind, parts in geo.flat(geo.decode(raw)):
                    if kind != "polygon":
                        continue
                    edges, p = geo.edges_of(parts), np.concatenate(parts)
                    for t in geohash.tiles((*p.min(0), *p.max(0)), res, 1):
                        for name, own in parts_of(edges, np.array([t[0]]), np.array([t[1]]), res):
                            needs.setdefault(name, []).append(own)
                rows = [(name, salt) for name in needs for salt in range(copies.get(name, 1))]
                taken = batch.take(pa.array([k] * len(rows), pa.int64()))
                yield pa.record_batch([*[taken.column(j) for j in keep], pa.array([name for name, _ in rows], pa.string()), pa.array([salt for _, salt in rows], pa.int32()), pa.array([needs[name] for name, _ in rows], pa.list_(pa.binary()))], names=[*[batch.schema.names[j] for j in keep], "cell", "salt", "need"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column("cell").to_pylist())  # sorted
            begins = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            cuts = np.array([c for a, b in zip(begins, [*begins[1:], len(names)], strict=True) for c in range(a, b, BLOCK)])
            offsets = pa.array(np.append(cuts, len(names)), pa.int32())
            first = names[cuts].tolist()
            salts = [(turn + k) % copies.get(c, 1) for k, c in enumerate(first)]
            turn += len(first)
            rest = [n for n in batch.schema.names if n != "cell"]
            yield pa.record_batch([*[pa.ListArray.from_arrays(offsets, batch.column(n)) for n in rest], pa.array(first), pa.array(salts, pa.int32())], names=[*rest, "cell", "salt"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            starts = xs.offsets.to_numpy() - xs.offsets[0].as_py()
            flat_x, flat_y = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys))
            member, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, needs in enumerate(batch.column("need").to_pylist()):
                own = slice(starts[k], starts[k + 1])
                found = np.zeros(own.stop - own.start, bool)
                for need in needs:
                    found |= geo.within(np.frombuffer(need, float).reshape(-1, 4), flat_x[own], flat_y[own])
                hits = np.flatnonzero(found)
                member.append(hits + own.start)
                row.append(np.full(len(hits), k))
            member, row = pa.array(np.concatenate(member)), pa.array(np.concatenate(row))
            yield pa.record_batch([*[batch.column(n).flatten().take(member) for n in left], *[batch.column(n).take(row) for n in right]], names=[*left, *right])

    left, right = [f"p{k}" for k in range(len(points.columns))], [f"q{k}" for k in keep]
    cover = polygons.toDF(*[f"q{k}" for k in range(len(polygons.columns))])
    own = [cover.schema.fields[k] for k in keep]
    cover = cover.mapInArrow(tiles, T.StructType([*own, T.StructField("cell", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("need", T.ArrayType(T.BinaryType()))]))
    cell = F.substring("deep", 1, res)
    for level in range(res, deepest):
        if names := [c for c in crowd if len(c) == level]:
            # At most MOST_PLACES rows.
            apart = F.broadcast(placed.sparkSession.createDataFrame([(c,) for c in names], f"at{level} string"))
            placed = placed.join(apart, F.substring("deep", 1, level) == F.col(f"at{level}"), "left")
            cell = F.when(F.col(f"at{level}").isNotNull(), F.substring("deep", 1, level + 1)).otherwise(cell)
    placed = placed.select(*left, "x", "y", cell.alias("cell"))
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in placed.schema.fields[:-1]]
    packed = placed.sortWithinPartitions("cell").mapInArrow(packs, T.StructType([*lists, T.StructField("cell", T.StringType()), T.StructField("salt", T.IntegerType())]))
    met = packed.join(cover, ["cell", "salt"])
    out = met.mapInArrow(test, T.StructType([*[T.StructField(n, placed.schema[n].dataType) for n in left], *own]))
    return out.toDF(*points.columns, *[polygons.columns[k] for k in keep])


def ancestor(dggs: str, cell: str, res: int, parent: int) -> str:
    """The ancestor of one cell, on the driver."""
    if dggs == "geohash":
        return cell[:parent]
    if dggs == "rhp":
        return cell[: parent + 1]
    if dggs == "a5":
        return a5.ancestor(cell, parent)
    if dggs == "h3":
        return f"{int(cell, 16) & ~(15 << 52) | parent << 52 | (1 << (3 * (15 - parent))) - 1:x}"
    face, i, j, _ = s2.split(cell)
    return s2.names(np.array([face]), np.array([i >> (res - parent)]), np.array([j >> (res - parent)]), parent)[0]


def cells_in(table: DataFrame, dggs: str, res: int, parent: int, wanted: list[str]) -> DataFrame:
    """Rows of the wanted cells, with the derived predicate on the parent so that only their partitions are read."""
    ups = sorted({ancestor(dggs, c, res, parent) for c in wanted})
    return table.where(F.col(column_name(dggs, parent)).isin(ups) & F.col(column_name(dggs, res)).isin(list(wanted)))
