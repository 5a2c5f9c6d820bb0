"""Geohash cells: column expressions, and numpy kernels for fills and traces."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guard import finer

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
NAME, GEODESIC = "geohash", False


def _bits(res: int) -> tuple[int, int]:
    return (5 * res + 1) // 2, 5 * res // 2


# -- column expressions -------------------------------------------------------------------------


def _axis(value: Column, low: float, span: float, bits: int) -> Column:
    """The cell number on one axis; the upper edge belongs to the last cell."""
    return F.least(F.greatest(F.floor((value - low) / span * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def point(lon: Column, lat: Column, res: int) -> Column:
    nx, ny = _bits(res)
    x, y = _axis(lon, -180.0, 360.0, nx), _axis(lat, -90.0, 180.0, ny)
    letters = []
    for k in range(res):
        code = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            axis, place = (x, nx - 1 - b // 2) if b % 2 == 0 else (y, ny - 1 - b // 2)
            code = code + F.shiftleft(F.shiftright(axis, place).bitwiseAND(F.lit(1)), 4 - (b - 5 * k))
        letters.append(F.substring(F.lit(ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(*letters))


def resolution(cell: Column) -> Column:
    return F.length(cell)


def parent(cell: Column, res: int) -> Column:
    return F.substring(cell, 1, res)


def representative(cell: Column, res: int) -> Column:
    """The first descendant at ``res``; an error for a cell that is not coarser."""
    return finer(resolution(cell), res, F.rpad(cell, res, ALPHABET[0]))


def children(cell: Column, from_res: int, res: int) -> Column:
    """All descendants at ``res`` of a cell at ``from_res`` (itself if not coarser)."""
    out = F.array(cell)
    letters = F.split(F.lit(",".join(ALPHABET)), ",")
    for _ in range(res - from_res):
        out = F.flatten(F.transform(out, lambda c: F.transform(letters, lambda x: F.concat(c, x))))
    return out


def leaf_count(from_res: int, res: int) -> int:
    return 32 ** (res - from_res)


def _number(cell: Column, axis: int, res: int) -> Column:
    """The cell number on an axis (0: longitude, 1: latitude) of a cell at ``res``."""
    out = F.lit(0).cast("long")
    for b in range(5 * res):
        if b % 2 == axis:
            code = F.instr(F.lit(ALPHABET), F.substring(cell, b // 5 + 1, 1))
            out = F.shiftleft(out, 1) + F.shiftright((code - 1).cast("int"), 4 - b % 5).bitwiseAND(F.lit(1))
    return out


def bounds(cell: Column, res: int) -> Column:
    """struct<minx, miny, maxx, maxy> of a cell at ``res``."""
    nx, ny = _bits(res)
    x, y = _number(cell, 0, res), _number(cell, 1, res)
    w, h = 360.0 / (1 << nx), 180.0 / (1 << ny)
    return F.struct((x * w - 180.0).alias("minx"), (y * h - 90.0).alias("miny"), ((x + 1) * w - 180.0).alias("maxx"), ((y + 1) * h - 90.0).alias("maxy"))


def center(cell: Column, res: int) -> Column:
    """struct<lon, lat>."""
    nx, ny = _bits(res)
    w, h = 360.0 / (1 << nx), 180.0 / (1 << ny)
    return F.struct(((_number(cell, 0, res) + 0.5) * w - 180.0).alias("lon"), ((_number(cell, 1, res) + 0.5) * h - 90.0).alias("lat"))


# -- kernels ------------------------------------------------------------------------------------


def names(x: np.ndarray, y: np.ndarray, res: int) -> np.ndarray:
    nx, ny = _bits(res)
    code = np.zeros((len(x), res), np.int64)
    for b in range(5 * res):
        axis, place = (x, nx - 1 - b // 2) if b % 2 == 0 else (y, ny - 1 - b // 2)
        code[:, b // 5] |= ((axis >> place) & 1) << (4 - b % 5)
    return np.array(list(ALPHABET))[code].view(f"U{res}").ravel() if len(x) else np.zeros(0, f"U{res}")


def numbers(cells: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for c in cells:
        a = b = 0
        for k, ch in enumerate(c):
            code = ALPHABET.index(ch)
            for i in range(5):
                bit = code >> (4 - i) & 1
                if (5 * k + i) % 2 == 0:
                    a = a << 1 | bit
                else:
                    b = b << 1 | bit
        x.append(a)
        y.append(b)
    return np.array(x, np.int64), np.array(y, np.int64)


def locate(lon: np.ndarray, lat: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    nx, ny = _bits(res)
    x = np.clip(np.floor((lon + 180) / 360 * (1 << nx)), 0, (1 << nx) - 1).astype(np.int64)
    y = np.clip(np.floor((lat + 90) / 180 * (1 << ny)), 0, (1 << ny) - 1).astype(np.int64)
    return x, y


def encode(lon: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    return names(*locate(np.asarray(lon, float), np.asarray(lat, float), res), res)


def centers(cells: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lon, lat = np.zeros(len(cells)), np.zeros(len(cells))
    for res in {len(c) for c in cells}:
        at = [k for k, c in enumerate(cells) if len(c) == res]
        nx, ny = _bits(res)
        x, y = numbers([cells[k] for k in at])
        lon[at], lat[at] = (x + 0.5) * 360 / (1 << nx) - 180, (y + 0.5) * 180 / (1 << ny) - 90
    return lon, lat


def boundary(cell: str) -> np.ndarray:
    nx, ny = _bits(len(cell))
    (x,), (y,) = numbers([cell])
    w, h = 360 / (1 << nx), 180 / (1 << ny)
    a, b = x * w - 180, y * h - 90
    return np.array([(a, b), (a + w, b), (a + w, b + h), (a, b + h), (a, b)])


def tiles(box: tuple[float, float, float, float], res: int, most: int) -> list[tuple[int, int, int, int]]:
    """Blocks (x0, y0, x1, y1) of up to ``most`` cells whose centres may lie in the box."""
    nx, ny = _bits(res)
    (x0, x1), (y0, y1) = (locate(np.array([a, b]), np.array([c, d]), res)[k] for k, (a, b, c, d) in enumerate(((box[0], box[2], box[1], box[3]),) * 2))
    side = max(1, int(most**0.5))
    return [(x, y, min(x + side - 1, x1), min(y + side - 1, y1)) for y in range(int(y0), int(y1) + 1, side) for x in range(int(x0), int(x1) + 1, side)]


def tile_cells(tile: tuple[int, int, int, int], res: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lon, lat, name) of all cell centres of a tile."""
    nx, ny = _bits(res)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(tile[0], tile[2] + 1), np.arange(tile[1], tile[3] + 1)))
    return (x + 0.5) * 360 / (1 << nx) - 180, (y + 0.5) * 180 / (1 << ny) - 90, names(x, y, res)


#: Costs of a trace are whole numbers of 2^-30 degrees, so that equal ones are equal whatever their order of addition.
UNIT = 1 << 30
#: Room for the sum of a path's cell numbers, which decides between paths of equal cost.
TIES = 96


def searched(a: tuple[float, float], b: tuple[float, float], res: int) -> list[tuple[int, int]]:
    """Cell numbers of the cheapest 8-neighbour path between two points: each step costs 1 plus its centre's distance to the segment in degrees.

    Of paths of one cost it is the one with the least sum of cell numbers (counted eastwards, row by row from the south);
    so a segment has the same cells in both directions.

    The path is searched from both ends.  Half of a cell's cost belongs to the step to it and half to the one from it, which
    makes steps cost the same both ways, and both frontiers are ordered by their cost and half the difference of the steps
    to one end and the other.  So no step is cheaper than nothing in that order, and the search is over when the two
    least entries together are not below the best meeting.
    """
    nx, ny = _bits(res)
    (x0, x1), (y0, y1) = locate(np.array([a[0], b[0]]), np.array([a[1], b[1]]), res)
    ends = (int(x0), int(y0)), (int(x1), int(y1))
    # The first end is the one with the lower number, so that the distance to the segment is the same in both directions.
    turned = ends[0][::-1] > ends[1][::-1] or ends[0] == ends[1] and a > b
    if turned:
        a, b, ends = b, a, ends[::-1]
    w, h = 360 / (1 << nx), 180 / (1 << ny)
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    costs: dict[tuple[int, int], int] = {}

    def cost(c: tuple[int, int]) -> int:
        """Half of a step to the cell, doubled as all costs are, with its number below."""
        if c not in costs:
            px, py = (c[0] + 0.5) * w - 180 - a[0], (c[1] + 0.5) * h - 90 - a[1]
            t = min(1.0, max(0.0, (px * dx + py * dy) / length)) if length else 0.0
            ox, oy = px - t * dx, py - t * dy
            costs[c] = (UNIT + round(math.sqrt(ox * ox + oy * oy) * UNIT) << TIES) + (c[1] << nx | c[0])
        return costs[c]

    steps = lambda c, d: max(abs(c[0] - d[0]), abs(c[1] - d[1]))
    lead = lambda c, side: (steps(c, ends[1 - side]) - steps(c, ends[side])) * UNIT << TIES
    reached: tuple[dict, dict] = {ends[0]: 0}, {ends[1]: 0}
    via: tuple[dict, dict] = {}, {}
    heaps = [(lead(ends[0], 0), 0, ends[0])], [(lead(ends[1], 1), 0, ends[1])]
    best, meeting = (0, ends[0]) if ends[0] == ends[1] else (None, None)
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] >= best:
            break
        side = int(len(heaps[1]) < len(heaps[0]))
        own, other = reached[side], reached[1 - side]
        _, g, c = heapq.heappop(heaps[side])
        if g > own[c]:
            continue
        for n in ((c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
            if not (0 <= n[0] < 1 << nx and 0 <= n[1] < 1 << ny):
                continue
            k = g + cost(c) + cost(n)
            if k < own.get(n, k + 1):
                own[n], via[side][n] = k, c
                heapq.heappush(heaps[side], (k + lead(n, side), k, n))
                if n in other and (best is None or k + other[n] < best):
                    best, meeting = k + other[n], n
    path = [meeting]
    while path[-1] != ends[0]:
        path.append(via[0][path[-1]])
    path.reverse()
    while path[-1] != ends[1]:
        path.append(via[1][path[-1]])
    if turned:
        path.reverse()
    return path


#: Rows to either side of a column's cheapest cell that are tried where those cells make no path.
BAND = 3
#: Cells whose costs are held at a time.
CELLS = 1 << 19


def trace_segment(a: tuple[float, float], b: tuple[float, float], res: int) -> list[str]:
    """The cells of ``searched``, by name."""
    return named_paths(np.array([a], float), np.array([b], float), res)[1].tolist()


def named_paths(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell) of all segments of positions, in order: the path of ``searched`` for each, many at a time."""
    with np.errstate(invalid="ignore"):
        steps = np.max([abs(p - q) for p, q in zip(locate(*a.T, res), locate(*b.T, res), strict=True)], axis=0) if len(a) else np.zeros(0, np.int64)
    group = np.cumsum(steps.astype(float) + 1) // CELLS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(a)]
    found = [_paths(a[i:j], b[i:j], res, i) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    own, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return own, names(x, y, res)


def _paths(a: np.ndarray, b: np.ndarray, res: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment from ``begin`` on, cell numbers) of the cheapest paths.

    Along the axis on which the ends are further apart a path has a cell in every column, so it costs no less than the
    columns' cheapest cells.  In a column between the ends these are beside the place where the segment crosses its
    middle.  Where they are neighbours they are the path, and no other costs as little.  Where they are not, the best path of
    one cell a column is found among the rows near them.  It is the cheapest of all if it costs less than one cell
    more, less than any row further off and is the only one; segments for which this is not so are searched.
    """
    bits = np.array(_bits(res))
    size, low = np.array([360.0, 180.0]) / (1 << bits), np.array([180.0, 90.0])
    sound = np.isfinite(a).all(1) & np.isfinite(b).all(1)
    p, q = (np.stack(locate(*np.where(sound[:, None], e, 0.0).T, res), 1) for e in (a, b))
    turned = (q[:, 1] < p[:, 1]) | (q[:, 1] == p[:, 1]) & (q[:, 0] < p[:, 0])
    start, d = np.where(turned[:, None], b, a), np.where(turned[:, None], a - b, b - a)
    p, q = np.where(turned[:, None], q, p), np.where(turned[:, None], p, q)
    length = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
    steps, all_ = abs(q - p).max(1), np.arange(len(a))
    along = (abs(q - p)[:, 0] < abs(q - p)[:, 1]).astype(int)
    across = 1 - along
    ahead = np.sign(q - p)[all_, along]

    def away(k: np.ndarray, column: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The cost of a cell beyond that of a step, as ``searched`` has it."""
        x, y = np.where(along[k] == 0, column, row), np.where(along[k] == 0, row, column)
        px, py = (x + 0.5) * size[0] - 180 - start[k, 0], (y + 0.5) * size[1] - 90 - start[k, 1]
        t = np.minimum(1.0, np.maximum(0.0, (px * d[k, 0] + py * d[k, 1]) / length[k]))
        ox, oy = px - t * d[k, 0], py - t * d[k, 1]
        return np.rint(np.sqrt(ox * ox + oy * oy) * UNIT).astype(np.int64)

    first = np.cumsum(steps + 1) - steps - 1
    own = np.repeat(all_, steps + 1)
    at = np.arange(len(own)) - first[own]
    column, row = p[own, along[own]] + at * ahead[own], p[own, across[own]]
    row[first + steps] = q[all_, across]
    inner = np.flatnonzero((at > 0) & (at < steps[own]) & sound[own])
    k, c = own[inner], column[inner]
    m, n = along[k], across[k]
    place = start[k, n] + ((c + 0.5) * size[m] - low[m] - start[k, m]) / d[k, m] * d[k, n]
    below = np.floor((place + low[n]) / size[n] - 0.5)
    pair = [np.clip(below + i, 0, (1 << bits[n]) - 1).astype(np.int64) for i in (0, 1)]
    cost = [away(k, c, r) for r in pair]
    # Of equal ones the lower row has the lower number.
    row[inner] = np.where(cost[0] <= cost[1], *pair)
    least = np.zeros(len(own), np.int64)
    least[inner] = np.minimum(*cost)
    broken = np.zeros(len(a), bool)
    broken[own[1:][(abs(np.diff(row)) > 1) & (at[1:] > 0)]] = True
    done = sound & ~broken
    for n in np.unique(steps[broken & sound]).tolist():
        k = np.flatnonzero(broken & sound & (steps == n))
        if (n + 1) * (2 * BAND + 1) < 1 << 20:
            cells = first[k][:, None] + np.arange(n + 1)
            sure, rows = _one_a_column(k, column[cells], row[cells], least[cells], away, 1 << bits[across[k]])
            row[cells[sure]] = rows[sure]
            done[k[sure]] = True
    kept = done[own]
    own, column, row, at = own[kept], column[kept], row[kept], at[kept]
    # From the end where the segment begins.
    ordered = np.argsort(own * (1 << 32) + np.where(turned[own], steps[own] - at, at), kind="stable")
    own, column, row = own[ordered], column[ordered], row[ordered]
    x, y = np.where(along[own] == 0, column, row), np.where(along[own] == 0, row, column)
    if not done.all():
        rest = [(k, *c) for k in np.flatnonzero(~done).tolist() for c in searched(tuple(a[k].tolist()), tuple(b[k].tolist()), res)]
        own, x, y = (np.concatenate([v, np.array(w, np.int64)]) for v, w in zip((own, x, y), zip(*rest, strict=True), strict=True))
        ordered = np.argsort(own, kind="stable")
        own, x, y = own[ordered], x[ordered], y[ordered]
    return own + begin, x, y


def _one_a_column(k: np.ndarray, column: np.ndarray, row: np.ndarray, least: np.ndarray, away, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments of as many columns each: whether the best path of one cell a column is the cheapest of all, and its rows.

    ``row`` has the columns' cheapest cells and the ends, ``least`` those cells' costs.  Costs are held as what they are
    above the least, with the sum of row numbers below them.
    """
    none, shift, wide = 1 << 62, 20, 2 * BAND + 1
    off = np.arange(wide) - BAND
    best = np.where(off == 0, 0, none) * np.ones((len(k), 1), np.int64)
    twice, outside, via = np.zeros(best.shape, bool), np.full(len(k), none), []
    for i in range(1, column.shape[1]):
        # The three cells before: their places in the band of the column before.
        back = (off + BAND + (row[:, i] - row[:, i - 1])[:, None])[..., None] + np.array([-1, 0, 1])
        fits = (back >= 0) & (back < wide)
        back = np.clip(back, 0, wide - 1)
        each = np.where(fits, best[np.arange(len(k))[:, None, None], back], none)
        pick = each.argmin(2)[..., None]
        low = np.take_along_axis(each, pick, 2)
        via.append(np.take_along_axis(back, pick, 2)[..., 0])
        low_twice = ((each == low).sum(2) > 1) | np.take_along_axis(twice, via[-1], 1)
        if i < column.shape[1] - 1:
            rows = row[:, i, None] + np.arange(-BAND - 1, BAND + 2)
            above = np.where((rows >= 0) & (rows < limit[:, None]), away(k[:, None], column[:, i, None], rows) - least[:, i, None], none >> shift)
            outside = np.minimum(outside, np.minimum(above[:, 0], above[:, -1]))
            own = (above[:, 1:-1] << shift) + off + BAND
        else:
            own = np.where(off == 0, 0, none)
        best, twice = np.minimum(low[..., 0] + np.minimum(own, none - 1), none), low_twice
    above = best[:, BAND] >> shift
    sure = (best[:, BAND] < none) & ~twice[:, BAND] & (above < UNIT) & (above < outside)
    rows, place = row.copy(), np.full(len(k), BAND)
    for i in range(column.shape[1] - 1, 0, -1):
        rows[:, i] = row[:, i] + place - BAND
        place = via[i - 1][np.arange(len(k)), place]
    return sure, rows
