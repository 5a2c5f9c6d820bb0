"""rHEALPix cells (WGS84, 3 by 3, both polar squares on face 0): column expressions and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guard import finer

NAME, GEODESIC = "rhp", False
FACES = "NOPQRS"
E2 = 0.0066943799901413165
E1 = math.sqrt(E2)
QP = 1 - (1 - E2) / (2 * E1) * math.log((1 - E1) / (1 + E1))


# -- column expressions -------------------------------------------------------------------------


def point(lon: Column, lat: Column, res: int) -> Column:
    """Authalic latitude, HEALPix projection, polar triangles turned onto face 0, then base-9 digits row by row."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / QP))
    lam = F.radians(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)
    seed = F.struct(z.alias("z"), lam.alias("lam"))

    def made(c: Column) -> Column:
        z, lam = c["z"], c["lam"]
        cap = F.least(F.floor(2 * lam / math.pi + 2), F.lit(3)).cast("int")
        mid = cap * (math.pi / 2) - 3 * math.pi / 4
        sigma = F.sqrt(3 * (1 - F.abs(z)))
        polar = F.abs(z) > 2 / 3
        # Offsets from the triangle's tip, then turned by quarter turns (north anticlockwise, south clockwise).
        dx, dy = (lam - mid) * sigma, -F.signum(z) * (math.pi / 4) * sigma
        n = F.when(z > 0, cap).otherwise((4 - cap) % 4)
        tx = F.when(n == 0, dx).when(n == 1, -dy).when(n == 2, -dx).otherwise(dy)
        ty = F.when(n == 0, dy).when(n == 1, dx).when(n == 2, -dy).otherwise(-dx)
        x = F.when(polar, tx - 3 * math.pi / 4).otherwise(lam)
        y = F.when(polar, ty + F.signum(z) * math.pi / 2).otherwise(3 * math.pi / 8 * z)
        col = F.when(polar, 0).otherwise(F.least(F.floor((lam + math.pi) / (math.pi / 2)), F.lit(3)).cast("int"))
        face = F.when(polar, F.when(z > 0, 0).otherwise(5)).otherwise(col + 1)
        top = F.when(polar, F.when(z > 0, 3 * math.pi / 4).otherwise(-math.pi / 4)).otherwise(math.pi / 4)
        size = 3**res
        fx, fy = (x + math.pi - col * (math.pi / 2)) / (math.pi / 2), (top - y) / (math.pi / 2)
        at = lambda w: F.least(F.greatest(F.floor(w * size), F.lit(0)), F.lit(size - 1)).cast("long")
        cell = F.substring(F.lit(FACES), face + 1, F.lit(1))
        if not res:
            return cell
        return F.element_at(F.transform(F.array(F.struct(at(fx).alias("i"), at(fy).alias("j"))), lambda g: F.concat(cell, *[(F.pmod(F.floor(g["j"] / 3**k), F.lit(3)) * 3 + F.pmod(F.floor(g["i"] / 3**k), F.lit(3))).cast("string") for k in range(res - 1, -1, -1)])), 1)

    return F.when(lon.isNotNull() & lat.isNotNull(), F.element_at(F.transform(F.array(seed), made), 1))


def resolution(cell: Column) -> Column:
    return F.length(cell) - 1


def parent(cell: Column, res: int) -> Column:
    return F.substring(cell, 1, res + 1)


def representative(cell: Column, res: int) -> Column:
    """The central descendant; an error for a cell that is not coarser."""
    return finer(resolution(cell), res, F.rpad(cell, res + 1, "4"))


def children(cell: Column, from_res: int, res: int) -> Column:
    out = F.array(cell)
    digits = F.split(F.lit("0,1,2,3,4,5,6,7,8"), ",")
    for _ in range(res - from_res):
        out = F.flatten(F.transform(out, lambda c: F.transform(digits, lambda x: F.concat(c, x))))
    return out


def leaf_count(from_res: int, res: int) -> int:
    return 9 ** (res - from_res)


# -- kernels ------------------------------------------------------------------------------------


def project(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, x and y inside it from its upper left corner, 0 to 1)."""
    s = np.sin(np.radians(lat))
    z = np.clip((1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) / QP, -1, 1)
    lam = np.radians((np.asarray(lon) + 180) % 360 - 180)
    cap = np.minimum(np.floor(2 * lam / math.pi + 2), 3).astype(int)
    mid = cap * math.pi / 2 - 3 * math.pi / 4
    sigma = np.sqrt(3 * (1 - np.abs(z)))
    polar = np.abs(z) > 2 / 3
    dx, dy = (lam - mid) * sigma, -np.sign(z) * math.pi / 4 * sigma
    n = np.where(z > 0, cap, (4 - cap) % 4)
    tx, ty = np.choose(n, [dx, -dy, -dx, dy]), np.choose(n, [dy, dx, -dy, -dx])
    x = np.where(polar, tx - 3 * math.pi / 4, lam)
    y = np.where(polar, ty + np.sign(z) * math.pi / 2, 3 * math.pi / 8 * z)
    col = np.where(polar, 0, np.minimum(np.floor((lam + math.pi) / (math.pi / 2)), 3)).astype(int)
    face = np.where(polar, np.where(z > 0, 0, 5), col + 1)
    top = np.where(polar, np.where(z > 0, 3 * math.pi / 4, -math.pi / 4), math.pi / 4)
    return face, (x + math.pi - col * math.pi / 2) / (math.pi / 2), (top - y) / (math.pi / 2)


def unproject(face: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    polar = (face == 0) | (face == 5)
    north = np.where(face == 0, 1.0, -1.0)
    dx, dy = (fx - 0.5) * math.pi / 2, (0.5 - fy) * math.pi / 2
    # The triangle that holds the point: by its base's side of the square, from the front by quarter turns.
    fy_ = dy * north  # base of triangle 0 at the side facing the equator
    n = np.where(-fy_ >= np.abs(dx), 0, np.where(dx >= np.abs(fy_), 1, np.where(fy_ >= np.abs(dx), 2, 3)))
    back = np.where(north > 0, n, (4 - n) % 4)
    ux, uy = np.choose(back, [dx, dy, -dx, -dy]), np.choose(back, [dy, -dx, -dy, dx])
    sigma = np.abs(uy) / (math.pi / 4)
    mid = n * math.pi / 2 - 3 * math.pi / 4
    with np.errstate(divide="ignore", invalid="ignore"):
        lam_p = np.where(sigma > 0, mid + np.where(sigma > 0, ux / sigma, 0), mid)
    z_p = north * (1 - sigma * sigma / 3)
    lam_e = -math.pi + (face - 1) * math.pi / 2 + fx * math.pi / 2
    z_e = (0.5 - fy) * (math.pi / 2) * 8 / (3 * math.pi)
    z, lam = np.where(polar, z_p, z_e), np.where(polar, lam_p, lam_e)
    phi = np.arcsin(np.clip(z, -1, 1))
    for _ in range(8):  # Newton's method for the geodetic latitude
        s = np.sin(phi)
        q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
        d = 2 * (1 - E2) * np.cos(phi) / (1 - E2 * s * s) ** 2
        phi = np.clip(phi - np.where(d > 1e-12, (q - z * QP) / np.maximum(d, 1e-12), 0), -math.pi / 2, math.pi / 2)
    return np.degrees(lam), np.degrees(phi)


def named(cells: np.ndarray, res: int) -> np.ndarray:
    digits = [(cells[:, 2] // 3**k % 3) * 3 + cells[:, 1] // 3**k % 3 + len(FACES) for k in range(res - 1, -1, -1)]
    letters = np.array(list(FACES + "012345678"))[np.stack([cells[:, 0], *digits], 1)]
    return letters.view(f"U{res + 1}").ravel() if len(cells) else np.zeros(0, f"U{res + 1}")


def encode(lon: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    face, fx, fy = project(np.asarray(lon, float), np.asarray(lat, float))
    ij = [np.clip(np.floor(w * 3**res), 0, 3**res - 1).astype(np.int64) for w in (fx, fy)]
    return named(np.stack([face, *ij], 1), res)


def split(cell: str) -> tuple[int, int, int, int]:
    i = j = 0
    for d in cell[1:]:
        i, j = i * 3 + int(d) % 3, j * 3 + int(d) // 3
    return FACES.index(cell[0]), i, j, len(cell) - 1


def _points(cells: list[str], di: float, dj: float) -> tuple[np.ndarray, np.ndarray]:
    face, i, j, res = (np.array(x) for x in zip(*map(split, cells), strict=True))
    return unproject(face, (i + di) / 3.0**res, (j + dj) / 3.0**res)


def centers(cells: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _points(list(cells), 0.5, 0.5) if len(cells) else (np.zeros(0), np.zeros(0))


def boundary(cell: str) -> np.ndarray:
    return np.array([[c[0] for c in _points([cell], a, b)] for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])


def radius(res: int) -> float:
    return math.pi if res == 0 else min(math.pi, 1.2 * math.sqrt(4 * math.pi / 6) / 3**res)


def roots() -> np.ndarray:
    return np.array([(f, 0, 0) for f in range(6)], np.int64)


def divide(cells: np.ndarray) -> np.ndarray:
    return np.concatenate([np.stack([cells[:, 0], cells[:, 1] * 3 + a, cells[:, 2] * 3 + b], 1) for a in range(3) for b in range(3)])


def middle(cells: np.ndarray, res: int) -> np.ndarray:
    from gridloom.functions.s2 import xyz

    return xyz(*unproject(cells[:, 0], (cells[:, 1] + 0.5) / 3.0**res, (cells[:, 2] + 0.5) / 3.0**res))


def _height(lat: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(lat))
    return np.clip((1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) / QP, -1, 1)


def _bisected(f, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A root of ``f(t, own)`` in each of the intervals, at whose ends it has different signs; few intervals are cut into more pieces at a time."""
    rising, column = f(high, own) > 0, np.arange(len(low))
    bits = 6 if len(low) <= 256 else 2
    inner = np.linspace(0, 1, (1 << bits) + 1)[1:-1, None]
    for _ in range(-(-54 // bits)):
        at = np.concatenate([low[None], low + inner * (high - low), high[None]])
        over = (f(at[1:-1], own) > 0) == rising
        k = np.where(over.any(0), over.argmax(0), len(inner))
        low, high = at[k, column], at[k + 1, column]
    return (low + high) / 2


def _turns(f, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, root) of all roots in the intervals, two at most in each, of functions ``f(t, interval)`` that are convex or concave there."""
    own = np.arange(len(low))
    first, last = f(low, own), f(high, own)
    sign = np.where((first > 0) | (first == 0) & (last > 0), 1.0, -1.0)
    crossed = np.flatnonzero(first * last < 0)
    found = [(crossed, low[crossed], high[crossed])]
    live = np.flatnonzero(~(first * last < 0))
    a, b = low[live], high[live]
    for n in (5, *[33] * 10):  # to the point nearest to the other side
        if not len(live):
            break
        t, column = np.linspace(a, b, n), np.arange(len(live))
        v = sign[live] * f(t, live)
        k = v.argmin(0)
        before, after = np.maximum(k - 1, 0), np.minimum(k + 1, n - 1)
        least, at = v[k, column], t[k, column]
        below = least < 0
        found += [(live[below], low[live[below]], at[below]), (live[below], at[below], high[live[below]])]
        # Beside its least sample a convex function stays above the chords of the neighbouring samples, drawn on.
        left, right = v[before, column] - least, v[after, column] - least
        near = np.where((k > 0) & (k < n - 1), least - np.maximum(left, right), np.where(k == 0, 2 * v[1] - v[2], 2 * v[n - 2] - v[n - 3]))
        go = ~below & ~(near > 0)
        a, b, live = t[before, column][go], t[after, column][go], live[go]
    own, low, high = (np.concatenate(w) for w in zip(*found, strict=True))
    return own, _bisected(f, own, low, high)


#: The latitude where the caps begin.
LIMIT = float(unproject(np.array([1]), np.array([0.5]), np.array([0.0]))[1][0])


def _between(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, number) of the whole numbers from x to y, in either order, of each pair."""
    first = np.ceil(np.minimum(x, y))
    n = np.maximum(np.floor(np.maximum(x, y)) - first + 1, 0).astype(np.int64)
    own = np.repeat(np.arange(len(n)), n)
    return own, first[own] + (np.arange(len(own)) - (np.cumsum(n) - n)[own])


def _ascending(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place on it) in order, each once."""
    own, t = (np.concatenate(w) for w in zip(*found, strict=True))
    t = np.clip(t, 0, 1)
    order = np.lexsort((t, own))
    own, t = own[order], t[order]
    fresh = np.concatenate([np.ones(min(1, len(t)), bool), (np.diff(own) != 0) | (np.diff(t) != 0)])
    return own[fresh], t[fresh]


def crossings(a: np.ndarray, b: np.ndarray, res: int) -> np.ndarray:
    """Where (0 to 1, ascending, both ends with it) the segment of degrees from a to b meets borders of cells, faces and polar triangles."""
    return all_crossings(np.asarray(a, float)[None], np.asarray(b, float)[None], res)[1]


def all_crossings(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of the ``crossings`` of all segments.

    Borders of constant latitude or longitude have closed forms.  The others, across a polar triangle, are at constant
    products of a longitude and the triangle's width at a latitude; between the at most two turns of that product
    along the segment each is met once, and found by bisection.
    """
    (lon, lat), (wide, high) = a.T, (b - a).T
    size = 3**res
    ends, slanted, moving = np.arange(len(a)), np.flatnonzero(high), np.flatnonzero(wide)
    knots = [(ends, np.zeros(len(a))), (ends, np.ones(len(a)))]
    knots += [(slanted, (limit - lat[slanted]) / high[slanted]) for limit in (-LIMIT, LIMIT)]
    k, n = _between(lon[moving] / 90, (lon + wide)[moving] / 90)
    k = moving[k]
    knots.append((k, (90.0 * n - lon[k]) / wide[k]))
    own, at = _ascending(knots)
    out = [(own, at)]
    whole = np.flatnonzero(np.diff(own) == 0)
    piece, t0, t1 = own[whole], at[whole], at[whole + 1]

    def taken(i: np.ndarray) -> tuple[np.ndarray, ...]:
        return piece[i], t0[i], t1[i]

    def crossed(k: np.ndarray, latitude: np.ndarray) -> None:
        out.append((k, (latitude - lat[k]) / high[k]))

    level = _height(lat[piece] + (t0 + t1) / 2 * high[piece])
    # Between the caps.
    k, u, v = taken(np.flatnonzero((np.abs(level) <= 2 / 3) & (wide[piece] != 0)))
    i, n = _between((lon[k] + u * wide[k]) / 90 * size, (lon[k] + v * wide[k]) / 90 * size)
    out.append((k[i], (n * 90.0 / size - lon[k[i]]) / wide[k[i]]))
    k, u, v = taken(np.flatnonzero((np.abs(level) <= 2 / 3) & (high[piece] != 0)))
    i, n = _between(*[(0.5 - 0.75 * _height(lat[k] + t * high[k])) * size for t in (u, v)])
    crossed(k[i], unproject(np.full(len(i), 1), np.full(len(i), 0.5), n / size)[1])

    # On the caps.
    cap = np.flatnonzero(np.abs(level) > 2 / 3)
    north = np.where(level[cap] > 0, 1, -1)
    k, t0, t1 = taken(cap)
    middle = np.radians(90 * np.floor((lon[k] + t0 * wide[k] + lon[k] + t1 * wide[k]) / 180) + 45)
    width = lambda t, i: np.sqrt(3 * (1 - np.abs(_height(lat[k[i]] + t * high[k[i]]))))
    offset = lambda t, i: (np.radians(lon[k[i]] + t * wide[k[i]]) - middle[i]) * width(t, i)

    def slope(t: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Without roots but where the offset turns: its derivative by that of the width."""
        own = k[i]
        phi = np.radians(lat[own] + t * high[own])
        grows = 2 * (1 - E2) * np.cos(phi) / (1 - E2 * np.sin(phi) ** 2) ** 2 / QP * np.radians(high[own]) * north[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(np.abs(grows) > 1e-12, -2 * (1 - np.abs(_height(lat[own] + t * high[own]))) / grows, 0.0)
        return np.radians(lon[own] + t * wide[own]) - middle[i] + np.radians(wide[own]) * ratio

    rows = np.flatnonzero(high[k])  # rows of the triangle; half a face is as wide as 1 in the width
    i, n = _between(*[(1 - width(t[rows], rows)) * size / 2 for t in (t0, t1)])
    i = rows[i]
    crossed(k[i], unproject(np.where(north[i] > 0, 0, 5), np.full(len(i), 0.5), np.where(north[i] > 0, 1 - n / size, n / size))[1])
    both = np.flatnonzero((wide[k] != 0) & (high[k] != 0))
    i, t = _turns(lambda t, i: slope(t, both[i]), t0[both], t1[both])
    part, t = np.concatenate([np.tile(np.arange(len(k)), 2), both[i]]), np.concatenate([t0, t1, t])
    order = np.lexsort((t, part))
    part, t = part[order], t[order]
    joined = np.flatnonzero(np.diff(part) == 0)
    part, u, v = part[joined], t[joined], t[joined + 1]
    begin, end = offset(u, part), offset(v, part)
    i, n = _between(*[(w / (math.pi / 2) + 0.5) * size for w in (begin, end)])
    line = (n / size - 0.5) * (math.pi / 2)
    inner = (line - begin[i]) * (line - end[i]) < 0
    i, line = i[inner], line[inner]
    out.append((k[part[i]], _bisected(lambda t, j: offset(t, part[i[j]]) - line[j], np.arange(len(i)), u[i], v[i])))
    return _ascending(out)


def paths(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell) with the cells (face, column, row) that each segment of degrees from a to b passes, in order: those of its ends and of the middles between its crossings."""
    own, t = all_crossings(a, b, res)
    inner, ends = np.flatnonzero(np.diff(own) == 0), np.arange(len(a))
    own, t = np.concatenate([ends, own[inner], ends]), np.concatenate([np.zeros(len(a)), (t[inner] + t[inner + 1]) / 2, np.ones(len(a))])
    order = np.argsort(own, kind="stable")
    own, t = own[order], t[order]
    face, *w = project(a[own, 0] + t * (b[own, 0] - a[own, 0]), a[own, 1] + t * (b[own, 1] - a[own, 1]))
    cells = np.stack([face, *[np.clip(np.floor(v * 3**res), 0, 3**res - 1).astype(np.int64) for v in w]], 1)
    fresh = np.concatenate([np.ones(min(1, len(own)), bool), (np.diff(own) != 0) | (np.diff(cells, axis=0) != 0).any(1)])
    return own[fresh], cells[fresh]


def path(a: np.ndarray, b: np.ndarray, res: int) -> np.ndarray:
    """The cells of one segment."""
    return paths(np.asarray(a, float)[None], np.asarray(b, float)[None], res)[1]


#: Crossings, about, that are held at a time.
HELD = 1 << 17


def named_paths(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell) of all segments, in order, by name."""
    # A segment crosses up to about twice as many borders as there are cells in its degrees.
    group = np.cumsum(np.abs(b - a).sum(1) / 90 * 3**res + 8) // HELD
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(a)]
    found = [(i, *paths(a[i:j], b[i:j], res)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([i + own for i, own, _ in found]), named(np.concatenate([cells for *_, cells in found]), res)
