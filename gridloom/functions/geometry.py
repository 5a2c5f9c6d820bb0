"""WKB codec and planar kernels.

A decoded geometry is (kind, parts): ``point`` has one part of one position,
``line`` one part of positions, ``polygon`` its rings.  Z and M are read past.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np

KINDS = {1: "point", 2: "line", 3: "polygon", 4: "multipoint", 5: "multiline", 6: "multipolygon", 7: "collection"}
CODES = {v: k for k, v in KINDS.items()}
#: Curves and surfaces that are read past as a whole: strings of positions, lists of rings, lists of geometries.
STRINGS, SURFACES, LISTS = (8,), (17,), (9, 10, 11, 12, 15, 16)
Geometry = tuple[str, list]


def decode(raw: bytes | None) -> Geometry | None:
    """The geometry of a WKB or EWKB value; a collection's parts are geometries.

    Curves, and surfaces other than polygons, are of kind ``other`` and have no parts, so they are dropped and counted as empty
    geometries are; in a collection the parts beside them stay.  A value of a type that WKB does not define is ``other`` as a whole.
    """
    if not raw:
        return None
    try:
        return _read(memoryview(bytes(raw)), 0)[0]
    except Undefined:
        return "other", []


class Undefined(ValueError):
    """A type code whose length nobody knows."""


def _read(raw: memoryview, at: int) -> tuple[Geometry, int]:
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    code, z_and_m = code % 1000, code // 1000
    if z_and_m > 3 or code not in KINDS and code not in STRINGS + SURFACES + LISTS:
        raise Undefined(code)
    extra += (0, 1, 1, 2)[z_and_m]
    kind = KINDS.get(code, "other")
    width = 2 + extra

    def positions(at: int) -> tuple[np.ndarray, int]:
        (n,) = struct.unpack_from(f"{order}I", raw, at)
        data = np.frombuffer(raw, f"{order}f8", n * width, at + 4).reshape(n, width)[:, :2].astype(float)
        return data, at + 4 + 8 * n * width

    if kind == "point":
        data = np.frombuffer(raw, f"{order}f8", width, at)[:2].astype(float)
        return ("point", [] if np.isnan(data).any() else [data.reshape(1, 2)]), at + 8 * width
    if kind == "line" or code in STRINGS:
        data, at = positions(at)
        return (kind, [data] if len(data) and kind == "line" else []), at
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at += 4
    parts = []
    for _ in range(n):
        part, at = positions(at) if kind == "polygon" or code in SURFACES else _read(raw, at)
        parts.append(part)
    return (kind, parts if kind != "other" else []), at


def encode(geometry: Geometry) -> bytes:
    kind, parts = geometry
    head = struct.pack("<BI", 1, CODES.get(kind, CODES["collection"]))
    if kind == "point":
        return head + (np.asarray(parts[0], "<f8").tobytes() if parts else struct.pack("<dd", math.nan, math.nan))
    if kind == "line":
        p = parts[0] if parts else np.zeros((0, 2))
        return head + struct.pack("<I", len(p)) + np.asarray(p, "<f8").tobytes()
    if kind == "polygon":
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in parts)
    return head + struct.pack("<I", len(parts)) + b"".join(encode(p) for p in parts)


def flat(geometry: Geometry | None) -> Iterator[Geometry]:
    """The non-empty points, lines and polygons of a geometry, at any depth."""
    if geometry is None:
        return
    kind, parts = geometry
    if kind in ("point", "line", "polygon"):
        if parts and len(parts[0]):
            yield geometry
    else:
        for p in parts:
            yield from flat(p)


def bounds(geometry: Geometry | None) -> tuple[float, float, float, float] | None:
    rings = [r for _, parts in flat(geometry) for r in parts]
    if not rings:
        return None
    p = np.concatenate(rings)
    return (*p.min(0).tolist(), *p.max(0).tolist())


def edges_of(rings: list[np.ndarray]) -> np.ndarray:
    """All edges (x0, y0, x1, y1) of closed rings."""
    if not rings:
        return np.zeros((0, 4))
    out = np.concatenate([np.concatenate([r, np.roll(r, -1, 0)], 1) for r in rings])
    return out[(out[:, :2] != out[:, 2:]).any(1)]


def near_edges(edges: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Edges that tell inside from outside for positions in the box.

    A position is inside if an odd number of edges lies to its right.  So edges above, below or left of the box do not
    matter, and a run of edges to its right counts as one upright edge from the run's begin to its end.
    """
    x0, y0, x1, y1 = box
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    level = (high[:, 1] >= y0) & (low[:, 1] <= y1)
    right = low[:, 0] > x1
    meets = edges[level & ~right & (high[:, 0] >= x0)]
    far = np.flatnonzero(right)
    if not len(far):
        return meets
    linked = (np.diff(far) == 1) & (edges[far[1:], :2] == edges[far[:-1], 2:]).all(1)
    first, last = far[np.concatenate(([True], ~linked))], far[np.concatenate((~linked, [True]))]
    run = np.stack([np.full(len(first), x1 + 1.0), edges[first, 1], np.full(len(first), x1 + 1.0), edges[last, 3]], 1)
    run = run[(np.maximum(run[:, 1], run[:, 3]) >= y0) & (np.minimum(run[:, 1], run[:, 3]) <= y1) & (run[:, 1] != run[:, 3])]
    return np.concatenate([meets, run])


def within(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Strictly inside by the even-odd rule; a position on an edge is not inside.

    Positions are sorted by height, so each edge meets only those between its ends.
    """
    odd, on = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    order = np.argsort(y, kind="stable")
    height = y[order]
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    first, last = np.searchsorted(height, low, side="left"), np.searchsorted(height, high, side="right")
    count = last - first
    cuts = np.searchsorted(np.cumsum(count), np.arange(1 << 20, int(count.sum()) + 1, 1 << 20))
    for part in np.split(np.arange(len(edges)), np.unique(cuts)):
        n = count[part]
        e = np.repeat(part, n)
        at = order[np.repeat(first[part], n) + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)]
        ax, ay, bx, by = edges[e].T
        px, py = x[at], y[at]
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        on[at[(cross == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx))]] = True
        spans = (ay > py) != (by > py)
        odd += np.bincount(at[spans & ((cross > 0) == (by > ay))], minlength=len(x))
    return (odd % 2 == 1) & ~on


def inside(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``within`` for rings."""
    return within(edges_of(rings), x, y)


def area(rings: list[np.ndarray]) -> float:
    """The shell's area less the holes'."""
    one = lambda r: abs(float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]))) / 2
    return one(rings[0]) - sum(one(r) for r in rings[1:]) if rings else 0.0


def closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def nested(rings: list[np.ndarray]) -> list[Geometry]:
    """Polygons of rings that do not cross: a ring inside an odd number of others is a hole of the smallest of them."""
    rings = sorted((r for r in map(closed, rings) if len(r) > 3 and area([r]) > 0), key=lambda r: -area([r]))
    out: list[list[np.ndarray]] = []
    shells: list[int | None] = []
    for k, ring in enumerate(rings):
        # A position on the ring that is on no other: vertices may touch, the middles of edges do not.
        middle = (ring[:-1] + ring[1:]) / 2
        around = [j for j in range(k) if inside([rings[j]], middle[:, 0], middle[:, 1]).mean() > 0.5]
        if len(around) % 2 == 0:
            shells.append(len(out))
            out.append([ring])
        else:
            shells.append(None)
            home = next((shells[j] for j in reversed(around) if shells[j] is not None), None)
            if home is not None:
                out[home].append(ring)
    return [("polygon", rings) for rings in out]


def half(rings: list[np.ndarray], axis: int, at: float, below: bool) -> list[Geometry]:
    """The part of a polygon (even-odd) on one side of an axis-parallel line, as separate polygons.

    Each ring falls into runs of vertices on the side, which end on the line.  Along the line, inside and outside
    alternate from end to end, so the ends are joined in pairs by their order there.
    """
    whole: list[np.ndarray] = []
    runs: list[np.ndarray] = []
    for ring in rings:
        ring = closed(ring)[:-1]
        keep = ring[:, axis] < at if below else ring[:, axis] > at
        if keep.all():
            whole.append(ring)
            continue
        ring, keep = np.roll(ring, -int(np.argmin(keep)), 0), np.roll(keep, -int(np.argmin(keep)))  # begins off the side
        edge = np.flatnonzero(np.diff(np.concatenate((keep, [False])).astype(int)))
        for first, last in zip(edge[::2], edge[1::2], strict=True):  # vertices first + 1 .. last are kept
            ends = []
            for u, v in ((ring[first], ring[first + 1]), (ring[last], ring[(last + 1) % len(ring)])):
                p = u + (at - u[axis]) / (v[axis] - u[axis]) * (v - u)
                p[axis] = at
                ends.append(p)
            runs.append(np.concatenate([ends[:1], ring[first + 1 : last + 1], ends[1:]]))
    place = sorted((run[end][1 - axis], k, end) for k, run in enumerate(runs) for end in (0, -1))
    mate = {}
    for (_, k, e), (_, m, f) in zip(place[::2], place[1::2], strict=True):
        mate[k, e], mate[m, f] = (m, f), (k, e)
    left = set(range(len(runs)))
    while left:
        start = k = min(left)
        end, parts = 0, []
        while k in left:
            left.discard(k)
            parts.append(runs[k] if end == 0 else runs[k][::-1])
            k, end = mate[k, -1 if end == 0 else 0]
        assert k == start
        whole.append(np.concatenate(parts))
    return nested(whole)


def clip(geometry: Geometry, axis: int, at: float, below: bool) -> list[Geometry]:
    """Pieces of a polygon or line on one side of an axis-parallel line."""
    kind, parts = geometry
    if kind == "polygon":
        return half(parts, axis, at, below)
    if kind == "point":
        v = parts[0][0, axis]
        return [geometry] if (v <= at if below else v >= at) else []
    pieces, run = [], []
    line = parts[0]
    side = (line[:, axis] <= at) if below else (line[:, axis] >= at)
    for k in range(len(line)):
        if k and side[k] != side[k - 1]:
            a, b = line[k - 1], line[k]
            p = a + (at - a[axis]) / (b[axis] - a[axis]) * (b - a)
            p[axis] = at
            run.append(p)
            if not side[k]:
                pieces.append(run)
                run = []
        if side[k]:
            run.append(line[k])
    pieces.append(run)
    return [("line", [np.array(r)]) for r in pieces if len(r) > 1]


def _meetings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, positions) where segments a-b meet: crossings, touches and the ends of overlaps; ends that both share are left out."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    last = np.searchsorted(low[order, 0], high[order, 0], side="right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(a)
    grain = 2.0 ** (math.frexp(float(np.abs(np.concatenate([a, b])).max()))[1] - 42)
    step = max(1, (1 << 20) // max(1, int((last - np.arange(n)).max(initial=1))))
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        count = last[rows] - rows - 1
        i = np.repeat(rows, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        i, j = order[i], order[j]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[near], j[near]
        d, e, f = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (f[:, 0] * e[:, 1] - f[:, 1] * e[:, 0]) / cross, (f[:, 0] * d[:, 1] - f[:, 1] * d[:, 0]) / cross
            meet = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        # Crossings are rounded, so that several through one place are one; an end that lies on the other segment keeps its own numbers.
        p = np.round((a[i] + np.where(meet, t, 0.0)[:, None] * d) / grain) * grain
        for ends, v in ((a[i], t == 0), (b[i], t == 1), (a[j], u == 0), (b[j], u == 1)):
            p = np.where(v[:, None], ends, p)
        shared = np.isin(np.where(t == 0, 0, np.where(t == 1, 1, 2)), (0, 1)) & np.isin(np.where(u == 0, 0, np.where(u == 1, 1, 2)), (0, 1))
        keep = meet & ~shared
        found.append((i[keep], j[keep], p[keep]))
        flat_ = (cross == 0) & (f[:, 0] * d[:, 1] == f[:, 1] * d[:, 0])
        for x, y in zip(i[flat_].tolist(), j[flat_].tolist(), strict=True):
            for p, k in ((a[x], y), (b[x], y), (a[y], x), (b[y], x)):
                w = b[k] - a[k]
                s = float((p - a[k]) @ w) / float(w @ w) if (w @ w) else -1.0
                if 0 < s < 1:
                    found.append((np.array([k]), np.array([k]), p[None]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 2))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def make_valid(geometry: Geometry) -> list[Geometry]:
    """Polygons whose rings do not cross, covering what the polygon covers by the even-odd rule; a line or point stays as it is.

    Edges are split where they meet, those met an even number of times cancel, and each of the others is directed so
    that the inside is on its left.  At a vertex a ring goes on along the first edge clockwise from where it came, so
    rings that only touch come apart.
    """
    if geometry[0] != "polygon":
        return [geometry]
    a = np.concatenate([closed(r)[:-1] for r in geometry[1]])
    b = np.concatenate([closed(r)[1:] for r in geometry[1]])
    real = (a != b).any(1)
    a, b = a[real], b[real]
    if len(a) < 3:
        return []
    i, j, p = _meetings(a, b)
    pieces: dict[tuple, int] = {}
    on: dict[int, list[np.ndarray]] = {}
    for x, y, q in zip(i.tolist(), j.tolist(), p, strict=True):
        on.setdefault(x, []).append(q)
        if y != x:
            on.setdefault(y, []).append(q)
    for k in range(len(a)):
        way = [a[k], *sorted(on.get(k, []), key=lambda q: float((q - a[k]) @ (b[k] - a[k]))), b[k]]
        for u, v in zip(way[:-1], way[1:], strict=True):
            u, v = tuple(u.tolist()), tuple(v.tolist())
            if u != v:
                pieces[min(u, v), max(u, v)] = pieces.get((min(u, v), max(u, v)), 0) + 1
    edges = np.array([e for e, n in pieces.items() if n % 2]).reshape(-1, 2, 2)
    if not len(edges):
        return []
    if not len(i) and all(n == 1 for n in pieces.values()) and len(np.unique(a, axis=0)) == len(a):
        return nested(geometry[1])
    out: dict[tuple, list[tuple]] = {}
    u, v = edges[:, 0], edges[:, 1]  # sorted: u is left of v, or below it
    for k in range(len(edges)):
        x, y = (u[k] + v[k]) / 2
        axis = 0 if u[k, 0] != v[k, 0] else 1  # look up from the middle of an edge, to the right from that of an upright one
        s, t, at, level = (u, v, x, y) if axis == 0 else (u, v, y, x)
        over = (np.minimum(s[:, axis], t[:, axis]) <= at) & (at < np.maximum(s[:, axis], t[:, axis]))
        over[k] = False
        s, t = s[over], t[over]
        height = s[:, 1 - axis] + (at - s[:, axis]) / (t[:, axis] - s[:, axis]) * (t[:, 1 - axis] - s[:, 1 - axis])
        odd = int((height > level).sum()) % 2
        first, second = tuple(u[k].tolist()), tuple(v[k].tolist())
        # Above an edge that runs to the right is its left; right of one that runs up is its right.
        if bool(odd) == (axis == 1):
            first, second = second, first
        out.setdefault(first, []).append(second)
    rings = []
    while out:
        start = here = min(out)
        back = None
        ring = [start]
        while True:
            options = out[here]
            if back is None:
                k = 0
            else:
                angle = [(back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi) or 2 * math.pi for q in options]
                k = angle.index(min(angle))
            there = options.pop(k)
            if not options:
                del out[here]
            back = math.atan2(here[1] - there[1], here[0] - there[0])
            here = there
            if here == start:
                break
            ring.append(here)
            if here not in out:  # numbers too close to tell: leave the open rest
                break
        if len(ring) > 2 and here == start:
            rings += _parted(ring)
    return nested([np.array(r) for r in rings])


def _parted(ring: list[tuple]) -> list[list[tuple]]:
    """A ring that comes back to a vertex, as rings that do not."""
    out, way, seen = [], [], {}
    for p in ring:
        if p in seen:
            k = seen[p]
            part = way[k:]
            if len(part) > 2:
                out.append(part)
            for q in way[k + 1 :]:
                del seen[q]
            del way[k + 1 :]
        else:
            seen[p] = len(way)
            way.append(p)
    return [*out, way] if len(way) > 2 else out


def bisect(geometry: Geometry, threshold: float, most_depth: int = 250, spacing: float | None = None) -> list[Geometry]:
    """Halve the bounding box across its longer side until its area is at most ``threshold``.

    Polygons that are to be cut are made valid first.  With ``spacing``, edges
    that lie on a cut get vertices at its multiples.  Points are never cut.
    """
    out, cuts = [], {0: set(), 1: set()}
    stack = []
    for g in flat(geometry):
        x0, y0, x1, y1 = bounds(g)
        stack += [(p, 0) for p in (make_valid(g) if (x1 - x0) * (y1 - y0) > threshold else [g])]
    while stack:
        g, depth = stack.pop()
        x0, y0, x1, y1 = bounds(g)
        if g[0] == "point" or depth >= most_depth or (x1 - x0) * (y1 - y0) <= threshold:
            out.append(g)
            continue
        axis = 1 if y1 - y0 >= x1 - x0 else 0
        at = (y0 + y1) / 2 if axis else (x0 + x1) / 2
        cuts[axis].add(at)
        for below in (False, True):
            stack += [(p, depth + 1) for p in clip(g, axis, at, below)]
    lines = {axis: np.array(sorted(at)) for axis, at in cuts.items()}
    if spacing and (len(lines[0]) or len(lines[1])):
        out = [(k, [densify(r, lines, spacing) for r in parts]) if k == "polygon" else (k, parts) for k, parts in out]
    return out


def densify(ring: np.ndarray, lines: dict[int, np.ndarray], spacing: float) -> np.ndarray:
    """The ring with vertices at all multiples of ``spacing`` on its segments along a cut; ``lines`` holds the sorted cuts by axis.

    One pass over all segments: the number of multiples inside each one on a cut, then all new vertices at once.  Both
    polygons beside a cut get the same ones, as the multiples do not depend on where a segment begins.
    """
    a, b = ring[:-1], ring[1:]
    extra = np.zeros(len(a), np.int64)
    first, sign, along = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a), np.int64)
    for axis, own in lines.items():
        if not len(own):
            continue
        k = np.searchsorted(own, a[:, axis])
        gap = np.minimum(np.abs(own[np.minimum(k, len(own) - 1)] - a[:, axis]), np.abs(own[np.maximum(k - 1, 0)] - a[:, axis]))
        on = (a[:, axis] == b[:, axis]) & (gap <= spacing / 1000)
        start, stop = a[on, 1 - axis] / spacing, b[on, 1 - axis] / spacing
        low, high = np.floor(np.minimum(start, stop)) + 1, np.ceil(np.maximum(start, stop)) - 1
        extra[on] = np.maximum(0, high - low + 1)
        sign[on] = np.where(start < stop, 1, -1)
        first[on] = np.where(start < stop, low, high)
        along[on] = 1 - axis
    at = np.repeat(np.arange(len(a)), extra + 1)
    step = np.arange(len(at)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    out = a[at].copy()
    new = np.flatnonzero(step)
    out[new, along[at[new]]] = (first[at[new]] + sign[at[new]] * (step[new] - 1)) * spacing
    return np.concatenate([out, ring[-1:]])


def wrap(geometry: Geometry) -> tuple[Geometry, bool]:
    """Longitudes brought into -180..180, and whether the geometry lay across the limit."""
    box = bounds(geometry)
    if box is None:
        return geometry, False
    if box[0] >= 180 or box[2] <= -180:
        shift = -360.0 if box[0] >= 180 else 360.0
        return _moved(geometry, lambda x: x + shift), False
    if box[2] > 180 or box[0] < -180:
        return _moved(geometry, lambda x: (x + 180) % 360 - 180), True
    return geometry, False


def transformed(geometry: Geometry, f) -> Geometry:
    """Positions mapped by ``f(x, y)``."""
    kind, parts = geometry
    if kind in ("point", "line", "polygon"):
        return kind, [np.stack(f(p[:, 0], p[:, 1]), 1) for p in parts]
    return kind, [transformed(p, f) for p in parts]


def _moved(geometry: Geometry, f) -> Geometry:
    kind, parts = geometry
    if kind in ("point", "line", "polygon"):
        return kind, [np.stack([f(p[:, 0]), p[:, 1]], 1) for p in parts]
    return kind, [_moved(p, f) for p in parts]


def unwrapped(rings: list[np.ndarray]) -> tuple[list[np.ndarray], bool, bool]:
    """(rings, whether an edge crosses 180 degrees, whether the shell goes round a pole), with every edge taken the short way.

    Longitudes run on beyond 180, holes lie near their shell.  A ring round a pole comes as three turns of it, from one before
    to one behind its own, closed over the nearer pole: an even-odd test is right for any position of its middle turn.
    """
    out, crosses, polar, shell = [], False, False, None
    for ring in rings:
        ring = closed(ring)
        step = np.diff(ring[:, 0])
        far = np.abs(step) > 180
        crosses = crosses or bool(far.any())
        x = ring[0, 0] + np.concatenate(([0.0], np.cumsum(np.where(far, step - 360 * np.round(step / 360), step)))) if far.any() else ring[:, 0]
        turn = x[-1] - x[0]
        if abs(turn) > 180:
            if turn < 0:
                x, ring = x[::-1], ring[::-1]
            x = x - x[0] + (x[0] + 180) % 360 - 180
            polar = polar or shell is None
            pole = 90.0 if ring[:, 1].mean() >= 0 else -90.0
            x, y = np.concatenate([x[:-1] - 360, x[:-1], x + 360]), np.concatenate([ring[:-1, 1], ring[:-1, 1], ring[:, 1]])
            ring = np.stack([np.concatenate([x, [x[-1], x[0], x[0]]]), np.concatenate([y, [pole, pole, y[0]]])], 1)
        else:
            if shell is not None and not polar:
                x = x + 360 * round((shell - (x.min() + x.max()) / 2) / 360)
            ring = np.stack([x, ring[:, 1]], 1)
        if shell is None:
            shell = (x.min() + x.max()) / 2
        out.append(ring)
    if polar:  # holes that do not go round the pole are in all turns
        out = [r for ring in out for r in ([ring] if np.ptp(ring[:, 0]) > 720 else [ring + [360.0 * k, 0.0] for k in (-1, 0, 1)])]
    return out, crosses, polar


def split_antimeridian(geometry: Geometry) -> list[Geometry]:
    """A polygon or line with edges of more than 180 degrees, which go the other way round, cut at 180.

    A polygon is cut straight in degrees, and one round a pole reaches up to it (positions on a cut are strictly inside no part); a line is cut where the great circle of its edge meets 180.
    """
    kind, parts = geometry
    if kind == "line":
        return [("line", [p]) for p in _split_line(parts[0])] if parts else [geometry]
    if kind != "polygon":
        return [geometry]
    rings, crosses, polar = unwrapped(parts)
    if not crosses:
        return [geometry]
    out, x = [], rings[0][:, 0]
    turns = [0] if polar else range(int(np.floor((x.min() + 180) / 360)), int(np.ceil((x.max() + 180) / 360)))
    for k in turns:
        for east in clip(("polygon", rings), 0, 180.0 + 360 * k, True):
            for piece in clip(east, 0, -180.0 + 360 * k, False):
                out.append(_moved(piece, lambda v, k=k: v - 360 * k))
    return out


def _split_line(line: np.ndarray) -> list[np.ndarray]:
    step = np.diff(line[:, 0])
    out, begin = [], [line[0]]
    for k in range(len(step)):
        if abs(step[k]) > 180:
            side = 180.0 if line[k, 0] > 0 else -180.0
            (a, b), (f, g) = np.radians([line[k, 0] - side, line[k + 1, 0] + side]), np.radians(line[[k, k + 1], 1])
            width = np.sin(b - a)
            lat = np.degrees(np.arctan((np.tan(f) * np.sin(b) + np.tan(g) * np.sin(-a)) / width)) if abs(width) > 1e-12 else np.degrees((f + g) / 2)
            if line[k, 0] != side:
                begin.append(np.array([side, lat]))
            if len(begin) > 1:
                out.append(np.array(begin))
            begin = [np.array([-side, lat])] if line[k + 1, 0] != -side else []
        begin.append(line[k + 1])
    if len(begin) > 1 or not out:
        out.append(np.array(begin))
    return out


# -- text forms ---------------------------------------------------------------------------------

_GEOJSON = {"Point": "point", "LineString": "line", "Polygon": "polygon", "MultiPoint": "multipoint", "MultiLineString": "multiline", "MultiPolygon": "multipolygon", "GeometryCollection": "collection"}
_SINGLE = {"multipoint": "point", "multiline": "line", "multipolygon": "polygon"}


def from_geojson(value: str | dict | None) -> Geometry | None:
    value = json.loads(value) if isinstance(value, str) else value
    if not value:
        return None
    kind = _GEOJSON[value["type"]]
    if kind == "collection":
        return kind, [from_geojson(g) for g in value["geometries"]]
    return _from_lists(kind, value["coordinates"])


def _from_lists(kind: str, c: list) -> Geometry:
    arr = lambda p: np.array([q[:2] for q in p], float).reshape(-1, 2)
    if kind == "point":
        return kind, [arr([c])] if c else []
    if kind == "line":
        return kind, [arr(c)] if c else []
    if kind == "polygon":
        return kind, [arr(r) for r in c]
    return kind, [_from_lists(_SINGLE[kind], p) for p in c]


_WKT = {"POINT": "point", "LINESTRING": "line", "LINEARRING": "line", "POLYGON": "polygon", "MULTIPOINT": "multipoint", "MULTILINESTRING": "multiline", "MULTIPOLYGON": "multipolygon", "GEOMETRYCOLLECTION": "collection"}


def from_wkt(text: str | None) -> Geometry | None:
    if not text or not text.strip():
        return None
    tokens = re.findall(r"[A-Za-z]+|[(),]|[-+0-9.eE]+", re.sub(r"^\s*SRID=\d+;", "", text))
    at = 0

    def positions() -> list:
        nonlocal at
        at += 1
        out, own = [], []
        while True:
            t = tokens[at]
            if t == "(":
                out.append(positions())
                continue
            at += 1
            if t in ",)":
                if own:
                    out.append(own)
                    own = []
                if t == ")":
                    return out
            else:
                own.append(float(t))

    def one() -> Geometry:
        nonlocal at
        ring = tokens[at].upper() == "LINEARRING"
        kind = _WKT[tokens[at].upper()]
        at += 1
        while tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if tokens[at].upper() == "EMPTY":
            at += 1
            return kind, []
        if kind == "collection":
            parts = []
            while tokens[at] in "(,":
                at += 1
                parts.append(one())
            at += 1
            return kind, parts
        data = positions()
        if kind == "multipoint":
            return kind, [_from_lists("point", p[0] if isinstance(p[0], list) else p) for p in data]
        # A closed ring stands for the area in it.
        return _from_lists("polygon", [data]) if ring else _from_lists(kind, data[0] if kind == "point" else data)

    return one()
