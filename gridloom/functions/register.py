"""The grids as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.functions import geohash
from gridloom.operators import cells as ops
from gridloom.types import RESOLUTIONS, check_resolution


def fill(grid: str, parts: list[np.ndarray], res: int) -> Iterator[list[str]]:
    """The cells of a polygon, block by block."""
    module = ops.grid(grid)
    for block, need in ops.blocks(module, parts, check_resolution(grid, res)):
        yield ops.fill_block(module, block, need, res).tolist()


def resolution_of(grid: str, cell: str) -> int:
    return len(cell) if grid == "geohash" else len(cell) - 1 if grid == "rhp" else int(cell, 16) >> 52 & 15 if grid == "h3" else ops.grid(grid).split(cell)[3]


def children_of(grid: str, cell: str, res: int) -> list[str]:
    """The descendants of a cell at ``res``, in the order of their names; the cell itself at its own resolution."""
    module, level = ops.grid(grid), resolution_of(grid, cell)
    if not level <= res <= RESOLUTIONS[grid].high:
        raise ValueError(f"{cell} has no descendants at {res}")
    if grid == "geohash":
        return [cell + "".join(rest) for rest in product(geohash.ALPHABET, repeat=res - level)]
    found = module.numbers([cell]).astype(np.int64)[:, None] if grid == "h3" else np.array([module.split(cell)[:3]], np.int64)
    for _ in range(res - level):
        found = module.divide(found)
    return sorted(module.named(found, res).tolist())


class Cells:
    """Rows (cell) of a point, line or polygon; a part's blocks go out one after the other, so no list of all cells is made.

    Of several parts, a cell that an earlier part gave is not given again.
    """

    def eval(self, grid: str, wkb: bytes, res: int):
        if grid is None or wkb is None or res is None:
            return
        module, parts = ops.grid(grid), []
        for part in geo.flat(geo.decode(wkb)):
            moved, across = geo.wrap(part)
            parts += geo.split_antimeridian(moved) if across and not module.GEODESIC else [moved]
        seen: set[str] = set()
        for kind, rings in parts:
            for cells in fill(grid, rings, res) if kind == "polygon" else [ops.trace(module, rings[0], check_resolution(grid, res))]:
                new = dict.fromkeys(c for c in cells if c not in seen)
                if len(parts) > 1:
                    seen.update(new)
                for cell in new:
                    yield (cell,)


def register(spark: SparkSession) -> list[str]:
    """Make the functions below known to ``spark.sql``; returns their names.  All work on Arrow batches; nulls give nulls.

    ``dggs_point_to_cell(grid, lon, lat, res)``, ``dggs_polyfill(grid, wkb, res)`` (polygons), ``dggs_linetrace(grid, wkb,
    res)`` (lines and points), ``dggs_parent(grid, cell, res)``, ``dggs_children(grid, cell, res)``, ``dggs_resolution(grid,
    cell)``, ``dggs_center(grid, cell)`` and ``dggs_boundary(grid, cell)`` (WKB); and the table function ``dggs_cells(grid,
    wkb, res)``, for use with LATERAL.
    """

    def grouped(f: Callable, *by: int) -> Callable:
        """A function of whole columns, called once for each grid (and resolution) of a batch, for the rows without nulls."""

        def run(*columns):
            table = pd.DataFrame(dict(enumerate(columns)))
            out = pd.Series([None] * len(table), dtype=object)
            for key, rows in table.dropna().groupby(list(by)):
                out.loc[rows.index] = pd.Series(list(f(*key, *[rows[k].to_numpy() for k in table if k not in by])), index=rows.index, dtype=object)
            return out

        return run

    def each(f: Callable) -> Callable:
        return lambda *columns: pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    def point_to_cell(grid, res, lon, lat):
        return ops.grid(grid).encode(lon, lat, check_resolution(grid, int(res))).tolist()

    def polyfill(grid, wkb, res):
        return sorted({c for kind, parts in geo.flat(geo.decode(wkb)) if kind == "polygon" for cells in fill(grid, parts, int(res)) for c in cells})

    def linetrace(grid, wkb, res):
        return list(dict.fromkeys(c for kind, parts in geo.flat(geo.decode(wkb)) if kind != "polygon" for c in ops.trace(ops.grid(grid), parts[0], check_resolution(grid, int(res)))))

    def parent(grid, cell, res):
        level = resolution_of(grid, cell)
        if not RESOLUTIONS[grid].low <= res <= level:
            raise ValueError(f"{cell} has no ancestor at {res}")
        return ops.ancestor(grid, cell, level, int(res))

    def children(grid, cell, res):
        return children_of(grid, cell, int(res))

    def center(grid, cell):
        return [geo.encode(("point", [np.array([p])])) for p in zip(*ops.grid(grid).centers(cell.tolist()), strict=True)]

    def boundary(grid, cell):
        return geo.encode(("polygon", [ops.grid(grid).boundary(cell)]))

    # name: (function of columns, how many, type)
    made = {
        "dggs_point_to_cell": (grouped(point_to_cell, 0, 3), 4, "string"), "dggs_polyfill": (each(polyfill), 3, "array<string>"), "dggs_linetrace": (each(linetrace), 3, "array<string>"),
        "dggs_parent": (each(parent), 3, "string"), "dggs_children": (each(children), 3, "array<string>"), "dggs_resolution": (each(resolution_of), 2, "int"), "dggs_center": (grouped(center, 0), 2, "binary"),
        "dggs_boundary": (each(boundary), 2, "binary"),
    }
    arity = {2: lambda f: lambda a, b: f(a, b), 3: lambda f: lambda a, b, c: f(a, b, c), 4: lambda f: lambda a, b, c, d: f(a, b, c, d)}
    for name, (f, n, kind) in made.items():
        typed = arity[n](f)
        typed.__annotations__ = {k: pd.Series for k in [*typed.__code__.co_varnames, "return"]}
        spark.udf.register(name, F.pandas_udf(typed, kind))
    spark.udtf.register("dggs_cells", F.udtf(Cells, returnType="cell string", useArrow=True))
    return sorted([*made, "dggs_cells"])
