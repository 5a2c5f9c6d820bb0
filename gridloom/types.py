"""Errors, resolution ranges and other fixed facts about the grids."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_008.8
DEFAULT_CELLS_PER_PIECE = 5000
DEFAULT_PARENT_OFFSET = 6
GEOMETRY = "geometry"


class ParentResolutionException(Exception):
    """The parent resolution is not coarser than the resolution."""


class IdFieldError(ValueError):
    """Compaction was asked for without an id field."""


@dataclass(frozen=True)
class Range:
    low: int
    high: int


RESOLUTIONS = {"geohash": Range(1, 12), "s2": Range(0, 30), "rhp": Range(0, 15), "h3": Range(0, 15), "a5": Range(0, 29)}


def column_name(dggs: str, res: int) -> str:
    return f"{dggs}_{res:02d}"


def check_resolution(dggs: str, res: int) -> int:
    if dggs not in RESOLUTIONS:
        raise ValueError(f"unknown grid {dggs!r}; known: {', '.join(sorted(RESOLUTIONS))}")
    own = RESOLUTIONS[dggs]
    if not own.low <= int(res) <= own.high:
        raise ValueError(f"{dggs} has resolutions {own.low} to {own.high}, not {res}")
    return int(res)


def parent_resolution(dggs: str, res: int, parent: int | None = None) -> int:
    """The given parent resolution, or six levels up; always coarser than ``res``."""
    check_resolution(dggs, res)
    if parent is None:
        parent = max(RESOLUTIONS[dggs].low, res - DEFAULT_PARENT_OFFSET)
    check_resolution(dggs, parent)
    if parent >= res:
        raise ParentResolutionException(f"parent resolution {parent} must be less than resolution {res}")
    return parent


def cell_area(dggs: str, res: int) -> float:
    """The area in square metres of the largest cells: on S2 by the quadratic projection's bound, on H3 at a face's centre, on A5 of all cells, on rHEALPix in the projection's plane, of geohash on the equator."""
    check_resolution(dggs, res)
    square = EARTH_RADIUS_M**2
    if dggs == "s2":
        return 2.635799256963161486 * square / 4**res
    if dggs == "h3":
        return 3**0.5 / 2 * 0.38196601125010500003**2 * square / 7**res
    if dggs == "a5":
        return 4 * 3.141592653589793 * 6_371_007.180918475**2 / (12 if res == 0 else 60 * 4 ** (res - 1))
    if dggs == "rhp":
        return (3.141592653589793 / 2) ** 2 * square / 9**res
    degree = EARTH_RADIUS_M * 3.141592653589793 / 180
    return 360 / (1 << (5 * res + 1) // 2) * degree * (180 / (1 << 5 * res // 2) * degree)
