"""Polygons round the poles, wider than half the globe or across 180 degrees; curves in WKB; pairs of points and polygons; A5 ids."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import a5, geometry as geo
from gridloom.operators import cells as ops
from gridloom.operators import prepare

RES = {"geohash": 3, "s2": 5, "rhp": 3, "h3": 2}


def ring(lat, step=10, east=True):
    lon = np.arange(-180, 180, step, float)
    return np.stack([lon if east else lon[::-1], np.full(len(lon), float(lat))], 1)


def filled(spark, geometry, dggs, split=True):
    df = spark.createDataFrame([(1, geo.encode(geometry))], "id long, geometry binary")
    return {r[0] for r in ops.polyfill(prepare.cleaned(df, ops.grid(dggs).GEODESIC, split=split), dggs, RES[dggs]).collect()}


def all_cells(dggs):
    """(name, longitude, latitude of the centre) of every cell of a level."""
    module = ops.grid(dggs)
    if dggs == "geohash":
        nx, ny = module._bits(RES[dggs])
        names = module.names(*[v.ravel() for v in np.meshgrid(np.arange(1 << nx), np.arange(1 << ny))], RES[dggs])
    else:
        cells = module.roots()
        for level in range(RES[dggs]):
            cells, _ = ops._divided(module, cells)
        names = module.named(cells, RES[dggs])
    lon, lat = module.centers(names.tolist())
    return names, np.asarray(lon), np.asarray(lat)


@pytest.mark.parametrize("dggs", list(RES))
@pytest.mark.parametrize("lat", [75, -75])
def test_rings_round_a_pole(spark, dggs, lat):
    names, x, y = all_cells(dggs)
    # S2's edges are great circles, which bend towards the pole by half a degree between these vertices.  Where a shape is cut, centres on the cut are in neither part.
    off = lambda at: np.abs(np.abs(y) - at) > (0.6 if dggs == "s2" else 1e-9)
    clear = np.ones(len(x), bool) if dggs in ("s2", "h3") else (np.abs(x) < 180 - 1e-9) & (np.abs(y) < 90 - 1e-9)
    inside = (np.abs(y) > abs(lat)) & (np.sign(y) == np.sign(lat))
    sure = set(names[off(75) & clear])
    for east in (True, False):
        assert filled(spark, ("polygon", [ring(lat, east=east)]), dggs) & sure == set(names[inside]) & sure
    sure = set(names[off(75) & off(83) & clear])
    hole = ("polygon", [ring(lat), ring(lat + (8 if lat > 0 else -8), 15)])
    assert filled(spark, hole, dggs) & sure == set(names[inside & (np.abs(y) < 83)]) & sure


@pytest.mark.parametrize("dggs", ["geohash", "rhp", "h3"])
def test_wide_and_crossing_boxes(spark, dggs):
    names, x, y = all_cells(dggs)
    lon = np.arange(-120, 121, 10, float)
    wide = np.concatenate([np.stack([lon, np.full(25, -10.0)], 1), np.stack([lon[::-1], np.full(25, 10.0)], 1)])
    assert filled(spark, ("polygon", [wide]), dggs) == set(names[(np.abs(x) < 120) & (np.abs(y) < 10)])
    east = np.arange(130, 251, 10, float)  # 130 east to 110 west
    across = np.concatenate([np.stack([east, np.full(13, -10.0)], 1), np.stack([east[::-1], np.full(13, 10.0)], 1)])
    across[:, 0] = (across[:, 0] + 180) % 360 - 180
    want = set(names[((x > 130) | (x < -110)) & (np.abs(y) < 10)])
    assert filled(spark, ("polygon", [across]), dggs) == want
    hole = np.array([(170, -5), (-170, -5), (-170, 5), (170, 5)], float)
    assert filled(spark, ("polygon", [across, hole]), dggs) == want - set(names[((x >= 170) | (x <= -170)) & (np.abs(y) <= 5)])


def test_lines_are_cut_on_their_great_circle():
    west, east = geo.split_antimeridian(("line", [np.array([(170.0, 60.0), (-170.0, 60.0), (-160.0, 50.0)])]))
    assert west[1][0][-1].tolist() == pytest.approx([180, 60.379], abs=1e-3) and east[1][0][0].tolist() == pytest.approx([-180, 60.379], abs=1e-3)
    assert len(west[1][0]) == 2 and len(east[1][0]) == 3
    equator = geo.split_antimeridian(("line", [np.array([(179.0, 0.0), (-179.0, 0.0)])]))
    assert [p[1][0].tolist() for p in equator] == [[[179, 0], [180, 0]], [[-180, 0], [-179, 0]]]
    assert geo.split_antimeridian(("line", [np.array([(0.0, 0.0), (10.0, 0.0)])]))[0][1][0].tolist() == [[0, 0], [10, 0]]


def test_curves_are_read_past_and_counted(spark):
    positions = lambda *p: struct.pack("<I", len(p)) + np.array(p, "<f8").tobytes()
    head = lambda code: struct.pack("<BI", 1, code)
    arc = head(8) + positions((0, 0), (1, 1), (2, 0))
    line = geo.encode(("line", [np.array([(2.0, 0.0), (0.0, 0.0)])]))
    compound = head(9) + struct.pack("<I", 2) + arc + line
    point = geo.encode(("point", [np.array([(3.0, 4.0)])]))
    triangle = head(17) + struct.pack("<I", 1) + positions((0, 0), (1, 0), (0, 1), (0, 0))
    odd = [arc, compound, head(10) + struct.pack("<I", 1) + compound, head(11) + struct.pack("<I", 1) + arc, head(12) + struct.pack("<I", 0), head(15) + struct.pack("<I", 0), head(16) + struct.pack("<I", 1) + triangle, triangle, head(99), head(1008) + struct.pack("<I", 0)]
    assert all(geo.decode(raw) == ("other", []) for raw in odd)
    mixed = head(7) + struct.pack("<I", 3) + compound + triangle + point
    assert [(k, p[0].tolist()) for k, p in geo.flat(geo.decode(mixed))] == [("point", [[3, 4]])]
    df = spark.createDataFrame([(k, raw) for k, raw in enumerate([*odd, mixed, point, None])], "id long, geometry binary")
    assert tuple(prepare.emptied(df).first()) == (13, 11)
    assert prepare.cleaned(df).count() == 2


def test_pairs_keep_repeated_rows_and_names(spark):
    square = lambda x: np.array([(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)], float)
    both = ("multipolygon", [("polygon", [square(0)]), ("polygon", [square(5)])])  # overlapping parts
    polygons = spark.createDataFrame([("a", geo.encode(both)), ("b", geo.encode(("polygon", [square(0)]))), ("b", geo.encode(("polygon", [square(0)])))], "name string, geometry binary")
    points = spark.createDataFrame([(7.0, 5.0, "p")] * 3 + [(12.0, 5.0, "q"), (30.0, 5.0, "r"), (None, 5.0, "s")], "lon double, lat double, name string")
    out = ops.points_in_polygons(points, polygons, res=3)
    assert out.columns == ["lon", "lat", "name", "name"]
    assert sorted((r[2], r[3]) for r in out.collect()) == [("p", "a")] * 3 + [("p", "b")] * 6 + [("q", "a")]


def test_a5_ids(spark):
    faces = spark.range(12).select(a5.named(F.shiftleft("id", 58).bitwiseOR(F.lit(1 << 57))).alias("cell"))
    one = faces.select("cell", a5.resolution(F.col("cell")).alias("res"), a5.children(F.col("cell"), 0, 1).alias("kids"), a5.children(F.col("cell"), 0, 4).alias("deep"), a5.representative(F.col("cell"), 4).alias("first")).collect()
    assert len({r.cell for r in one}) == 12 and {r.res for r in one} == {0}
    assert len({k for r in one for k in r.kids}) == 60 and len({k for r in one for k in r.deep}) == 12 * 320
    assert all(r.first == r.deep[0] for r in one)
    for res in (1, 2, 3, 8, 28, 29):
        kids = faces.select("cell", F.explode(a5.children(F.col("cell"), 0, 1)).alias("kid"))
        at = kids.select("cell", "kid", (a5.representative(F.col("kid"), res) if res > 1 else F.col("kid")).alias("leaf"))
        for r in at.select("cell", "kid", "leaf", a5.resolution(F.col("leaf")).alias("res"), a5.parent(F.col("leaf"), 0).alias("up"), a5.parent(F.col("leaf"), 1).alias("fifth")).collect():
            assert (r.res, r.up, r.fifth) == (res, r.cell, r.kid) and a5.ancestor(r.leaf, 0) == r.cell and a5.ancestor(r.leaf, 1) == r.kid and a5.ancestor(r.leaf, res) == r.leaf
    with pytest.raises(ImportError):
        ops.grid("a5")
    with pytest.raises(Exception, match="not finer"):
        faces.select(a5.representative(F.col("cell"), 0)).collect()
