"""Geometry kernels, coordinate systems, the index pipeline with its options, and the spatial join."""

import json
import logging
import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.functions import geohash, geometry as geo, h3, s2
from gridloom.functions.crs import crs
from gridloom.functions.register import register
from gridloom.index import index, index_to_parquet, threshold_of
from gridloom.operators import cells as ops
from gridloom.operators import prepare
from gridloom.sources import geoparquet, read as src
from gridloom.sources import write as out
from gridloom.types import cell_area


def ring(*p):
    return np.array([*p, p[0]], float)


def box(x0, y0, x1, y1):
    return "polygon", [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def features(spark, *shapes):
    return spark.createDataFrame([(f"f{k}", bytearray(geo.encode(g)) if g else None) for k, g in enumerate(shapes)], "id string, geometry binary")


def total(pieces):
    return sum(geo.area(p) for _, p in pieces)


# -- geometry -----------------------------------------------------------------------------------


def test_repair():
    bow = ("polygon", [ring((0, 0), (10, 10), (10, 0), (0, 10))])
    assert len(geo.make_valid(bow)) == 2 and total(geo.make_valid(bow)) == 50 and abs(total(geo.bisect(bow, 3)) - 50) < 1e-9
    star = ("polygon", [np.array([(math.cos(t), math.sin(t)) for t in math.pi / 2 + np.arange(6) * 4 * math.pi / 5])])
    assert len(geo.make_valid(star)) == 5
    fine = box(0, 0, 4, 4)
    assert [p[0].tolist() for _, p in geo.make_valid(fine)] == [fine[1][0].tolist()]
    line = ("line", [np.array([(0.0, 0), (1, 1), (1, 0), (0, 1)])])
    assert geo.make_valid(line) == [line]
    assert geo.make_valid(("polygon", [ring((0, 0), (1, 1))])) == []


def test_repair_and_clip_keep_the_even_odd_inside():
    r = np.random.default_rng(5)
    for _ in range(300):
        p = r.integers(0, 12, (r.integers(4, 12), 2)).astype(float)
        shape = [np.concatenate([p, p[:1]])]
        x, y = r.random((2, 2000)) * 12
        want = geo.inside(shape, x, y)
        valid = geo.make_valid(("polygon", shape))
        got = np.zeros(2000, int)
        for _, rings in valid:
            got += geo.inside(rings, x, y)
        assert (got == want).all()
        for axis, below in ((0, True), (0, False), (1, True), (1, False)):
            part = np.zeros(2000, int)
            for _, rings in valid:
                for _, q in geo.half(rings, axis, 5.3, below):
                    part += geo.inside(q, x, y)
            side = (x, y)[axis] < 5.3 if below else (x, y)[axis] > 5.3
            assert (part == (want & side)).all()


def test_concave_shapes_fall_apart():
    u = ("polygon", [ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10))])
    upper = geo.clip(u, 1, 5.0, False)
    assert len(upper) == 2 and total(upper) == 30 and total(geo.clip(u, 1, 5.0, True)) == 42
    hole = ("polygon", [*box(0, 0, 10, 10)[1], *box(2, 2, 8, 8)[1]])
    assert total(geo.clip(hole, 0, 5.0, True)) == 32 and [len(p) for _, p in geo.clip(hole, 0, 1.0, False)] == [2]
    assert abs(total(geo.bisect(hole, 0.05)) - 64) < 1e-9


def test_even_odd_against_all_edges():
    r = np.random.default_rng(6)
    for _ in range(50):
        p = r.integers(0, 9, (8, 2)).astype(float)
        x, y = r.integers(0, 90, (2, 500)) / 10
        odd, on = np.zeros(500, bool), np.zeros(500, bool)
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0), strict=True):
            cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
            on |= (np.abs(cross) < 1e-12) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1)) & ((x0 != x1) | (y0 != y1))
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        clear = ~on
        edges = geo.edges_of([p])
        assert (geo.within(edges, x, y)[clear] == odd[clear]).all()
        for bx, by in ((0, 0), (3, 3), (6, 2)):
            here = clear & (x >= bx) & (x <= bx + 3) & (y >= by) & (y <= by + 3)
            assert (geo.within(geo.near_edges(edges, (bx, by, bx + 3, by + 3)), x[here], y[here]) == odd[here]).all()


def test_cut_edges_have_vertices_at_multiples():
    pieces = geo.bisect(box(0, 0, 1, 1), 0.05, spacing=0.01)
    assert len(pieces) > 2 and abs(total(pieces) - 1) < 1e-9
    for _, (shell, *_) in pieces:
        for (x0, y0), (x1, y1) in zip(shell[:-1], shell[1:], strict=True):
            outer = y0 == y1 and y0 in (0, 1) or x0 == x1 and x0 in (0, 1)
            assert outer or math.hypot(x1 - x0, y1 - y0) <= 0.01001
    lines = {0: np.array([2.0]), 1: np.array([])}
    up = geo.densify(np.array([(2.0, 0.05), (2.0, 0.35), (5.0, 0.35)]), lines, 0.1)
    down = geo.densify(np.array([(2.0, 0.35), (2.0, 0.05)]), lines, 0.1)
    assert np.allclose(up, [(2, 0.05), (2, 0.1), (2, 0.2), (2, 0.3), (2, 0.35), (5, 0.35)]) and np.allclose(down, up[4::-1])


def test_t_junction_keeps_its_cell():
    """The spacing of cut edges closes the gap between two great circles along one parallel."""
    cut, spacing = -41.857542761228, 0.0002838765651889054
    pieces = [box(173.1988782522566, -41.88, 173.2559078324737, cut), box(173.2063719775, cut, 173.247464236, -41.84)]

    def tokens(shapes):
        return {c for _, parts in shapes for b, need in ops.blocks(s2, parts, 15) for c in ops.fill_block(s2, b, need, 15).tolist()}

    assert "6d3a4841c" not in tokens(pieces)
    lines = {0: np.array([]), 1: np.array([cut])}
    assert "6d3a4841c" in tokens([(k, [geo.densify(r, lines, spacing) for r in parts]) for k, parts in pieces])


def test_large_ring_is_filled_fast():
    import time

    t = np.linspace(0, 2 * np.pi, 20001)
    r = 0.5 * (1 + 0.3 * np.sin(40 * t) + 0.05 * np.sin(900 * t))
    shape = np.stack([174 + r * np.cos(t), -41 + r * np.sin(t)], 1)
    shape[-1] = shape[0]
    began = time.time()
    made = list(ops.blocks(geohash, [shape], 7))
    n = sum(len(ops.fill_block(geohash, b, need, 7)) for b, need in made)
    assert time.time() - began < 10 and sum(len(need) for _, need in made) < 3 * 32 * len(shape)
    w, h = 360 / (1 << 18), 180 / (1 << 17)
    assert abs(n * w * h / geo.area([shape]) - 1) < 0.001


# -- H3 -----------------------------------------------------------------------------------------


def test_h3_known_answers():
    known = {(37.3615593, -122.0553238, 5): "85283473fffffff", (37.3615593, -122.0553238, 7): "87283472bffffff", (37.7752702151959, -122.418307270836, 9): "8928308280fffff", (40.689167, -74.044444, 10): "8a2a1072b59ffff", (0, 0, 0): "8075fffffffffff"}
    assert all(h3.encode([lon], [lat], res).tolist() == [want] for (lat, lon, res), want in known.items())
    assert np.flatnonzero(h3.tables().pentagon).tolist() == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    lon, lat = h3.centers(["85283473fffffff"])
    assert abs(lat[0] - 37.34579337536848) < 1e-9 and abs(lon[0] + 121.97637597255124) < 1e-9


def test_h3_hierarchy_of_the_whole_sphere():
    cells = h3.roots()
    for res in range(1, 4):
        cells = h3.divide(cells)
        assert len(cells) == 2 + 120 * 7**res == len(np.unique(cells))
        lon, lat = s2.lonlat(h3.middle(cells, res))
        assert (h3.ids(lon, lat, res) == cells[:, 0]).all()


def test_h3_outlines_hold_their_cells():
    r = np.random.default_rng(2)
    lon, lat = r.uniform(-170, 170, 60), r.uniform(-60, 60, 60)
    for res in (2, 3, 6):
        for name in [*h3.encode(lon, lat, res).tolist(), f"{h3._pack(np.array([24]), np.zeros((1, res), np.int64))[0]:x}"]:
            outline = h3.boundary(name)
            five = bool(h3.tables().pentagon[int(name, 16) >> 45 & 127]) and not h3._unpack(h3.numbers([name]), res)[1].any()
            assert len(outline) >= (6 if five else 7)
            c = np.array(h3.centers([name])).T
            x = outline - c
            x[:, 0] = (x[:, 0] + 180) % 360 - 180
            t = r.uniform(0.0, 0.97, (40, 1))
            k = r.integers(0, len(x) - 1, 40)
            inner = c + t * (x[k] + r.uniform(0, 1, (40, 1)) * (x[k + 1] - x[k]))
            assert (h3.encode(*inner.T, res) == name).mean() > 0.97
            outer = c + 1.05 * x[:-1]
            assert (h3.encode(*outer.T, res) != name).all()


def test_h3_pentagon_compaction(spark):
    top = f"{h3._pack(np.array([24]), np.zeros((1, 2), np.int64))[0]:x}"
    leaves = spark.createDataFrame([(1, top), (2, top)], "id int, up string").select("id", F.posexplode(h3.children(F.col("up"), 2, 4)).alias("k", "h3_04"))
    assert leaves.where("id = 1").count() == 41 == leaves.where("id = 1").distinct().count()
    packed = ops.compact(leaves.where("id = 1 or k <> 40"), "h3", 4, 2, "id").collect()
    assert [r.h3_04 for r in packed if r.id == 1] == [top] and sum(r.id == 2 for r in packed) == 5 + 6
    free = ops.compact_all(leaves.where("id = 1").select("id", F.col("h3_04").alias("cell")), "h3", "id").collect()
    assert [r.cell for r in free] == [top]


@pytest.mark.parametrize("dggs,res", [("h3", 9), ("rhp", 8), ("s2", 14), ("geohash", 6)])
def test_traces_together_are_traces_alone(spark, dggs, res):
    a, b = (("line", [np.array(p)]) for p in ([(174.75, -41.30), (174.85, -41.30)], [(174.80, -41.25), (174.80, -41.35)]))
    both = ops.polyfill(features(spark, a, b), dggs, res).collect()
    assert len(both) == len(set(both))
    for k, line in enumerate((a, b)):
        assert {r[0] for r in both if r.id == f"f{k}"} == set(ops.trace(ops.grid(dggs), line[1][0], res))


def test_h3_path_is_connected():
    for a, b, res in (((174.75, -41.3), (174.95, -41.1), 8), ((-20.0, 30.0), (40.0, 45.0), 3), ((170.0, 0.0), (-170.0, 5.0), 3)):
        way = h3.path(a, b, res)
        assert way[0] == h3.ids(np.array([a[0]]), np.array([a[1]]), res)[0] and way[-1] == h3.ids(np.array([b[0]]), np.array([b[1]]), res)[0]
        p = h3.middle(np.array(way)[:, None], res)
        assert len(way) > 3 and np.arccos(np.clip((p[1:] * p[:-1]).sum(1), -1, 1)).max() < 1.25 * h3.UNIT / h3.ROOT7**res


# -- systems ------------------------------------------------------------------------------------


def test_projections():
    x, y = crs(2193).forward([172.739194], [-34.444066])
    assert abs(x[0] - 1576041.15) < 0.1 and abs(y[0] - 6188574.24) < 0.2
    x, y = crs(32633).forward([12.0], [55.0])
    assert abs(x[0] - 308124.37) < 0.01 and abs(y[0] - 6098907.83) < 0.01
    for name, lon, lat in ((2193, 173, -41), (32733, 15, -20), (2230, -117, 33), (2154, 3, 46), (3857, 10, 20), ("+proj=aeqd +lat_0=0 +lon_0=180", 179.5, 0.4), ("+proj=aeqd +lat_0=-41 +lon_0=174", 175, -40), ("+proj=merc", 10, 20)):
        lons, lats = lon + np.linspace(-1, 1, 11), lat + np.linspace(-1, 1, 11)
        back = crs(name).inverse(*crs(name).forward(lons, lats))
        assert np.abs((back[0] - lons + 180) % 360 - 180).max() < 1e-9 and np.abs(back[1] - lats).max() < 1e-9
    with pytest.raises(ValueError):
        crs(9999)


def test_default_thresholds():
    area = cell_area("h3", 9)
    assert abs(area / 127090.737 - 1) < 0.001 and abs(cell_area("rhp", 3) / 137381550930.8 - 1) < 0.001 and abs(cell_area("geohash", 5) / 4.89e3**2 - 1) < 0.01
    assert threshold_of("auto", "h3", 9, 2193) == 5000 * area
    assert abs(threshold_of("auto", "h3", 5, 2230) / (5000 * cell_area("h3", 5) / (1200 / 3937) ** 2) - 1) < 1e-9
    assert abs(threshold_of("auto", "h3", 5, 4167) / (5000 * cell_area("h3", 5) / 111195**2) - 1) < 0.001
    assert prepare.blade_spacing("geohash", 5, False, 4326) is None and abs(prepare.blade_spacing("s2", 15, True, 4326) - 0.0002838765651889054) < 1e-7


# -- pipeline -----------------------------------------------------------------------------------


def test_projected_square_over_the_antimeridian(spark):
    """A square of 200 km about (180, 0) gives cells on both sides, and none elsewhere."""
    square = features(spark, box(-1e5, -1e5, 1e5, 1e5))
    for dggs, res in (("rhp", 5), ("geohash", 4), ("s2", 8), ("h3", 4)):
        got = [r[0] for r in index(square, dggs, res, id_field="id", crs="+proj=aeqd +lat_0=0 +lon_0=180").collect()]
        lon, _ = ops.grid(dggs).centers(got)
        assert len(got) and (np.abs(lon) > 178).all() and (lon > 0).any() and (lon < 0).any()


def test_reprojection_and_cutting_do_not_change_cells(spark):
    degrees = [ring((174.0, -41.5), (175.0, -41.3), (174.7, -40.8))]
    metres = ("polygon", [np.stack(crs(2193).forward(*r.T), 1) for r in degrees])
    plain = {r[0] for r in index(features(spark, ("polygon", degrees)), "h3", 7, id_field="id").collect()}
    moved = {r[0] for r in index(features(spark, metres), "h3", 7, id_field="id", crs=2193).collect()}
    cut = {r[0] for r in index(features(spark, metres), "h3", 7, id_field="id", crs=2193, cut_threshold="auto", spatial_sorting="hilbert", chunksize=1, threads=3).collect()}
    assert plain == moved == cut and plain


def test_invalid_and_sorted_rows(spark):
    shapes = [box(k, 0, k + 1, 1) for k in range(20)]
    for method in prepare.SORTS:
        rows = prepare.spatially_sorted(features(spark, *shapes), method, 5, 20)
        assert rows.columns == ["id", "geometry"] and rows.rdd.getNumPartitions() == 4 and rows.count() == 20
    with pytest.raises(ValueError):
        prepare.spatially_sorted(features(spark, *shapes), "zorder")
    x, y = np.meshgrid(np.arange(16), np.arange(16))
    key = prepare.curve((x.ravel() + 0.5) * 360 / 16 - 180, (y.ravel() + 0.5) * 180 / 16 - 90, "hilbert", 4)
    order = np.argsort(key)
    assert sorted(key.tolist()) == list(range(256)) and (np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order])) == 1).all()


def write_geojson(path, shapes):
    rows = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [r.tolist() for r in g[1]]} if g else None} for n, g in shapes]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    return str(path)


def test_dropped_features_are_reported(spark, tmp_path, caplog):
    tiny = box(174.75, -41.30001, 174.75001, -41.30)
    path = write_geojson(tmp_path / "in.geojson", [("big", box(174.7, -41.3, 174.9, -41.2)), ("tiny", tiny), ("none", None)])
    with caplog.at_level(logging.INFO, "gridloom"):
        index_to_parquet(spark, path, str(tmp_path / "out"), "h3", 7, id_field="name", cut_threshold="auto")
    said = [r.getMessage() for r in caplog.records]
    assert any("2 of 3" in m and "no cell" in m for m in said) and any("1 of 3" in m and "geometry" in m for m in said) and any("larger than" in m for m in said)
    nothing = write_geojson(tmp_path / "tiny.geojson", [("tiny", tiny)])
    caplog.clear()
    index_to_parquet(spark, nothing, str(tmp_path / "out"), "h3", 5, id_field="name", overwrite=True)
    assert any("no feature" in r.getMessage() for r in caplog.records) and not [f for f in os.listdir(tmp_path / "out") if "=" in f]


@pytest.mark.parametrize("dggs,options", [("geohash", {"id_field": "name"}), ("h3", {"id_field": "name", "cut_threshold": 1e-3, "compact": True, "parent_res": 2}), ("geohash", {"id_field": "name", "geo": "point"})])
def test_source_is_read_once(spark, tmp_path, monkeypatch, caplog, dggs, options):
    shapes = [(f"s{k}", box(10 + k, 0, 10.5 + k, 0.5)) for k in range(6)]
    rows = spark.createDataFrame([(n, bytearray(geo.encode(g))) for n, g in shapes], "name string, geometry binary").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    table = rows.mapInArrow(counted, rows.schema).withMetadata("geometry", {"crs": "EPSG:4326"})
    monkeypatch.setattr(src, "read", lambda *_: table)
    with caplog.at_level(logging.INFO, "gridloom"):
        index_to_parquet(spark, "-", str(tmp_path / "out"), dggs, 4, **options)
    assert reads.value == 6
    said = [r.getMessage() for r in caplog.records]
    assert not any("dropped" in m for m in said) and ("cut_threshold" not in options or any("6 of 6 features are larger" in m for m in said))
    assert out.read_cells(spark, str(tmp_path / "out")).select("name").distinct().count() == 6


def test_counts_of_a_watched_job(spark):
    shapes = [geo.encode(box(10, 0, 12, 2)), geo.encode(box(10, 0, 10.1, 0.1)), None, geo.encode(("polygon", []))]
    df = spark.createDataFrame([(k % 2, None if g is None else bytearray(g)) for k, g in enumerate(shapes)], "k int, geometry binary")
    seen = Observation()
    assert prepare.watched(df, 1.0, seen).groupBy("k").count().count() == 2
    assert seen.get == {"n": 4, "n_empty": 2, "n_large": 1} == prepare.judged(df, 1.0).agg(*prepare.counts()).first().asDict()
    assert prepare.judged(df, 0.0).agg(*prepare.counts()).first().n_large == 0
    assert tuple(prepare.judged(df.limit(0), 1.0).agg(*prepare.counts()).first()) == (0, 0, 0)


def test_geoparquet_output(spark, tmp_path):
    path = write_geojson(tmp_path / "in.geojson", [("a", box(10, 0, 11, 1)), ("b", box(20, 0, 21, 1))])
    target = str(tmp_path / "cells")
    index_to_parquet(spark, path, target, "geohash", 4, parent_res=2, id_field="name", geo="polygon", compression="brotli")
    files = [f"{target}/{d}/{f}" for d in os.listdir(target) if "=" in d for f in os.listdir(f"{target}/{d}") if f.endswith(".parquet")]
    assert len(files) == len({os.path.dirname(f) for f in files}) > 1
    found = [pq.read_metadata(f).metadata[b"geo"].decode() for f in files]
    for f, raw in zip(files, found, strict=True):
        own = json.loads(raw)["columns"]["geometry"]
        shapes = [geo.bounds(geo.decode(v)) for v in pq.read_table(f, partitioning=None).column("geometry").to_pylist()]
        assert own["geometry_types"] == ["Polygon"] and own["bbox"] == [*np.min([s[:2] for s in shapes], 0), *np.max([s[2:] for s in shapes], 0)]
    merged = json.loads(geoparquet.merged_metadata([*found, geoparquet.geo_metadata(None, ["Point"])]))["columns"]["geometry"]
    assert merged["geometry_types"] == ["Point", "Polygon"] and merged["bbox"][0] <= 10 and merged["bbox"][2] >= 21
    index_to_parquet(spark, path, target, "geohash", 4, parent_res=2, id_field="name", geo="polygon", compression="zstd", overwrite=True)
    assert out.read_cells(spark, target).count() == index(src.read(spark, path), "geohash", 4, id_field="name").count()
    assert geoparquet.crs_of_footer(target) == "EPSG:4326" and src.require_crs(src.read(spark, target)) == "EPSG:4326"
    files = [f"{target}/{d}/{f}" for d in os.listdir(target) if "=" in d for f in os.listdir(f"{target}/{d}") if f.endswith(".parquet")]
    whole = geoparquet.merged_metadata([pq.read_metadata(f).metadata[b"geo"].decode() for f in files])
    assert os.path.exists(f"{target}/_metadata") and geoparquet.footer(target) == json.loads(whole)


def test_ids_count_from_zero(spark):
    rows = spark.range(100, 0, -1, 7).select(F.col("id").alias("x"), F.lit(None).cast("binary").alias("geometry"))
    got = prepare.with_id(rows, None, True).collect()
    assert [r.fid for r in got] == list(range(100)) and [r.x for r in got] == list(range(100, 0, -1))
    assert prepare.with_id(rows.limit(0), None, True).count() == 0


def test_points_in_polygons(spark):
    r = np.random.default_rng(4)
    x, y = r.uniform(170, 176, 3000), r.uniform(-44, -40, 3000)
    u = ("polygon", [ring((171, -43), (175, -43), (175, -41), (174, -41), (174, -42), (172, -42), (172, -41), (171, -41))])
    hole = ("polygon", [*box(172, -44, 174, -42)[1], *box(172.5, -43.5, 173.5, -42.5)[1]])
    shapes = [u, hole, ("multipolygon", [box(170, -44, 171, -43), box(170.5, -43.5, 171.5, -42.5)])]
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0)], "p long, lon double, lat double")
    got = {(r.p, r.id) for r in ops.points_in_polygons(points, features(spark, *shapes), res=3).collect()}
    want = {(int(k), f"f{n}") for n, s in enumerate(shapes) for part in geo.flat(s) for k in np.flatnonzero(geo.inside(part[1], x, y))}
    assert got == want and want


def test_s2_cells_that_a_polygon_meets(spark):
    shape = ("polygon", [ring((174.0, -41.5), (175.0, -41.3), (174.7, -40.8))])
    met = {r[0] for r in ops.polyfill(features(spark, shape), "s2", 10, mode="intersects").select("s2_10").collect()}
    inner = {r[0] for r in ops.polyfill(features(spark, shape), "s2", 10).select("s2_10").collect()}
    x, y = np.meshgrid(np.linspace(174, 175, 700), np.linspace(-41.5, -40.8, 700))
    p, q = x.ravel(), y.ravel()
    hit = geo.inside([np.concatenate([np.stack(s2.lonlat((1 - t) * s2.xyz(*a) + t * s2.xyz(*b)), -1)[None] for a, b in zip(shape[1][0][:-1], shape[1][0][1:], strict=True) for t in np.linspace(0, 1, 100)[:-1]])], p, q)
    assert inner < met and set(s2.encode(p[hit], q[hit], 10).tolist()) <= met
    with pytest.raises(ValueError):
        ops.polyfill(features(spark, shape), "h3", 7, mode="intersects")


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([("h3", 174.7, -41.3, 7), ("s2", 174.7, -41.3, 12), ("geohash", 174.7, -41.3, 5), ("rhp", 174.7, -41.3, 6), ("h3", None, 1.0, 7)], "g string, x double, y double, r int").createOrReplaceTempView("sites")
    rows = spark.sql("select g, r, c, dggs_resolution(g, c) res, dggs_parent(g, c, r - 2) p, dggs_center(g, c) m, dggs_boundary(g, c) b from (select *, dggs_point_to_cell(g, x, y, r) c from sites)").collect()
    for r in rows[:4]:
        module = ops.grid(r.g)
        assert r.c == module.encode([174.7], [-41.3], r.r)[0] and r.res == r.r and r.p == ops.ancestor(r.g, r.c, r.r, r.r - 2)
        m = geo.decode(r.m)[1][0]
        assert module.encode(m[:, 0], m[:, 1], r.r)[0] == r.c and geo.decode(r.b)[0] == "polygon"
    assert rows[4].c is None
    features(spark, box(174.7, -41.3, 174.9, -41.2), ("line", [np.array([(174.7, -41.3), (174.9, -41.2)])])).createOrReplaceTempView("shapes")
    filled = spark.sql("select dggs_polyfill('h3', geometry, 8) f, dggs_linetrace('h3', geometry, 8) t from shapes").collect()
    assert filled[0].f and not filled[0].t and filled[1].t and not filled[1].f
    assert set(filled[0].f) == {r[0] for r in ops.polyfill(spark.table("shapes").limit(1), "h3", 8).select("h3_08").collect()}


def test_sql_functions_keep_rows_of_several_grids_and_nulls_apart(spark):
    register(spark)
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(b), r) for g, r in (("h3", 5), ("geohash", 4), ("s2", 9), ("rhp", 3), ("h3", 6)) for a, b in zip(rng.uniform(-180, 180, 40), rng.uniform(-90, 90, 40), strict=True)]
    rows += [("h3", None, 1.0, 5), (None, 1.0, 1.0, 5), ("s2", 1.0, float("nan"), 5), ("s2", 1.0, 1.0, None)]
    rng.shuffle(rows)
    spark.createDataFrame([tuple(r) for r in rows], "g string, x double, y double, r int").repartition(3).createOrReplaceTempView("many")
    for r in spark.sql("select *, dggs_resolution(g, c) q, dggs_parent(g, c, r - 1) p, dggs_center(g, c) m from (select *, dggs_point_to_cell(g, x, y, r) c from many)").collect():
        if None in (r.g, r.x, r.y, r.r) or r.y != r.y:
            assert (r.c, r.q, r.p, r.m) == (None,) * 4
            continue
        assert r.c == ops.grid(r.g).encode([r.x], [r.y], r.r)[0] and r.q == r.r and r.p == ops.ancestor(r.g, r.c, r.r, r.r - 1)
        assert np.allclose(geo.decode(r.m)[1][0], np.array(ops.grid(r.g).centers([r.c])).T)


def test_children_in_sql(spark):
    register(spark)
    cells = [("geohash", "u4", 4), ("s2", "6d3a4841c", 17), ("rhp", "N012", 5), ("h3", "85283473fffffff", 7), ("h3", "8009fffffffffff", 2), ("geohash", "u4p", 3)]
    for g, cell, res in cells:
        (got,) = spark.sql(f"select dggs_children('{g}', '{cell}', {res})").first()
        module = ops.hierarchy(g)
        low = spark.createDataFrame([(cell,)], "c string").select(module.resolution(F.col("c"))).first()[0]
        want = spark.createDataFrame([(cell,)], "c string").select(module.children(F.col("c"), low, res)).first()[0] if low < res else [cell]
        assert got == sorted(want)
    with pytest.raises(Exception, match="no descendants"):
        spark.sql("select dggs_children('geohash', 'u4pru', 3)").collect()


def test_cells_as_a_table_function(spark):
    register(spark)
    shapes = [box(174.7, -41.3, 174.9, -41.2), ("line", [np.array([(174.7, -41.3), (174.9, -41.2)])]), ("multipolygon", [box(1, 1, 1.2, 1.2), box(1.1, 1.1, 1.3, 1.3)]), ("point", [np.array([(5.0, 5.0)])])]
    table = features(spark, *shapes)
    table.unionByName(table.limit(1).withColumn("id", F.lit("none")).withColumn("geometry", F.lit(None).cast("binary"))).createOrReplaceTempView("sites2")
    for g, res in (("h3", 7), ("s2", 11), ("geohash", 5), ("rhp", 6)):
        got = sorted((r.id, r.cell) for r in spark.sql(f"select id, cell from sites2, lateral dggs_cells('{g}', geometry, {res})").collect())
        want = sorted((r.id, r[0]) for r in ops.polyfill(prepare.cleaned(table, ops.grid(g).GEODESIC), g, res).select(ops.column_name(g, res), "id").collect())
        assert got == want and want


def test_representatives_must_be_finer(spark):
    for dggs, cell, res in (("geohash", "u4pru", 5), ("s2", "6d3a4841c", 15), ("rhp", "N012", 2), ("h3", "85283473fffffff", 5)):
        with pytest.raises(Exception, match="not finer"):
            spark.createDataFrame([(cell,)], "c string").select(ops.grid(dggs).representative(F.col("c"), res)).collect()


def test_zip_and_dispatch(spark, tmp_path):
    import zipfile

    write_geojson(tmp_path / "a.geojson", [("x", box(0, 0, 1, 1)), ("y", None)])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.geojson", "a.geojson")
    rows = src.read(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.member, r.properties["name"], r.geometry is None) for r in rows] == [("a.geojson", "x", False), ("a.geojson", "y", True)]
    assert src.is_database("postgresql://u@h/db") and not src.is_database(str(tmp_path / "a.zip")) and not src.is_database("s3a://bucket/x.parquet")
    with pytest.raises(ImportError, match="JDBC"):
        src.read(spark, "postgresql://u@h/db", layer="s.t")
    with pytest.raises(ValueError, match="layer"):
        src.read(spark, "postgresql://u@h/db")
    assert src.table_query("s.t", "geometry", "id", False) == 'select t."id", ST_AsBinary(t."geometry") as gridloom_wkb, ST_SRID(t."geometry") as gridloom_srid from s.t t'
    assert src.table_query("s.t", "g", None, True).startswith("select t.*, ")
    # The column of the partitions comes besides, under a name of its own, and attributes stay out.
    assert src.table_query("s.t", "g", "id", False, 'n"o').endswith(', t."n""o" as gridloom_part from s.t t') and "t.*" not in src.table_query("s.t", "g", "id", False, "no")
    assert src.bounds_query("s.t", "no") == 'select min(t."no") as gridloom_low, max(t."no") as gridloom_high from s.t t'
    with pytest.raises(Exception):
        src.read(spark, str(tmp_path / "absent.parquet")).collect()


def test_rings_in_text_are_areas():
    assert geo.from_wkt("LINEARRING(0 0,10 0,10 10,0 0)")[0] == "polygon"


def test_command_line():
    a = cli.parser().parse_args(["h3", "-r", "9", "-s", "hilbert", "-ch", "20", "-crs", "2193", "-c", "auto", "-t", "4", "--tempdir", "/x", "-v", "debug", "in", "out"])
    assert (a.resolution, a.spatial_sorting, a.chunksize, a.cut_crs, a.cut_threshold, a.threads, a.tempdir, a.verbosity) == (9, "hilbert", 20, "2193", "auto", 4, "/x", "DEBUG")
    for wrong in (["h3", "-r", "16"], ["h3", "-r", "9", "-ch", "0"], ["h3", "-r", "9", "-s", "peano"], ["a5", "-r", "3"], ["h3", "-r", "9", "-t", "0"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args([*wrong, "in", "out"])
    with pytest.raises(ImportError):
        ops.grid("a5")


def test_indexed_twice_is_the_same(spark):
    shapes = features(spark, box(0, 0, 10, 10), box(100, 50, 110, 60)).withColumn("id", F.lit("a"))
    whole = {r[0] for r in index(shapes, "geohash", 3, id_field="id").collect()}
    cut = {r[0] for r in index(shapes, "geohash", 3, id_field="id", cut_threshold=7.3).collect()}
    assert whole == cut and {c[:1] for c in whole} >= {"s"}


def test_partitions_of_a_database_from_the_command_line(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr("gridloom.index.index_to_parquet", lambda *a, **k: asked.append(k["partitions"]))
    cli.main(["geohash", "-r", "4", "-lyr", "s.t", "-pc", "no", "-np", "8", "postgresql://h/db", str(tmp_path / "o")])
    cli.main(["geohash", "-r", "4", "-lyr", "s.t", "postgresql://h/db", str(tmp_path / "o")])
    assert asked == [("no", 8), None]
    with pytest.raises(ValueError, match="only a database"):
        src.read(spark, str(tmp_path / "a.geojson"), partitions=("no", 8))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["geohash", "-r", "4", "-np", "0", "in", "out"])


def test_ranges_of_a_database_table(spark, monkeypatch):
    """Without a database: the options that a reader is given, and the columns that stay."""
    given: list[dict] = []

    class Reader(dict):
        def format(self, name):
            return self

        def option(self, name, value):
            self[name] = value
            return self

        def load(self):
            given.append(dict(self))
            if "gridloom_low" in self["dbtable"]:
                return spark.createDataFrame([(3, 90)], "gridloom_low long, gridloom_high long")
            return spark.createDataFrame([(1, "x", bytearray(b"a"), 2193, 5)], "id long, more string, gridloom_wkb binary, gridloom_srid int, gridloom_part long")

    class Session:
        def __init__(self):
            self.read = Reader()
            self.sparkContext = spark.sparkContext

    monkeypatch.setitem(src.DRIVERS, "postgresql", "java.lang.String")  # any class that can be loaded
    got = src.read_table(Session(), "postgresql://u:p@h:5/db", "s.t", "g", "id", False, ("no", 4))
    assert got.columns == ["id", "geometry"] and src.crs_of(got) == "EPSG:2193"
    assert "partitionColumn" not in given[0] and (given[1]["partitionColumn"], given[1]["lowerBound"], given[1]["upperBound"], given[1]["numPartitions"]) == ("gridloom_part", 3, 91, 4)
    assert given[1]["url"] == "jdbc:postgresql://h:5/db" and given[1]["user"] == "u"
    got = src.read_table(Session(), "postgresql://h/db", "s.t", "g", "id", True)
    assert got.columns == ["id", "more", "geometry"] and len(given) == 3 and "partitionColumn" not in given[2]
