"""Grids, geometry, operators, sources and sinks."""

import json
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geohash, geometry as geo, h3, rhealpix, s2
from gridloom.index import index, index_to_parquet
from gridloom.operators import cells as ops
from gridloom.operators import prepare
from gridloom.sources import read as src
from gridloom.sources import write as out
from gridloom.types import IdFieldError, ParentResolutionException, column_name

RNG = np.random.default_rng(3)
LON, LAT = RNG.uniform(-180, 180, 500), np.degrees(np.arcsin(RNG.uniform(-1, 1, 500)))


def square(x0, y0, x1, y1):
    return "polygon", [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]


def features(spark, *shapes):
    return spark.createDataFrame([(f"f{k}", bytearray(geo.encode(g)) if g else None) for k, g in enumerate(shapes)], "id string, geometry binary")


def test_known_answers():
    assert geohash.encode([10.40744], [57.64911], 6).tolist() == ["u4pruy"]
    lon, lat = s2.centers(["6d3a4841c"])
    assert s2.split("6d3a4841c")[3] == 15 and abs(lat[0] + 41.8575453834871) < 1e-9 and abs(lon[0] - 173.225170164961) < 1e-9


@pytest.mark.parametrize("module,levels", [(geohash, (1, 5, 9)), (s2, (0, 4, 13, 28)), (rhealpix, (0, 3, 9)), (h3, (0, 1, 2, 9, 15))])
def test_centres_return_to_their_cells(module, levels):
    for res in levels:
        names = module.encode(LON, LAT, res)
        assert (module.encode(*module.centers(names.tolist()), res) == names).all()


@pytest.mark.parametrize("module,res", [(geohash, 8), (s2, 14), (rhealpix, 8), (h3, 9)])
def test_expressions_agree_with_kernels(spark, module, res):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(LON, LAT, strict=True)], "lon double, lat double")
    c = rows.select(module.point(F.col("lon"), F.col("lat"), res).alias("c")).withColumn("p", module.parent(F.col("c"), res - 2)).withColumn("r", module.resolution(F.col("c")))
    got = c.select("*", F.array_contains(module.children(F.col("p"), res - 2, res), F.col("c")).alias("child"), module.parent(module.representative(F.col("p"), res), res - 2).alias("back")).collect()
    assert [r.c for r in got] == module.encode(LON, LAT, res).tolist()
    if module is not h3:  # an H3 cell may reach a little beyond its parent
        assert [r.p for r in got] == module.encode(LON, LAT, res - 2).tolist()
    assert all(r.r == res and r.child and r.back == r.p for r in got)


def test_wkb_round_trip_and_flattening():
    shapes = [("point", [np.array([[1.0, 2.0]])]), ("line", [np.array([[0.0, 0], [1, 1]])]), square(0, 0, 2, 1), geo.from_wkt("GEOMETRYCOLLECTION(POINT(1 2),MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5))))")]
    for s in shapes:
        assert geo.encode(geo.decode(geo.encode(s))) == geo.encode(s)
    assert [k for k, _ in geo.flat(shapes[3])] == ["point", "polygon", "polygon"]
    z = struct.pack("<BIIddd", 1, 1002, 1, 3, 4, 5)
    assert geo.decode(z)[1][0].tolist() == [[3, 4]] and geo.decode(b"") is None


def test_bisection_keeps_area_and_threshold():
    pieces = geo.bisect(square(0, 0, 100, 100), 10)
    assert abs(sum(geo.area(p[1]) for p in pieces) - 10000) < 1e-6
    assert all((b[2] - b[0]) * (b[3] - b[1]) <= 10 for b in map(geo.bounds, pieces))
    dense = geo.bisect(square(0, 0, 1, 1), 0.05, spacing=0.01)
    assert max(len(p[1][0]) for p in dense) > 20 and abs(sum(geo.area(p[1]) for p in dense) - 1) < 1e-9


@pytest.mark.parametrize("dggs,res", [("geohash", 5), ("s2", 11), ("rhp", 7), ("h3", 7)])
def test_fill_is_centre_inside(spark, dggs, res):
    module = ops.grid(dggs)
    shape = ("polygon", [np.array([(174.0, -41.5), (175.0, -41.3), (174.7, -40.8), (174.0, -41.5)]), np.array([(174.5, -41.3), (174.6, -41.3), (174.6, -41.2), (174.5, -41.3)])])
    got = {r[0] for r in ops.polyfill(features(spark, shape), dggs, res).select(column_name(dggs, res)).collect()}
    x, y = np.meshgrid(np.linspace(173.9, 175.1, 500), np.linspace(-41.6, -40.7, 500))
    near = sorted(set(module.encode(x.ravel(), y.ravel(), res).tolist()))
    lon, lat = module.centers(near)
    rings = shape[1]
    if module is s2:  # edges of a great circle: dense vertices on the plane
        rings = [np.concatenate([np.stack(s2.lonlat((1 - t) * s2.xyz(*a) + t * s2.xyz(*b)), -1)[None] for a, b in zip(r[:-1], r[1:], strict=True) for t in np.linspace(0, 1, 200)[:-1]]) for r in rings]
    assert got == {c for c, k in zip(near, geo.inside(rings, lon, lat), strict=True) if k} and got


@pytest.mark.parametrize("dggs,res", [("geohash", 6), ("s2", 14), ("rhp", 8), ("h3", 9)])
def test_lines_hold_their_positions_and_do_not_repeat(spark, dggs, res):
    zigzag = np.array([(174.80, -41.30), (174.85, -41.31), (174.80, -41.32), (174.85, -41.33), (174.80, -41.30)])
    got = [r[0] for r in ops.polyfill(features(spark, ("line", [zigzag])), dggs, res).select(column_name(dggs, res)).collect()]
    module = ops.grid(dggs)
    assert len(got) == len(set(got)) and set(module.encode(*zigzag.T, res).tolist()) <= set(got)
    if dggs == "s2":
        p = s2.xyz(*zigzag.T)
        dense = np.concatenate([(1 - t) * a + t * b for a, b in zip(p[:-1], p[1:], strict=True) for t in [np.linspace(0, 1, 400)[:, None]]])
        assert set(s2.encode(*s2.lonlat(dense), res).tolist()) <= set(got)


@pytest.mark.parametrize("dggs,res,parent", [("geohash", 5, 3), ("s2", 9, 5), ("rhp", 6, 4), ("h3", 7, 4)])
def test_compaction_round_trip_and_floor(spark, dggs, res, parent):
    module, name = ops.grid(dggs), column_name(dggs, res)
    up = module.encode(np.array([174.0]), np.array([-41.0]), parent)[0]
    leaves = spark.createDataFrame([(1, up), (2, up), (None, up)], "id int, up string").select("id", F.posexplode(module.children(F.col("up"), parent, res)).alias("k", name)).where("id is null or id = 1 or k <> 5")
    packed = ops.compact(leaves, dggs, res, parent, "id")
    rows = packed.collect()
    assert [r[name] for r in rows if r.id == 1] == [up] and all(r.id is not None for r in rows)
    back = {(r.id, r[name]) for r in ops.expand(packed.select("id", name), dggs, res, name).collect()}
    assert back == {(r.id, r[name]) for r in leaves.where("id is not null").collect()}
    free = ops.compact_all(leaves.where("id = 2").select("id", F.col(name).alias("cell")), dggs, "id").select("cell").collect()
    assert sorted(r.cell for r in free) == sorted(r[name] for r in rows if r.id == 2)


def test_longitudes_and_antimeridian(spark):
    shapes = features(spark, square(183.1, -44.1, 183.8, -43.7), square(179.5, -44.0, 180.5, -43.5), None, ("polygon", []))
    clean = [geo.decode(r.geometry) for r in prepare.cleaned(shapes).collect()]
    assert len(clean) == 3 and all(-180 <= geo.bounds(g)[0] and geo.bounds(g)[2] <= 180 and geo.bounds(g)[2] - geo.bounds(g)[0] < 1 for g in clean)
    got = ops.polyfill(prepare.cleaned(shapes), "geohash", 5).where("id = 'f1'").collect()
    lon, _ = geohash.centers([r.geohash_05 for r in got])
    assert (lon > 179).any() and (lon < -179).any()


def test_index_writes_one_file_for_each_parent(spark, tmp_path):
    path = tmp_path / "in.geojson"
    shapes = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]}} for n, x in (("a", 10), ("b", 20))]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    target = str(tmp_path / "cells")
    index_to_parquet(spark, str(path), target, "geohash", 5, parent_res=2, id_field="name", geo="point")
    folders = [d for d in os.listdir(target) if d.startswith("geohash_02=")]
    assert folders and all(sum(f.endswith(".parquet") for f in os.listdir(f"{target}/{d}")) == 1 for d in folders)
    table = out.read_cells(spark, target)
    assert dict(table.dtypes)["geohash_02"] == "string" and table.where("substring(geohash_05, 1, 2) <> geohash_02").isEmpty()
    wanted = [r[0] for r in table.select("geohash_05").limit(3).collect()]
    assert ops.cells_in(table, "geohash", 5, 2, wanted).count() == 3
    with pytest.raises(FileExistsError):
        index_to_parquet(spark, str(path), target, "geohash", 5, id_field="name")
    before = sorted(os.listdir(target))
    with pytest.raises(KeyError):
        index_to_parquet(spark, str(path), target, "geohash", 5, id_field="absent", overwrite=True)
    assert sorted(os.listdir(target)) == before and not os.path.exists(tmp_path / ".cells.staging")


def test_errors(spark):
    f = features(spark, square(0, 0, 1, 1))
    with pytest.raises(ParentResolutionException):
        index(f, "geohash", 5, parent_res=5)
    with pytest.raises(IdFieldError):
        index(f, "geohash", 5, compact=True)
    with pytest.raises(ValueError):
        index(f, "nothing", 5)
    with pytest.raises(ValueError, match="CRS"):
        src.require_crs(f)
    with pytest.raises(ValueError):
        out.check_codec("zip9")


def test_geopackage_source(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
        db.execute("create table points (fid integer primary key, name text, geom blob)")
        db.execute("insert into gpkg_contents values ('points', 'features')")
        db.execute("insert into gpkg_geometry_columns values ('points', 'geom', 4326)")
        raw = b"GP\x00\x01" + struct.pack("<i", 4326) + geo.encode(("point", [np.array([[174.7, -41.3]])]))
        db.execute("insert into points values (1, 'x', ?), (2, 'y', null)", (raw,))
    df = src.read(spark, path)
    assert src.require_crs(df) == "EPSG:4326" and df.count() == 2
    assert [r.geohash_06 for r in index(df, "geohash", 6, id_field="fid").collect()] == geohash.encode([174.7], [-41.3], 6).tolist()
    remote = src.read(spark, f"file://{path}")
    assert src.require_crs(remote) == "EPSG:4326" and sorted(map(str, remote.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        src.read(spark, path, layer="absent")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["compact_geohash", "compact_floor", "expand_roundtrip"])
def test_sibling_sets_cover_all_suppliers(spark, tmp_path, name):
    import duckdb

    from gridloom.plans import queries as plans

    spark.range(1, 101).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).collect()}
    assert {r[0] for r in got} == set(range(1, 101))
    with duckdb.connect() as db:
        db.execute("create table supplier as select range as s_suppkey from range(1, 101)")
        # The rule of the SQL without its bound on the key.
        assert got == set(db.sql(plans.oracle_sql()[name].replace("WHERE s_suppkey <= 60", "")).fetchall())


@pytest.mark.parametrize("name", ["s2_compact", "rhp_compact"])
def test_compaction_covers_all_customers(spark, tmp_path, name):
    import duckdb

    from gridloom.plans import queries as plans

    spark.range(1, 301).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute("create table customer as select range as c_custkey from range(1, 301)")
        # The rule of the SQL without its bound on the key.
        assert got == set(db.sql(plans.oracle_sql()[name].replace("WHERE c_custkey <= 200", "")).fetchall()) and len(got) == 300


@pytest.mark.parametrize("dggs,res", [("geohash", 5), ("s2", 9), ("rhp", 5)])
def test_lines_of_all_events(spark, tmp_path, dggs, res):
    from gridloom.plans import queries as plans

    rows = spark.range(1, 41).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit(0).alias("ts"), F.lit(0.0).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got: dict[int, set] = {}
    for r in plans.queries()[f"line_trace_{dggs}"](spark, str(tmp_path)).collect():
        got.setdefault(r.line_id, set()).add(r.cell)
    assert set(got) == set(range(1, 41))
    for k, found in got.items():
        x, y = k * 7919 % 360000 / 1000 - 180, k * 104729 % 170000 / 1000 - 85
        line = np.array([(x, y), (x + 0.3, y + 0.2), (x + 0.1, y + 0.4)])
        assert set(ops.grid(dggs).encode(*line.T, res).tolist()) <= found == set(ops.trace(ops.grid(dggs), line, res))


def test_rhealpix_lines_hold_cells_of_clipped_corners():
    res, more = 5, 0
    r = np.random.default_rng(8)
    for _ in range(60):
        a = np.array([r.uniform(-170, 170), r.uniform(-35, 35)])
        line = np.stack([a, a + r.uniform(-1, 1, 2)])
        got = ops.trace(rhealpix, line, res)
        dense = lambda n: set(rhealpix.encode(*(line[0] + np.linspace(0, 1, n)[:, None] * (line[1] - line[0])).T, res).tolist())
        assert len(got) == len(set(got)) and dense(100_001) <= set(got)
        more += len(set(got) - dense(int(np.ceil(np.hypot(*(line[1] - line[0])) / (np.degrees(rhealpix.radius(res)) / 12))) + 2))
    assert more > 0


def _met(line: np.ndarray, res: int) -> tuple[set, set]:
    """Every cell of the level is tested: (those the segment enters by more than 1e-9 of a cell, those it comes so near to)."""
    size = 3**res
    place = lambda t: rhealpix.project(*(line[0] + t[:, None] * (line[1] - line[0])).T)
    t = np.unique(np.concatenate([np.linspace(0, 1, 20_001), np.linspace(0, 1, 4_001) ** 3, 1 - np.linspace(0, 1, 4_001) ** 3]))
    face, x, y = place(t)
    sure, near = set(), set()
    for f, i, j in ((f, i, j) for f in range(6) for i in range(size) for j in range(size)):
        deep = lambda g, x, y, f=f, i=i, j=j: np.where(g == f, 0.5 - np.maximum(np.abs(x * size - i - 0.5), np.abs(y * size - j - 0.5)), -9.0)
        d = deep(face, x, y)
        best = float(d.max())
        if -0.02 < best < 1e-3:  # look again round the deepest places
            for k in np.argsort(d)[-3:]:
                low, high = t[max(0, k - 1)], t[min(len(t) - 1, k + 1)]
                for _ in range(4):
                    fine = np.linspace(low, high, 401)
                    e = deep(*place(fine))
                    at = int(e.argmax())
                    best, low, high = max(best, float(e.max())), fine[max(0, at - 1)], fine[min(400, at + 1)]
        name = rhealpix.named(np.array([(f, i, j)]), res)[0]
        if best > -1e-7:
            near.add(name)
        if best > 1e-9:
            sure.add(name)
    return sure, near


@pytest.mark.parametrize("res", [0, 1, 2])
def test_rhealpix_lines_against_every_cell(res):
    r = np.random.default_rng(17 + res)
    lines = [r.uniform((-180, -90), (180, 90), (2, 2)) for _ in range(25)]
    lines += [np.stack([a := np.array([r.uniform(-180, 180), s * r.uniform(42, 89)]), np.clip(a + r.uniform(-40, 40, 2), (-180, -90), (180, 90))]) for s in (-1, 1) for _ in range(12)]
    # Along parallels and meridians, through a pole's point, round the pole, and a point.
    lines += [np.array(x, float) for x in ([(-170, 80), (170, 80)], [(-170, -60), (170, -85)], [(12, -90), (12, 90)], [(30, 50), (30, 90)], [(-180, 70), (180, 89.9)], [(-100, 10), (100, 10)], [(5, 66), (5, 66)])]
    for line in lines:
        got = ops.trace(rhealpix, line, res)
        sure, near = _met(line, res)
        assert len(got) == len(set(got)) and sure <= set(got) <= near, line


def test_rhealpix_segments_are_cut_at_each_border_once():
    a, b = np.array([-179.0, 44.0]), np.array([175.0, 88.0])
    t = rhealpix.crossings(a, b, 7)
    assert t[0] == 0 and t[-1] == 1 and (np.diff(t) > 0).all()
    cells = rhealpix.path(a, b, 7)
    # Between two crossings a segment keeps its cell: a second look finds no other.
    more = np.unique(np.concatenate([t[:-1] + (t[1:] - t[:-1]) * w for w in (0.1, 0.35, 0.8)]))
    names = set(rhealpix.encode(*(a + more[:, None] * (b - a)).T, 7).tolist())
    assert names <= set(rhealpix.named(cells, 7).tolist())
    # Whatever the direction, the cells are the same.
    assert set(rhealpix.named(rhealpix.path(b, a, 7), 7).tolist()) == set(rhealpix.named(cells, 7).tolist())


def _cheapest(a, b, res) -> dict:
    """By a search of the whole grid from one end: what the cheapest path to each cell costs, a step 1 and its centre's distance to the segment."""
    nx, ny = geohash._bits(res)
    w, h = 360 / (1 << nx), 180 / (1 << ny)
    a, b = np.array(a), np.array(b)

    def away(c):
        p = np.array([(c[0] + 0.5) * w - 180, (c[1] + 0.5) * h - 90])
        t = np.clip((p - a) @ (b - a) / max(1e-300, (b - a) @ (b - a)), 0, 1)
        return float(np.hypot(*(p - a - t * (b - a))))

    own = {(i, j): 1 + away((i, j)) for i in range(1 << nx) for j in range(1 << ny)}
    (x,), (y,) = geohash.locate(a[:1], a[1:], res)
    cost = {c: np.inf for c in own} | {(int(x), int(y)): 0.0}
    changed = True
    while changed:  # until no step makes anything cheaper
        changed = False
        for (i, j), g in own.items():
            low = min(cost[i + p, j + q] for p in (-1, 0, 1) for q in (-1, 0, 1) if (i + p, j + q) in own and (p or q)) + g
            if low < cost[i, j] - 1e-12:
                cost[i, j], changed = low, True
    return {"cost": cost, "own": own}


@pytest.mark.parametrize("res,n", [(1, 30), (2, 12)])
def test_geohash_segments_cost_no_more_than_a_full_search_finds(res, n):
    r = np.random.default_rng(res)
    ends = [r.uniform((-180, -90), (180, 90), (2, 2)) for _ in range(n)] + [np.array([(-170.0, 20.0), (170.0, 20.0)]), np.array([(3.0, 4.0), (3.0, 4.0)])]
    for a, b in ends:
        path = geohash.trace_segment(tuple(a), tuple(b), res)
        x, y = geohash.numbers(path)
        assert path[0] == geohash.encode(a[:1], a[1:], res)[0] and path[-1] == geohash.encode(b[:1], b[1:], res)[0]
        assert len(set(path)) == len(path) and (np.maximum(abs(np.diff(x)), abs(np.diff(y))) == 1).all()
        full = _cheapest(a, b, res)
        assert abs(sum(full["own"][c] for c in list(zip(x.tolist(), y.tolist(), strict=True))[1:]) - full["cost"][int(x[-1]), int(y[-1])]) < 1e-6
        # Ties go by cell numbers, so the other direction gives the same path.
        assert geohash.trace_segment(tuple(b), tuple(a), res) == path[::-1]


def test_geohash_ties_go_to_the_lower_cell_numbers():
    # Between opposite corners of two by one cells, along their common border's ends: both ways cost the same.
    (x, y), nx = (16, 16), geohash._bits(2)[0]
    at = lambda i, j: ((i + 0.5) * 360 / (1 << nx) - 180, (j + 0.5) * 180 / (1 << geohash._bits(2)[1]) - 90)
    a, b = at(x, y), at(x + 2, y + 1)
    low = geohash.trace_segment(a, b, 2)
    assert low[1] == str(geohash.names(np.array([x + 1]), np.array([y]), 2)[0]) and geohash.trace_segment(b, a, 2) == low[::-1]


def test_sql_of_fills_and_traces_on_made_tables(spark, tmp_path):
    """The SQL knows the grids by other formulas; the driver compares on its tables, this test on other rows."""
    import duckdb

    from gridloom.plans import queries as plans

    spark.range(20_000, 20_040).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(700_000, 700_150).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit(0).alias("ts"), F.lit(0.0).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    for name in ("supplier", "events"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("s2_polyfill", "s2_intersects", "line_trace_s2", "rhp_polyfill"):
        got = plans.queries()[name](spark, str(tmp_path))
        want = db.sql(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name
