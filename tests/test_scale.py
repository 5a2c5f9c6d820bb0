"""Steps whose cost is to grow no faster than their input: plans, and results against plain rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as ops
from gridloom.types import column_name


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def merged(cells: set[str], low: int, digits: str) -> set[str]:
    """Complete sets of children become their parent, from the finest level up to ``low`` letters."""
    out = set(cells)
    for n in range(max(map(len, out)), low, -1):
        for up in {c[:-1] for c in out if len(c) == n}:
            if all(up + d in out for d in digits):
                out = out - {up + d for d in digits} | {up}
    return out


@pytest.mark.parametrize("dggs,digits,root", [("geohash", "0123456789bcdefghjkmnpqrstuvwxyz", "u"), ("rhp", "012345678", "N")])
def test_unbounded_compaction_has_one_sort(spark, dggs, digits, root):
    pick, rows = random.Random(7), []
    for k in range(12):
        # Two levels below a cell, whole or with gaps; some with cells of coarser levels, present twice or there already.
        up = root + pick.choice(digits)
        own = [up + a + b for a in digits for b in digits if pick.random() < (1, 0.999, 0.97)[k % 3]]
        own += [up + pick.choice(digits) for _ in range(k % 4)] + own[:k] + ([up] if k % 5 == 0 else [])
        own += [root + d for d in digits if root + d != up] if k % 2 else []
        rows += [(k, c) for c in own]
    low = 1
    want = sorted((k, c) for k in range(12) for c in merged({c for i, c in rows if i == k}, low, digits))
    table = ops.dealt(spark.createDataFrame(rows, "id long, cell string"), "id", 1)
    packed = ops.compact_all(table, dggs, "id", 4 if dggs == "geohash" else 3, placed=True)
    assert plan(packed).count("Sort [") == 1 and plan(packed).count("Exchange ") == 1
    assert sorted(map(tuple, packed.collect())) == want
    assert sorted(map(tuple, ops.compact_all(table, dggs, "id").collect())) == want
    with pytest.raises(Exception, match="finer than level"):
        ops.compact_all(table, dggs, "id", 2, placed=True).collect()


@pytest.mark.parametrize("dggs,top,res,parent", [("geohash", "u4", 4, 2), ("s2", "1", 4, 2), ("rhp", "N4", 3, 1), ("h3", "8001fffffffffff", 2, 0)])
def test_compaction_of_placed_rows_has_one_sort_and_one_exchange(spark, dggs, top, res, parent):
    module, name = ops.hierarchy(dggs), column_name(dggs, res)
    up = spark.range(6).select("id", module.parent(F.lit(top), parent).alias("up") if dggs == "s2" else F.lit(top).alias("up"))
    leaves = ops.dealt(up, "id", 1).select("id", F.posexplode(module.children(F.col("up"), parent, res)).alias("k", name))
    # Whole, or without one leaf.
    cells = leaves.where("id % 3 <> 1 or k <> 5")
    packed = ops.compact(cells, dggs, res, parent, "id", placed=True)
    text = plan(packed)
    assert text.count("Sort [") == 1 and text.count("Exchange ") == 1
    got = {r.id: r.n for r in packed.groupBy("id").agg(F.count("*").alias("n")).collect()}
    leaf, n = [r[name] for r in leaves.where("id = 0").orderBy("k").collect()], {}
    up_of = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in leaf], "c string").select("c", module.parent(F.col("c"), res - 1)).collect()}
    siblings = sum(u == up_of[leaf[5]] for u in up_of.values())
    n[1] = len(set(up_of.values())) - 1 + siblings - 1
    assert got == {k: n[1] if k % 3 == 1 else 1 for k in range(6)}
    twice = ops.compact(cells.unionAll(cells), dggs, res, parent, "id").groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {r.id: r.n for r in twice} == {k: 2 * v for k, v in got.items()}


def test_positions_beyond_the_limits_meet_the_edges_there(spark):
    """A position past 180 degrees belongs to the outermost cell, which has no end on that side."""
    from gridloom.functions import geometry as geo
    from gridloom.plans.queries import box

    shapes = spark.createDataFrame([(1, geo.encode(box(179.95, 10.0, 180.02, 10.5))), (2, geo.encode(box(170.0, 89.9, 171.0, 90.2)))], "id int, geometry binary")
    points = spark.createDataFrame([(1, 180.01, 10.2), (2, 180.03, 10.2), (3, 180.5, 10.2), (4, 170.5, 90.1), (5, 170.5, 90.3)], "p int, lon double, lat double")
    assert sorted((r.p, r.id) for r in ops.points_in_polygons(points, shapes).select("p", "id").collect()) == [(1, 1), (4, 2)]


def test_triangle_with_centres_on_its_slanted_side():
    """Supplier 24100: 16 centres lie on the slanted side, so they are not inside."""
    from gridloom.functions import geohash
    from gridloom.plans.queries import triangle

    k = 24100
    x, y, w = k * 7919 % 360000 / 1000 - 180, k * 104729 % 170000 / 1000 - 85, (k % 7 + 1) / 10
    got = [c for b, need in ops.blocks(geohash, triangle(x, y, w)[1], 5) for c in ops.fill_block(geohash, b, need, 5).tolist()]
    assert got and "c56ku" not in got and "c56p5" not in got


def test_rhp_centres_on_the_cut_are_in_no_part():
    from gridloom.functions import geometry as geo, rhealpix
    from gridloom.plans.queries import box

    k = 7410
    x, y = k * 7919 % 360000 / 1000 - 180, k * 104729 % 170000 / 1000 - 85
    moved, across = geo.wrap(box(x, y, x + (k % 7 + 1) / 10, y + (k % 5 + 1) / 10))
    assert across
    got = [c for part in geo.split_antimeridian(moved) for b, need in ops.blocks(rhealpix, part[1], 7) for c in ops.fill_block(rhealpix, b, need, 7).tolist()]
    assert len(got) == 6


def test_h3_paths_together_are_those_of_each_alone():
    from gridloom.functions import h3

    r = np.random.default_rng(3)
    a = np.stack([r.uniform(-180, 180, 200), r.uniform(-85, 85, 200)], 1)
    b = a + r.normal(0, 1, a.shape)
    assert h3.paths(a, b, 5) == [h3.path(tuple(x), tuple(y), 5) for x, y in zip(a, b, strict=True)]


def test_s2_trace_has_no_cell_of_a_face_that_it_only_touches():
    """A line of event 297100 ends at 45 degrees west, where two faces meet."""
    from gridloom.functions import s2

    x, y = 297100 * 7919 % 360000 / 1000 - 180, 297100 * 104729 % 170000 / 1000 - 85
    (got,) = ops.traces(s2, [np.array([(x, y), (x + 0.3, y + 0.2), (x + 0.1, y + 0.4)])], 9)
    assert got and "9532cc" not in got


def event_lines(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of the lines of events."""
    start = np.stack([ids * 7919 % 360000 / 1000 - 180, ids * 104729 % 170000 / 1000 - 85], 1)
    knots = [start + by for by in ((0, 0), (0.3, 0.2), (0.1, 0.4))]
    return np.concatenate(knots[:2]), np.concatenate(knots[1:])


def test_geohash_paths_together_are_those_of_the_search(monkeypatch):
    from gridloom.functions import geohash

    search, asked = geohash.searched, []
    monkeypatch.setattr(geohash, "searched", lambda *x: asked.append(x) or search(*x))
    r = np.random.default_rng(4)
    # Lines of events at two levels, wide segments at a coarse one, ends on borders and corners of cells, beyond the limits.
    p = r.integers(0, (513, 257), (200, 2))
    corners = [v * np.array([180 / 256, 90 / 128]) - np.array([180, 90]) for v in (p, np.clip(p + r.integers(-9, 10, p.shape), 0, (512, 256)))]
    wide = [r.uniform((-200, -95), (200, 95), (60, 2)) for _ in range(2)]
    for a, b, res, most in ((*event_lines(r.integers(0, 36_000_000, 200)), 5, 0), (*event_lines(r.integers(0, 36_000_000, 10)), 6, 0), (*wide, 1, 60), (*wide, 3, 30), (*corners, 3, 50)):
        asked.clear()
        own, names = geohash.named_paths(a, b, res)
        assert len(asked) <= most
        for k, ends in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            want = search(*map(tuple, ends), res)
            assert names[own == k].tolist() == geohash.names(*np.array(want).T, res).tolist()
    assert [len(v) for v in geohash.named_paths(np.zeros((0, 2)), np.zeros((0, 2)), 5)] == [0, 0]


def test_rhealpix_lines_are_traced_together(monkeypatch):
    from gridloom.functions import rhealpix

    r = np.random.default_rng(6)
    a, b = event_lines(r.integers(0, 36_000_000, 150))
    some = [r.uniform((-180, -90), (180, 90), (n, 2)) for n in (1, 2, 3, 1, 5)]
    # Along parallels and meridians, to a pole, across 180 degrees, of no length.
    some += [np.array(x, float) for x in ([(-170, 80), (170, 80)], [(12, -90), (12, 90)], [(30, 50), (30, 90)], [(-180, 70), (180, 89.9)], [(5, 66), (5, 66)])]
    lines = [*np.stack([a, b], 1), *some]
    for res in (0, 3, 5):
        alone = [ops.trace(rhealpix, line, res) for line in lines]
        for line, cells in zip(lines, alone, strict=True):
            dense = np.concatenate([line[:1], *[p + np.linspace(0, 1, 2001)[:, None] * (q - p) for p, q in zip(line[:-1], line[1:], strict=True)]])
            assert len(cells) == len(set(cells)) and set(rhealpix.encode(*dense.T, res).tolist()) <= set(cells)
        project, asked = rhealpix.project, []
        with monkeypatch.context() as m:
            m.setattr(rhealpix, "project", lambda *x: asked.append(x) or project(*x))
            assert ops.traces(rhealpix, lines, res) == alone
        assert len(asked) <= 1 + sum(len(line) == 1 for line in lines)
    assert [len(v) for v in rhealpix.named_paths(np.zeros((0, 2)), np.zeros((0, 2)), 5)] == [0, 0]
