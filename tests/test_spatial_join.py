"""The point-in-polygon join on crowded cells, against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.operators import cells as ops
from gridloom.types import GEOMETRY


def table(spark, x, y):
    rows = [(k, float(a), float(b), [f"n{k}"], None if k % 3 else "q") for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, lon double, lat double, tags array<string>, note string")


def rings(r, n, low, high, size):
    out = []
    for _ in range(n):
        cx, cy = r.uniform(low, high, 2)
        turn = np.sort(r.uniform(0, 2 * np.pi, 9))
        out.append(np.stack([cx + size * np.cos(turn), cy + size * np.sin(turn)], 1))
    return out


def brute(shapes, x, y):
    return Counter((int(k), n) for n, s in enumerate(shapes) for k in np.flatnonzero(geo.inside([s], x, y)))


def test_crowded_cells_and_equal_points(spark, monkeypatch):
    monkeypatch.setattr(ops, "CROWD", 300)
    r = np.random.default_rng(11)
    # A third of all points are equal, a third lie in one cell of level 4, one lies on a corner of cells, the rest anywhere.
    x = np.concatenate([np.full(2000, 3.3), r.uniform(3.2, 3.4, 2000), r.uniform(-20, 20, 1999), [0.0]])
    y = np.concatenate([np.full(2000, 3.35), r.uniform(3.3, 3.4, 2000), r.uniform(-20, 20, 1999), [0.0]])
    shapes = [*rings(r, 20, -20, 20, 4), *rings(r, 30, 3.25, 3.4, 0.05), *rings(r, 5, 3.3, 3.36, 1.5)]
    points = table(spark, x, y)
    polygons = spark.createDataFrame([(n, geo.encode(("polygon", [s])), "p") for n, s in enumerate(shapes)], f"id long, {GEOMETRY} binary, note string")
    out = ops.points_in_polygons(points, polygons, res=3)
    assert out.columns == ["id", "lon", "lat", "tags", "note", "id", "note"]
    rows = out.collect()
    want = brute(shapes, x, y)
    assert Counter((row[0], row[5]) for row in rows) == want and len(want) > 10_000
    assert all(row[3] == [f"n{row[0]}"] and row[4] == (None if row[0] % 3 else "q") and row[6] == "p" for row in rows)

    placed = points.select(ops.geohash.point(F.col("lon"), F.col("lat"), 7).alias("deep"))
    crowd = ops.crowds(placed, 6000, 3, 7)
    levels = Counter(len(c) for c in crowd)
    assert all(levels[k] for k in (3, 4, 5, 6)) and levels[7] == 1 and crowd[max(crowd, key=len)] == 7  # 2,000 equal points in shares of 300


def test_no_group_of_the_join_is_crowded(spark, monkeypatch):
    monkeypatch.setattr(ops, "CROWD", 300)
    r = np.random.default_rng(12)
    x, y = np.concatenate([r.uniform(5, 5.2, 6000), r.uniform(-20, 20, 1000)]), np.concatenate([r.uniform(5, 5.1, 6000), r.uniform(-20, 20, 1000)])
    crowd = ops.crowds(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double").select(ops.geohash.point(F.col("x"), F.col("y"), 8).alias("deep")), 7000, 4, 8)
    names = ops.geohash.encode(x, y, 8)
    cells = Counter(next(c[:k] for k in range(4, 9) if c[:k] not in crowd or k == 8) for c in names)
    assert max(cells.values()) <= 300 and any(len(c) > 4 for c in cells)


def test_repeated_rows_and_empty_sides(spark, monkeypatch):
    for crowd in (2, 100_000):
        monkeypatch.setattr(ops, "CROWD", crowd)
        square = geo.encode(("polygon", [np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], float)]))
        points = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (None, 1.0)], "lon double, lat double")
        polygons = spark.createDataFrame([(square,), (square,), (None,), (geo.encode(("point", [np.array([[1.0, 1.0]])])),)], f"{GEOMETRY} binary").withColumn("k", F.lit(1))
        assert [tuple(r) for r in ops.points_in_polygons(points, polygons).collect()] == [(1.0, 1.0, 1)] * 6
        assert ops.points_in_polygons(points.limit(0), polygons).count() == 0
        assert ops.points_in_polygons(points, polygons.limit(0)).count() == 0
