"""Shapefiles and FlatGeobuf files that are written here, byte by byte, and read back."""

import datetime
import struct

import numpy as np
import pytest

from gridloom.functions import geometry as geo
from gridloom.sources import read as src
from gridloom.sources import vector_files as vf


def squares(n, seed=5):
    rng = np.random.default_rng(seed)
    at = np.stack([rng.uniform(-170, 170, n), rng.uniform(-80, 80, n)], 1)
    at = at[np.lexsort((at[:, 1], np.floor(at[:, 0] / 10)))]
    return [np.array([[x, y], [x, y + 0.5], [x + 0.5, y + 0.5], [x + 0.5, y], [x, y]]) for x, y in at]


def write_shp(base, kind, shapes, rows=None, fields=(), prj=None):
    """``shapes`` are lists of parts (None: a null shape); ``rows`` are the text of each field, with the delete flag first."""
    body, index, at = b"", b"", 50
    for k, parts in enumerate(shapes):
        if parts is None:
            raw = struct.pack("<i", 0)
        else:
            p = np.concatenate(parts)
            if kind % 10 == 1:
                raw = struct.pack("<i2d", kind, *p[0]) + b"\0" * (16 if kind == 11 else 0)
            elif kind == 8:
                raw = struct.pack("<i4di", kind, *p.min(0), *p.max(0), len(p)) + p.astype("<f8").tobytes()
            else:
                starts = np.cumsum([0] + [len(q) for q in parts[:-1]]).astype("<i4")
                raw = struct.pack("<i4dii", kind, *p.min(0), *p.max(0), len(parts), len(p)) + starts.tobytes() + p.astype("<f8").tobytes()
                raw += b"\0" * (16 + 8 * len(p)) if kind in (13, 15) else b""
        index += struct.pack(">ii", at, len(raw) // 2)
        body += struct.pack(">ii", k + 1, len(raw) // 2) + raw
        at += 4 + len(raw) // 2
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    open(f"{base}.shp", "wb").write(head(100 + len(body)) + body)
    open(f"{base}.shx", "wb").write(head(100 + len(index)) + index)
    if rows is not None:
        width = 1 + sum(length for *_, length, _ in fields)
        described = b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), length, d) for n, t, length, d in fields) + b"\r"
        data = b"".join(flag.encode() + b"".join(v.encode().ljust(f[2])[: f[2]] for v, f in zip(values, fields, strict=True)) for flag, *values in rows)
        open(f"{base}.dbf", "wb").write(struct.pack("<B3xIHH20x", 3, len(rows), 32 + len(described), width) + described + data + b"\x1a")
    if prj:
        open(f"{base}.prj", "w").write(prj)


def boxes(shapes):
    return np.array([[*s.min(0), *s.max(0)] for s in shapes])


def meeting(shapes, box):
    return set(np.flatnonzero(vf._meets(boxes(shapes), box)).tolist())


def test_shapefile_in_many_tasks(spark, tmp_path, monkeypatch):
    shapes = squares(3000)
    fields = [("id", "N", 9, 0), ("area", "N", 12, 3), ("name", "C", 12, 0), ("day", "D", 8, 0), ("ok", "L", 1, 0), ("geometry", "C", 4, 0)]
    rows = [("*" if k == 7 else " ", str(k), f"{k / 8:.3f}" if k != 3 else "***", f"näme {k}", "20260203" if k != 4 else "", "TF?"[k % 3], "x") for k in range(3000)]
    write_shp(tmp_path / "a", 5, [None if k == 5 else [s] for k, s in enumerate(shapes)], rows, fields, 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    monkeypatch.setattr(vf, "TASK_BYTES", 20_000)
    df = src.read(spark, str(tmp_path / "a.shp"))
    assert src.crs_of(df) == "EPSG:4326"
    assert df.rdd.getNumPartitions() > 10
    got = {r.id: r for r in df.collect()}
    assert set(got) == set(range(3000)) - {7}
    assert got[5].geometry is None and got[3].area is None and got[4].day is None and got[8].area == 1.0
    assert got[9].name == "näme 9" and got[9].day == datetime.date(2026, 2, 3) and (got[9].ok, got[10].ok, got[11].ok) == (True, False, None)
    assert got[9].geometry_1 == "x"
    for k in (0, 1234, 2999):
        kind, parts = geo.decode(got[k].geometry)
        assert kind == "polygon" and np.array_equal(parts[0], shapes[k])
    box = (-20.0, -10.0, 15.0, 30.0)
    found = {r.id for r in vf.read_shapefile(spark, str(tmp_path / "a.shp"), box).collect()}
    assert found == meeting(shapes, box) - {5, 7} and found


@pytest.mark.parametrize("kind", [1, 11, 3, 13, 8, 15, 31])
def test_shapes_of_each_kind(spark, tmp_path, kind):
    outer, hole, other = (np.array([[x, y], [x, y + s], [x + s, y + s], [x + s, y], [x, y]], float) for x, y, s in ((0, 0, 9), (2, 2, 1), (20, 0, 3)))
    parts = {1: [outer[:1]], 11: [outer[:1]], 3: [outer, other], 13: [outer], 8: [outer[:4]], 15: [outer, hole[::-1], other], 31: [outer]}[kind]
    write_shp(tmp_path / "a", kind, [parts, None, parts])
    rows = src.read(spark, str(tmp_path / "a.shp")).collect()
    assert [r.geometry is None for r in rows] == [False, True, False]
    want = {1: ["point"], 11: ["point"], 3: ["line"] * 2, 13: ["line"], 8: ["point"] * 4, 15: ["polygon"] * 2, 31: []}[kind]
    found = list(geo.flat(geo.decode(rows[0].geometry)))
    assert [k for k, _ in found] == want
    if kind == 15:
        assert sorted(len(p) for _, p in found) == [1, 2]
        x, y = np.array([1.0, 2.5, 21.0, 15.0]), np.array([1.0, 2.5, 1.0, 1.0])
        assert (sum(geo.inside(p, x, y).astype(int) for _, p in found) > 0).tolist() == [True, False, True, False]


def test_shapefile_that_is_empty_or_incomplete(spark, tmp_path):
    write_shp(tmp_path / "a", 5, [], [], [("id", "N", 9, 0)])
    assert src.read(spark, str(tmp_path / "a.shp")).count() == 0
    (tmp_path / "b.shp").write_bytes((tmp_path / "a.shp").read_bytes())
    with pytest.raises(ValueError, match="shx"):
        src.read(spark, str(tmp_path / "b.shp"))


def test_prj_names():
    assert vf.crs_of_prj('PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]') == "EPSG:32633"
    assert vf.crs_of_prj('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","3035"]]') == "EPSG:3035"
    assert vf.crs_of_prj('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4258"]],UNIT["metre",1]]') is None


# A flat buffer's objects: (bytes, where in them the object begins).


def vector(kind, values):
    data = np.asarray(values, kind)
    return struct.pack("<I", len(data)) + data.tobytes(), 0


def string(text):
    return vector("u1", np.frombuffer(text.encode(), "u1"))


def table(fields):
    """``fields``: number to (letter, value) or to an object."""
    places, inline = [0] * (max(fields, default=-1) + 1), 4
    for k, f in fields.items():
        places[k] = inline
        inline += struct.calcsize(f"<{f[0]}") if isinstance(f[0], str) else 4
    head = struct.pack(f"<HH{len(places)}H", 4 + 2 * len(places), inline, *places)
    own, behind = bytearray(struct.pack("<i", len(head))), b""
    for k, f in fields.items():
        if isinstance(f[0], str):
            own += struct.pack(f"<{f[0]}", f[1])
        else:
            own += struct.pack("<I", inline + len(behind) + f[1] - places[k])
            behind += f[0]
    return head + bytes(own) + behind, len(head)


def tables(found):
    out, behind = struct.pack("<I", len(found)), b""
    for k, (raw, at) in enumerate(found):
        out += struct.pack("<I", 4 * (len(found) - k) + len(behind) + at)
        behind += raw
    return out + behind, 0


def sized(obj):
    raw, at = obj
    return struct.pack("<II", len(raw) + 4, at + 4) + raw


def write_fgb(path, kind, geometries, box, rows, columns, node=16):
    features, at = [], []
    for g, values in zip(geometries, rows, strict=True):
        at.append(sum(map(len, features[-1:])) + (at[-1] if at else 0))
        features.append(sized(table({**({0: g} if g else {}), 1: vector("u1", np.frombuffer(values, "u1"))})))
    head = table({2: ("B", kind), 7: tables([table({0: string(n), 1: ("B", t)}) for n, t in columns]), 8: ("Q", len(features)), 9: ("H", node), 10: table({0: string("EPSG"), 1: ("i", 4326)})})
    tree = b""
    if node:
        level = [(*b, a) for b, a in zip(box.tolist(), at, strict=True)]
        levels = [level]
        while len(levels) < 2 or len(level) > 1:
            groups = [level[k : k + node] for k in range(0, len(level), node)]
            level = [(*np.array(g)[:, :2].min(0), *np.array(g)[:, 2:4].max(0), 0) for g in groups]
            levels.append(level)
        tree = b"".join(struct.pack("<4dQ", *n[:4], int(n[4])) for level in levels[::-1] for n in level)
    path.write_bytes(b"fgb\x03fgb\x01" + sized(head) + tree + b"".join(features))


def polygon(ring):
    return table({1: vector("<f8", ring.ravel())})


@pytest.fixture(scope="module")
def grid_file(tmp_path_factory):
    shapes = squares(20_000, 8)
    path = tmp_path_factory.mktemp("fgb") / "a.fgb"
    rows = [struct.pack("<Hi", 0, k) + (struct.pack("<HI", 1, len(t := f"näme {k}".encode())) + t if k % 5 else b"") for k in range(len(shapes))]
    write_fgb(path, 3, [polygon(s) for s in shapes], boxes(shapes), rows, [("id", 5), ("name", 11)])
    return path, shapes


def test_flatgeobuf_in_many_tasks(spark, grid_file, monkeypatch):
    path, shapes = grid_file
    monkeypatch.setattr(vf, "TASK_BYTES", 200_000)
    df = src.read(spark, str(path))
    assert src.crs_of(df) == "EPSG:4326" and df.rdd.getNumPartitions() > 10
    got = {r.id: r for r in df.collect()}
    assert set(got) == set(range(len(shapes)))
    assert got[5].name is None and got[6].name == "näme 6"
    for k in (0, 777, 19_999):
        kind, parts = geo.decode(got[k].geometry)
        assert kind == "polygon" and np.array_equal(parts[0], shapes[k])


def test_flatgeobuf_box_reads_a_part_of_the_file(spark, grid_file):
    path, shapes = grid_file
    box = (-20.0, -10.0, -11.0, 5.0)
    want = meeting(shapes, box)
    assert {r.id for r in vf.read_flatgeobuf(spark, str(path), box).collect()} == want and want
    assert vf.read_flatgeobuf(spark, str(path), (175.0, 85.0, 176.0, 86.0)).count() == 0
    source, read = vf.opened(str(path)), []

    def fetch(offset, length):
        read.append(length)
        return source(offset, length)

    file = vf.FlatGeobuf(fetch)
    size = path.stat().st_size
    found = [f for low, high in file.ranges(fetch, box) for part in file.raw(fetch, low, high, box, size) for f in part]
    assert len(found) == len(want) and sum(read) < size / 8


@pytest.mark.parametrize("node", [0, 2, 16])
def test_flatgeobuf_kinds_and_trees(spark, tmp_path, node):
    outer, hole = (np.array([[x, x], [x, x + s], [x + s, x + s], [x + s, x], [x, x]], float) for x, s in ((0, 9), (2, 1)))
    both = table({0: vector("<u4", [5, 10]), 1: vector("<f8", np.concatenate([outer, hole]).ravel())})
    found = [
        table({1: vector("<f8", [3.0, 4.0]), 6: ("B", 1)}), table({1: vector("<f8", outer.ravel()), 6: ("B", 2)}), table({0: vector("<u4", [5, 10]), 1: vector("<f8", np.concatenate([outer, hole]).ravel()), 6: ("B", 3)}),
        table({1: vector("<f8", outer.ravel()), 6: ("B", 4)}), table({0: vector("<u4", [2, 5]), 1: vector("<f8", outer.ravel()), 6: ("B", 5)}), table({6: ("B", 6), 7: tables([both, polygon(outer + 30)])}),
        table({6: ("B", 7), 7: tables([table({1: vector("<f8", [1.0, 1.0]), 6: ("B", 1)}), table({1: vector("<f8", outer.ravel()), 6: ("B", 2)})])}), table({6: ("B", 10)}), None,
    ]
    values = struct.pack("<HQHdH?HI3sHI2s", 0, 2**63 + 1, 1, 0.25, 2, True, 3, 3, b"{1}", 4, 2, b"\x01\x02")
    write_fgb(tmp_path / "a.fgb", 0, found, np.tile([0.0, 0, 40, 40], (len(found), 1)), [values] * len(found), [("u", 8), ("d", 10), ("b", 2), ("j", 12), ("raw", 14)], node)
    rows = src.read(spark, str(tmp_path / "a.fgb")).collect()
    kinds = [None if r.geometry is None else [(k, len(p)) for k, p in geo.flat(geo.decode(r.geometry))] for r in rows]
    assert kinds == [[("point", 1)], [("line", 1)], [("polygon", 2)], [("point", 1)] * 5, [("line", 1)] * 2, [("polygon", 2), ("polygon", 1)], [("point", 1), ("line", 1)], [], None]
    assert (int(rows[0].u), rows[0].d, rows[0].b, rows[0].j, bytes(rows[0].raw)) == (2**63 + 1, 0.25, True, "{1}", b"\x01\x02")


def test_flatgeobuf_without_features_or_of_another_version(spark, tmp_path):
    write_fgb(tmp_path / "a.fgb", 3, [], np.zeros((0, 4)), [], [("id", 5)], 0)
    assert src.read(spark, str(tmp_path / "a.fgb")).columns == ["id", "geometry"]
    assert src.read(spark, str(tmp_path / "a.fgb")).count() == 0
    (tmp_path / "b.fgb").write_bytes(b"fgb\x02" + bytes(20))
    with pytest.raises(ValueError, match="version"):
        src.read(spark, str(tmp_path / "b.fgb"))
