"""Feature preparation: ids, projection, longitudes, antimeridian, parts, bisection and reports."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as geo
from gridloom.functions.crs import crs
from gridloom.types import GEOMETRY, cell_area

LOG = logging.getLogger("gridloom")


def with_id(df: DataFrame, id_field: str | None, keep_attributes: bool) -> DataFrame:
    """The id column, the geometry and, if asked, the attributes; without an id field, ``fid`` counts rows from 0 in input order.

    Rows count on inside their partition, after those of the partitions before it; the counts come from one pass over the
    same columns.  So the input must be cut into the same partitions each time it runs, as scans of files and tables are;
    after an exchange by ranges, whose borders are drawn anew, store it first.
    """
    if id_field is None:
        rest = [c for c in df.columns if c != "fid"]
        part = df.select(F.spark_partition_id().alias("p"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
        sizes = {r.p: r.n for r in part.groupBy("p").agg(F.count("h").alias("n")).collect()}
        starts, total = [], 0
        for k in range(max(sizes, default=-1) + 1):
            starts.append(total)
            total += sizes.get(k, 0)
        # A number for each partition: their count is bounded by the scan's splits.
        first = F.get(F.array(*[F.lit(v).cast("long") for v in starts or [0]]), F.spark_partition_id())
        df = df.select((first + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("fid"), *[F.col(f"`{c}`") for c in rest])
        id_field = "fid"
    elif id_field not in df.columns:
        raise KeyError(id_field)
    rest = [c for c in df.columns if c not in (id_field, GEOMETRY)] if keep_attributes else []
    return df.select(id_field, *rest, GEOMETRY)


def mapped(df: DataFrame, f, *, column: str = GEOMETRY) -> DataFrame:
    """A row for each WKB that ``f(geometry)`` gives for a row's geometry; other columns repeat."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, raw in enumerate(batch.column(at).to_pylist()):
                for g in f(geo.decode(raw)):
                    rows.append(k)
                    out.append(geo.encode(g))
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(out, pa.binary()) if k == at else taken.column(k) for k in range(batch.num_columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def cleaned(df: DataFrame, geodesic: bool = False, split: bool = False) -> DataFrame:
    """Points, lines and polygons in longitudes -180..180: multis and collections of any depth are taken apart, empty ones go.

    Shapes across the limit are cut there for grids that fill on the plane
    (``split`` cuts all shapes wider than 180 degrees, as after a reprojection).
    """

    def run(g):
        for part in geo.flat(g):
            moved, across = geo.wrap(part)
            yield from geo.split_antimeridian(moved) if (across or split) and not geodesic else [moved]

    return mapped(df, run)


def bisected(df: DataFrame, threshold: float, spacing: float | None = None) -> DataFrame:
    """Polygons in pieces whose bounding boxes are at most ``threshold`` in area; 0 or less cuts nothing.

    Lines and points stay whole: a cut would put vertices on a line and change its trace.
    """

    def run(g):
        for part in geo.flat(g):
            yield from geo.bisect(part, threshold, spacing=spacing) if part[0] == "polygon" else [part]

    return df if threshold <= 0 else mapped(df, run)


def repaired(df: DataFrame) -> DataFrame:
    """Invalid polygons as the valid ones that cover the same by the even-odd rule; a row for each."""

    def run(g):
        for part in geo.flat(g):
            yield from geo.make_valid(part)

    return mapped(df, run)


def reprojected(df: DataFrame, source: str | int, target: str | int) -> DataFrame:
    """Geometries of one coordinate reference system in another."""
    there, back = crs(target), crs(source)
    if there.name == back.name or there.geographic and back.geographic:
        return df.withMetadata(GEOMETRY, {"crs": there.name})

    def run(g):
        if g is not None:
            yield geo.transformed(g, lambda x, y: there.forward(*back.inverse(x, y)))

    return mapped(df, run).withMetadata(GEOMETRY, {"crs": there.name})


def longitude_class(df: DataFrame) -> DataFrame:
    """``df(minx, maxx)`` with ``crosses`` (wider than 180 degrees) and ``class``: east, west, straddle or inside."""
    where = F.when(F.col("minx") >= 180, "east").when(F.col("maxx") <= -180, "west").when((F.col("maxx") > 180) | (F.col("minx") < -180), "straddle").otherwise("inside")
    return df.withColumn("crosses", F.col("maxx") - F.col("minx") > 180).withColumn("class", where)


def oversize(threshold: float) -> Column:
    """Whether a row's bounding box (minx, miny, maxx, maxy) is larger than the threshold; no box is not."""
    return F.coalesce((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) > threshold, F.lit(False))


def emptied(df: DataFrame) -> DataFrame:
    """One row (n, n_empty): rows, and those whose geometry is null, empty or of no point, line or polygon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = gone = 0
        for batch in batches:
            n += batch.num_rows
            gone += sum(next(geo.flat(geo.decode(r)), None) is None for r in batch.column(0).to_pylist())
        yield pa.record_batch([pa.array([n]), pa.array([gone])], names=["n", "n_empty"])

    return df.select(GEOMETRY).mapInArrow(run, "n long, n_empty long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_empty"), F.lit(0)).alias("n_empty"))


def judged(df: DataFrame, threshold: float) -> DataFrame:
    """``df`` with ``_gone``, whether ``emptied`` counts a row, and ``_large``, whether its box is larger than ``threshold`` (0: never)."""
    at = df.columns.index(GEOMETRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [geo.decode(r) for r in batch.column(at).to_pylist()]
            gone = [next(geo.flat(g), None) is None for g in shapes]
            boxes = [geo.bounds(g) if threshold > 0 else None for g in shapes]
            large = [b is not None and (b[2] - b[0]) * (b[3] - b[1]) > threshold for b in boxes]
            yield pa.record_batch([*batch.columns, pa.array(gone, pa.bool_()), pa.array(large, pa.bool_())], names=[*batch.schema.names, "_gone", "_large"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_large", T.BooleanType())]))


def counts() -> list[Column]:
    """Of judged rows: all (n), the emptied (n_empty) and the large ones (n_large)."""
    return [F.count(F.lit(1)).alias("n"), F.count_if("_gone").alias("n_empty"), F.count_if("_large").alias("n_large")]


def watched(df: DataFrame, threshold: float, seen: Observation) -> DataFrame:
    """``df`` as it is; the job that reads it leaves the ``counts`` of its judged rows in ``seen``.

    A task that runs again after a loss of its executor may be counted again.  A job without any result may leave none, as
    its plan is cut down while it runs.
    """
    return judged(df, threshold).observe(seen, *counts()).drop("_gone", "_large").withMetadata(GEOMETRY, df.schema[GEOMETRY].metadata)


SORTS = ("none", "hilbert", "morton", "geohash")


def spatially_sorted(df: DataFrame, method: str, chunk: int | None = None, n: int | None = None) -> DataFrame:
    """Rows near to each other put together, in ``n / chunk`` partitions; the key is dropped again.

    The key is that of the bounding box's middle, on a grid of 2^16 by 2^16 over the sphere's degrees.
    """
    if method not in SORTS:
        raise ValueError(f"spatial sorting must be one of {', '.join(SORTS)}, not {method!r}")
    parts = [max(1, -(-n // chunk))] if chunk and n is not None else []
    if method == "none":
        return df.repartition(*parts) if parts else df
    at = df.columns.index(GEOMETRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [geo.bounds(geo.decode(r)) or (0.0,) * 4 for r in batch.column(at).to_pylist()]
            b = np.array(boxes).reshape(-1, 4)
            yield pa.record_batch([*batch.columns, pa.array(curve((b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, method))], names=[*batch.schema.names, "_key"])

    keyed = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_key", T.LongType())]))
    return keyed.repartitionByRange(*parts, "_key").sortWithinPartitions("_key").drop("_key")


def curve(lon: np.ndarray, lat: np.ndarray, method: str, bits: int = 16) -> np.ndarray:
    """Numbers along a curve through the plane: interleaved bits (longitude first), or Hilbert's."""
    x, y = (np.clip(np.floor((v + half) / (2 * half) * (1 << bits)), 0, (1 << bits) - 1).astype(np.int64) for v, half in ((lon, 180.0), (lat, 90.0)))
    out = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        a, b = x >> k & 1, y >> k & 1
        if method == "hilbert":
            out = out << 2 | (3 * a) ^ b
            flip, turn = (b == 0) & (a == 1), b == 0
            x, y = np.where(flip, (1 << bits) - 1 - x, x), np.where(flip, (1 << bits) - 1 - y, y)
            x, y = np.where(turn, y, x), np.where(turn, x, y)
        else:  # a geohash has the same order of bits
            out = out << 2 | a << 1 | b
    return out




def bounds(df: DataFrame, column: str = GEOMETRY) -> DataFrame:
    """``df`` with minx, miny, maxx, maxy (null for an empty geometry)."""
    names = ["minx", "miny", "maxx", "maxy"]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [geo.bounds(geo.decode(r)) or (None,) * 4 for r in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, *[pa.array([b[k] for b in boxes], pa.float64()) for k in range(4)]], names=[*batch.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return df.mapInArrow(run, schema)


def longitude(lon: Column) -> Column:
    """A longitude brought into -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def default_threshold(cell_area_m2: float, metres_per_unit: float, cells: int = 5000) -> float:
    """The bounding box area, in map units, of about so many cells."""
    return cells * cell_area_m2 / metres_per_unit**2


def blade_spacing(dggs: str, res: int, geodesic: bool, cut_crs: str | int) -> float | None:
    """The distance between vertices along a cut, in map units: a tenth of a cell, 10 m at least; none on the plane of degrees, where a cut stays straight."""
    own = crs(cut_crs)
    return None if own.geographic and not geodesic else max(cell_area(dggs, res) ** 0.5 / 10, 10.0) / own.metres


def dropped(features: DataFrame, cells: DataFrame, id_field: str) -> DataFrame:
    """Ids of features that gave no cell."""
    return features.select(id_field).distinct().join(cells.select(id_field).distinct(), id_field, "left_anti")


def report(what: str, n_dropped: int, n: int) -> None:
    """Log dropped rows: INFO below 1%, else WARNING."""
    if n and n_dropped:
        share = n_dropped / n
        LOG.log(logging.INFO if share < 0.01 else logging.WARNING, "%s: %d of %d rows dropped (%.2f%%)", what, n_dropped, n, 100 * share)
