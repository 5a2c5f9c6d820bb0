"""From features to a cell table: ``index`` is lazy, ``index_to_parquet`` writes."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession

from gridloom.functions.crs import crs as system
from gridloom.operators import cells as ops
from gridloom.operators import prepare
from gridloom.sources import read as src
from gridloom.sources import write as out
from gridloom.types import IdFieldError, cell_area, column_name, parent_resolution

LOG = logging.getLogger("gridloom")
DEGREES = "EPSG:4326"


def threshold_of(cut_threshold: float | str, dggs: str, res: int, cut_crs: str | int) -> float:
    """A threshold in square map units; ``auto`` is the box of about 5,000 cells."""
    return prepare.default_threshold(cell_area(dggs, res), system(cut_crs).metres) if cut_threshold == "auto" else float(cut_threshold)


def features(
    df: DataFrame, dggs: str, res: int, id_field: str | None = None, keep_attributes: bool = False, cut_threshold: float | str = 0, cut_crs: str | int | None = None,
    crs: str | int | None = None, spatial_sorting: str = "none", chunksize: int | None = None, seen: Observation | None = None,
) -> DataFrame:
    """Parts of features in longitude and latitude, ready for cells; ``crs`` names the input's system if its metadata does not.

    ``seen`` takes the counts of ``prepare.watched``, after a sort, whose sampling would count rows once more.
    """
    source = crs or src.crs_of(df) or DEGREES
    module = ops.grid(dggs)
    rows = prepare.with_id(df, id_field, keep_attributes)
    if chunksize is not None and chunksize < 1:
        raise ValueError("a chunk has one row at least")
    if spatial_sorting != "none" or chunksize:
        rows = prepare.spatially_sorted(rows, spatial_sorting, chunksize, rows.count() if chunksize else None)
    threshold = threshold_of(cut_threshold, dggs, res, cut_crs or source)
    if threshold > 0:
        rows = prepare.reprojected(rows, source, cut_crs or source)
    if seen is not None:
        rows = prepare.watched(rows, threshold, seen)
    if threshold > 0:
        rows = prepare.bisected(rows, threshold, prepare.blade_spacing(dggs, res, module.GEODESIC, cut_crs or source))
        rows = prepare.reprojected(rows, cut_crs or source, DEGREES)
    else:
        rows = prepare.reprojected(rows, source, DEGREES)
    return prepare.cleaned(rows, module.GEODESIC, not system(source).geographic)


def index(
    df: DataFrame, dggs: str, res: int, parent_res: int | None = None, id_field: str | None = None, keep_attributes: bool = False, compact: bool = False, geo: str = "none",
    cut_threshold: float | str = 0, cut_crs: str | int | None = None, crs: str | int | None = None, spatial_sorting: str = "none", chunksize: int | None = None, threads: int | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """The cells of ``df`` (WKB ``geometry``) with their parents.

    Fills are dealt out by blocks of cells whatever a feature's size, so polygons are only cut where a threshold asks for
    it (a number of square map units of ``cut_crs``, or ``auto``).  ``threads`` is the number of partitions of the fill.
    """
    parent = parent_resolution(dggs, res, parent_res)
    if compact and id_field is None:
        raise IdFieldError("compaction needs an id field")
    name, parent_name = column_name(dggs, res), column_name(dggs, parent)
    rows = features(df, dggs, res, id_field, keep_attributes, cut_threshold, cut_crs, crs, spatial_sorting, chunksize, seen)
    table = ops.with_parent(ops.polyfill(rows, dggs, res, threads), dggs, res, parent)
    if compact:
        table = ops.compact(table, dggs, res, parent, id_field)
    if geo != "none":
        table = ops.cell_geometry(table, dggs, name, geo)
    first = [name, id_field or "fid", parent_name]
    return table.select(*first, *[c for c in table.columns if c not in first])


def index_to_parquet(
    spark: SparkSession, source: str, target: str, dggs: str, res: int, *, layer: str | None = None, geom_col: str = "geom", compression: str = "snappy", overwrite: bool = False,
    crs: str | int | None = None, partitions: tuple[str, int] | None = None, **options,
) -> None:
    """Index a source into a folder; dropped features and features without cells are logged.

    What the reports need is counted by the job that writes.  So the source is read once; once more if rows have to be
    numbered (no id field) or sorted, its ids alone if fewer ids have cells than there are rows, to see whether ids
    repeat or features are lost, and its geometries if there is no cell at all.
    """
    out.check_codec(compression)
    parent = parent_resolution(dggs, res, options.get("parent_res"))
    id_field = options.get("id_field")
    if options.get("compact") and id_field is None:
        raise IdFieldError("compaction needs an id field")
    if out.exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    df = src.read(spark, source, layer, geom_col, id_field, options.get("keep_attributes", False), partitions)
    df = src.with_crs(df, crs) if crs else df
    known = src.require_crs(df)
    system(known)
    cut = options.get("cut_crs") or known
    threshold = threshold_of(options.get("cut_threshold", 0), dggs, res, cut)
    name, parent_name = column_name(dggs, res), column_name(dggs, parent)
    seen = Observation()
    table = index(df, dggs, res, seen=seen, **options)
    out.write_cells(table, target, name, parent_name, compression, overwrite)
    done = out.read_cells(spark, target) if out.has_files(spark, target) else None
    found = seen.get if done is not None else prepare.judged(prepare.reprojected(df, known, cut), threshold).agg(*prepare.counts()).first().asDict()
    n, empty, large = found["n"], found["n_empty"], found["n_large"]
    if not n:
        LOG.warning("%s has no features; the output is empty", source)
    prepare.report("features without a geometry of points, lines or polygons", empty, n)
    if threshold > 0 and n:
        LOG.info("%d of %d features are larger than %g and are cut", large, n, threshold)
    if done is not None and compression.lower() == "brotli":
        done = index(df, dggs, res, **options)  # Spark itself cannot read that codec back
    if n and done is None:
        LOG.warning("no feature of %s gave a cell; the output is empty", source)
    key = id_field or "fid"
    ids = done.select(key).distinct().count() if done is not None else 0
    want = df.select(key).distinct().count() if id_field and ids < n else n
    prepare.report("features that gave no cell", want - ids, want)
