"""Cell tables as Hive-partitioned Parquet, staged beside the target and committed by renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.geoparquet import CellSink
from gridloom.types import GEOMETRY

# Codecs that Spark's Parquet writer takes here; the writer of geometries takes brotli too.
CODECS = ("none", "uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "zstd", "brotli")


def check_codec(codec: str) -> str:
    if codec.lower() not in CODECS:
        raise ValueError(f"unknown compression {codec!r}; known: {', '.join(CODECS)}")
    return codec.lower()


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a written table has any partition."""
    p, fs = _path(spark, path)
    return any("=" in f.getPath().getName() for f in fs.listStatus(p))


def beside(path: str, kind: str) -> str:
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/.{name}.{kind}" if head else f".{name}.{kind}"


def commit(spark: SparkSession, staged: str, target: str, overwrite: bool) -> None:
    """Put the staged folder in the target's place; the old one goes only after the new one is there."""
    (new, fs), (old, _), (aside, _) = (_path(spark, p) for p in (staged, target, beside(target, "replaced")))
    replaced = fs.exists(old)
    if replaced and not overwrite:
        raise FileExistsError(target)
    if replaced:
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"{target} cannot be moved aside")
    if not fs.rename(new, old):
        if replaced:
            fs.rename(aside, old)
        raise OSError(f"{staged} cannot be moved to {target}")
    fs.delete(aside, True)


def write_cells(cells: DataFrame, target: str, cell: str, parent: str, compression: str = "snappy", overwrite: bool = False) -> None:
    """One file for each parent cell, with GeoParquet metadata where there are geometries; rows without a cell go.  A failed run leaves an old target as it was."""
    spark = cells.sparkSession
    for name in (cell, parent):
        if name not in cells.columns:
            raise KeyError(name)
    codec = check_codec(compression)
    if exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    staged = beside(target, "staging")
    p, fs = _path(spark, staged)
    fs.delete(p, True)
    try:
        rows = cells.where(F.col(cell).isNotNull()).withColumn(parent, F.col(parent).cast("string"))
        if GEOMETRY in rows.columns or codec == "brotli":
            spark.dataSource.register(CellSink)
            plain = {"uncompressed": "none", "lz4_raw": "lz4"}.get(codec, codec)
            shaped = rows if GEOMETRY in rows.columns else rows.withColumn(GEOMETRY, F.lit(None).cast("binary"))
            shaped.repartition(parent).sortWithinPartitions(parent).write.format(CellSink.name()).option("path", staged).option("parent", parent).option("codec", plain).mode("append").save()
        else:
            rows.repartition(parent).write.partitionBy(parent).option("compression", codec).parquet(staged)
        commit(spark, staged, target, overwrite)
    finally:
        fs.delete(p, True)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A written cell table; parents such as 0204 stay text."""
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)
