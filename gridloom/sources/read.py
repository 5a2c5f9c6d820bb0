"""Feature tables from files and databases: WKB ``geometry`` plus attributes."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sqlite3
import tempfile
import zipfile
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as geo
from gridloom.sources.geoparquet import crs_of_footer
from gridloom.sources.vector_files import read_flatgeobuf, read_shapefile
from gridloom.types import GEOMETRY

# Database schemes and the JDBC driver class of each.
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}


def is_database(source: str) -> bool:
    return not os.path.exists(source) and urlsplit(source).scheme.split("+")[0] in DRIVERS


def read(
    spark: SparkSession, source: str, layer: str | None = None, geom_col: str = "geom", id_field: str | None = None, keep_attributes: bool = False, partitions: tuple[str, int] | None = None,
) -> DataFrame:
    """Dispatch by form: an existing path first, then a database URL, then any path that Spark can read.

    ``partitions`` (a number column, how many) reads a database in so many tasks; files are cut by their own means.
    """
    if is_database(source):
        if not layer:
            raise ValueError("a database source needs a layer (schema.table)")
        return read_table(spark, source, layer, geom_col, id_field, keep_attributes, partitions)
    if partitions is not None:
        raise ValueError("only a database is read by partitions of a column")
    kind = source.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("gpkg",):
        return read_gpkg(spark, source, layer)
    if kind == "shp":
        return read_shapefile(spark, source)
    if kind == "fgb":
        return read_flatgeobuf(spark, source)
    if kind in ("geojson", "json"):
        return read_geojson(spark, source)
    if kind in ("geojsonl", "ndjson", "geojsons"):
        return read_geojson(spark, source, lines=True)
    if kind in ("csv", "tsv"):
        return read_csv(spark, source)
    if kind == "zip":
        return read_zip(spark, source, layer)
    df = spark.read.parquet(source)
    for name in (GEOMETRY, geom_col):
        if name in df.columns:
            df = df.withColumnRenamed(name, GEOMETRY)
            known = crs_of(df) or crs_of_footer(source)
            return with_crs(df, known) if known else df
    raise ValueError(f"{source} has no geometry column")


def read_zip(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """GeoJSON members of a zip file (``layer`` names one); a feature's properties are one map column, as its columns are only known inside.

    A zip file is read by one task, member by member.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.lower().endswith((".geojson", ".json")) or layer not in (None, name, name.rsplit(".", 1)[0]):
                            continue
                        value = json.loads(archive.read(name))
                        found = value["features"] if value.get("type") == "FeatureCollection" else [value]
                        for k in range(0, len(found), 2000):
                            part = found[k : k + 2000]
                            raw = [geo.encode(g) if (g := geo.from_geojson(f.get("geometry"))) else None for f in part]
                            props = [[(n, None if v is None else v if isinstance(v, str) else json.dumps(v)) for n, v in (f.get("properties") or {}).items()] for f in part]
                            yield pa.record_batch([pa.array([name] * len(part)), pa.array(props, pa.map_(pa.string(), pa.string())), pa.array(raw, pa.binary())], names=["member", "properties", GEOMETRY])

    return with_crs(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"member string, properties map<string,string>, {GEOMETRY} binary"), "EPSG:4326")


def _converted(df: DataFrame, column: str, convert) -> DataFrame:
    """``df`` with a text column turned into the WKB geometry."""
    at = df.columns.index(column)
    schema = T.StructType([*[f for f in df.schema if f.name != column], T.StructField(GEOMETRY, T.BinaryType())])

    def run(batches):
        for batch in batches:
            raw = [None if (g := convert(v)) is None else geo.encode(g) for v in batch.column(at).to_pylist()]
            keep = [k for k in range(batch.num_columns) if k != at]
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(raw, pa.binary())], names=[*[batch.schema.names[k] for k in keep], GEOMETRY])

    return df.mapInArrow(run, schema)


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A feature collection, or a feature for each line; properties are columns."""
    raw = spark.read.option("multiLine", not lines).option("primitivesAsString", False).json(path)
    rows = raw if lines else raw.select(F.explode("features").alias("f")).select("f.*")
    shape = rows.withColumn("_geometry", F.to_json("geometry"))
    props = [F.col(f"properties.{f.name}") for f in rows.schema["properties"].dataType] if "properties" in rows.columns and isinstance(rows.schema["properties"].dataType, T.StructType) else []
    return with_crs(_converted(shape.select(*props, "_geometry"), "_geometry", geo.from_geojson), "EPSG:4326")


def read_csv(spark: SparkSession, path: str, column: str = "wkt") -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return _converted(df, column, geo.from_wkt)


def gpkg_wkb(raw: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage value."""
    if not raw or raw[:2] != b"GP":
        return raw
    envelope = (0, 32, 48, 48, 64)[(raw[3] >> 1) & 7]
    return None if raw[3] & 0x10 else raw[8 + envelope :]


def _layers(db: sqlite3.Connection) -> list[tuple[str, str, int, list[tuple[str, str]]]]:
    """(name, geometry column, SRS id, [(column, type)]) of the feature layers."""
    out = []
    for (name,) in db.execute("select table_name from gpkg_contents where data_type = 'features' order by table_name").fetchall():
        geom, srs = db.execute("select column_name, srs_id from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()
        out.append((name, geom, srs, [(r[1], (r[2] or "").upper()) for r in db.execute(f'pragma table_info("{name}")')]))
    return out


def _opened(source: str | bytes):
    """A GeoPackage by path, or from its bytes by way of a file of the task's own."""
    if isinstance(source, str):
        return contextlib.closing(sqlite3.connect(f"file:{source}?mode=ro", uri=True))

    @contextlib.contextmanager
    def copied():
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
            f.write(source)
            f.flush()
            with contextlib.closing(sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)) as db:
                yield db

    return copied()


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer of a GeoPackage file.  SQLite gives one cursor, so a file is read by one task, in bounded batches.

    On a local master the task opens the file itself; on a cluster, or by a URI, it gets the file's bytes from Spark.
    """
    direct = spark.sparkContext.master.startswith("local") and os.path.exists(path)
    content = spark.read.format("binaryFile").load(path).select("content")
    if direct:
        with _opened(path) as db:
            layers = _layers(db)
    else:

        def probe(batches):
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    with _opened(data) as db:
                        yield pa.record_batch([pa.array([json.dumps(_layers(db))])], names=["layers"])

        layers = json.loads(content.mapInArrow(probe, "layers string").first()[0])
    names = [name for name, *_ in layers]
    if layer is not None and layer not in names:
        raise ValueError(f"{path} has no layer {layer!r}; it has {names}")
    if not layers:
        raise ValueError(f"{path} has no feature layer")
    layer, geom, srs, info = next(own for own in layers if layer in (None, own[0]))
    kind = lambda t: T.LongType() if "INT" in t else T.DoubleType() if t in ("REAL", "DOUBLE", "FLOAT") else T.BinaryType() if t == "BLOB" else T.StringType()
    names = [n for n, _ in info if n != geom]
    schema = T.StructType([*[T.StructField(n, kind(t)) for n, t in info if n != geom], T.StructField(GEOMETRY, T.BinaryType(), True, {"crs": f"EPSG:{srs}"})])
    query = f"select {', '.join(f'"{n}"' for n in [*names, geom])} from \"{layer}\""
    kinds = [{T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}.get(type(schema[n].dataType), pa.string()) for n in names]

    def run(batches):
        for batch in batches:
            for data in [path] if direct else batch.column(0).to_pylist():
                with _opened(data) as db:
                    cursor = db.execute(query)
                    while rows := cursor.fetchmany(2000):
                        cols = list(zip(*rows, strict=True))
                        yield pa.record_batch([*[pa.array(c, k) for c, k in zip(cols[:-1], kinds, strict=True)], pa.array([gpkg_wkb(v) for v in cols[-1]], pa.binary())], names=[*names, GEOMETRY])

    return (spark.range(1, numPartitions=1) if direct else content).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name in a database's query."""
    return '"' + name.replace('"', '""') + '"'


def table_query(layer: str, geom_col: str, id_field: str | None, keep_attributes: bool, partition: str | None = None) -> str:
    """The columns that are wanted: all with attributes, else the id if there is one; the geometry as WKB and its SRID, and the column that partitions are cut by."""
    wanted = ["t.*"] if keep_attributes else [f"t.{quoted(id_field)}"] if id_field else []
    own = f"t.{quoted(geom_col)}"
    # Names of their own: the table may have a column ``geometry`` beside, or as, the geometry column.
    made = [f"ST_AsBinary({own}) as gridloom_wkb", f"ST_SRID({own}) as gridloom_srid", *([f"t.{quoted(partition)} as gridloom_part"] if partition else [])]
    return f"select {', '.join([*wanted, *made])} from {layer} t"


def bounds_query(layer: str, column: str) -> str:
    """The least and the greatest value of a column, by the database itself."""
    return f"select min(t.{quoted(column)}) as gridloom_low, max(t.{quoted(column)}) as gridloom_high from {layer} t"


def read_table(spark: SparkSession, url: str, layer: str, geom_col: str, id_field: str | None, keep_attributes: bool, partitions: tuple[str, int] | None = None) -> DataFrame:
    """A spatial table over JDBC; only the columns that are wanted are selected.

    ``partitions`` (a number column, how many) reads by ranges of that column in parallel, between the bounds that the
    database states; rows beyond them, as added meanwhile, are in the first and last range, and nulls in the first.
    The CRS is the SRID of the first geometry.
    """
    parts = urlsplit(url)
    scheme = parts.scheme.split("+")[0]
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVERS[scheme])
    except Exception as e:
        raise ImportError(f"no JDBC driver {DRIVERS[scheme]} on the class path; add its jar with spark.jars") from e
    reader = spark.read.format("jdbc").option("url", f"jdbc:{scheme}://{parts.hostname}{f':{parts.port}' if parts.port else ''}{parts.path}").option("driver", DRIVERS[scheme])
    for name, value in (("user", parts.username), ("password", parts.password)):
        reader = reader.option(name, value) if value else reader
    table = lambda query: reader.option("dbtable", f"({query}) q")
    column, n = partitions or (None, 1)
    low, high = table(bounds_query(layer, column)).load().first() if column and n > 1 else (None, None)
    # Options stay with a reader, so those of the ranges come last.
    ready = table(table_query(layer, geom_col, id_field, keep_attributes, column if low is not None else None))
    if low is not None:
        ready = ready.option("partitionColumn", "gridloom_part").option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", n)
    df = ready.load()
    first = df.select("gridloom_srid").where("gridloom_srid > 0").first()
    keep = [c for c in df.columns if c not in ("gridloom_wkb", "gridloom_srid", "gridloom_part", geom_col, GEOMETRY)] if keep_attributes else [id_field] if id_field else []
    df = df.select(*keep, F.col("gridloom_wkb").alias(GEOMETRY))
    return with_crs(df, f"EPSG:{first[0]}") if first else df


def crs_of(df: DataFrame) -> str | None:
    return (df.schema[GEOMETRY].metadata or {}).get("crs")


def with_crs(df: DataFrame, crs: str) -> DataFrame:
    return df.withMetadata(GEOMETRY, {"crs": crs})


def require_crs(df: DataFrame) -> str:
    crs = crs_of(df)
    if not crs:
        raise ValueError("the input has no CRS; name it with with_crs()")
    return crs
