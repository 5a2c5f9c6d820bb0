"""Cell tables with geometries: Parquet files whose footers carry GeoParquet metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridloom.functions import geometry as geo
from gridloom.types import GEOMETRY

_TYPES = {"point": "Point", "line": "LineString", "polygon": "Polygon"}


def geo_metadata(box: tuple | list | None, kinds: list[str]) -> str:
    """GeoParquet 1.1.0 file metadata of a WKB column; without a crs entry it is longitude and latitude on WGS 84."""
    column = {"encoding": "WKB", "geometry_types": sorted(kinds)}
    if box is not None:
        column["bbox"] = [float(v) for v in box]
    return json.dumps({"version": "1.1.0", "primary_column": GEOMETRY, "columns": {GEOMETRY: column}})


def merged_metadata(values: list[str]) -> str:
    """The metadata of several files as that of one: the box around their boxes and all their geometry types."""
    columns = [json.loads(v)["columns"][GEOMETRY] for v in values]
    boxes = np.array([c["bbox"] for c in columns if "bbox" in c]).reshape(-1, 4)
    box = [*boxes[:, :2].min(0), *boxes[:, 2:].max(0)] if len(boxes) else None
    return geo_metadata(box, sorted({k for c in columns for k in c["geometry_types"]}))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


#: The file of a folder that holds the metadata of all its files; Spark takes it for no data.
SUMMARY = "_metadata"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    geo: str | None = None  # the task's files as one
    schema: bytes | None = None


class CellWriter(DataSourceArrowWriter):
    """One file for each parent of a task's sorted rows; a failed or repeated task's files go at the end."""

    def __init__(self, options: dict):
        self.path, self.parent, self.codec = options["path"], options["parent"], options.get("codec", "snappy")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        files, writer, now, box, kinds = [], None, None, None, set()
        task: str | None = None
        schema: pa.Schema | None = None

        def finish() -> None:
            nonlocal task
            if writer is not None:
                own = geo_metadata(box, sorted(kinds))
                task = own if task is None else merged_metadata([task, own])
                writer.add_key_value_metadata({"geo": own})
                writer.close()

        for batch in iterator:
            at = batch.schema.get_field_index(self.parent)
            rest = batch.select([n for n in batch.schema.names if n != self.parent])
            schema = rest.schema
            keys = batch.column(at).to_pylist()
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != now:
                    finish()
                    now, box, kinds = keys[a], None, set()
                    folder = f"{root}/{self.parent}={now if now is not None else '__HIVE_DEFAULT_PARTITION__'}"
                    fs.create_dir(folder, recursive=True)
                    files.append(f"{folder}/part-{uuid.uuid4().hex}.parquet")
                    writer = pq.ParquetWriter(files[-1], rest.schema, filesystem=fs, compression=self.codec)
                part = rest.slice(a, b - a)
                for raw in part.column(part.schema.get_field_index(GEOMETRY)).to_pylist():
                    shape = geo.decode(raw)
                    if (own := geo.bounds(shape)) is not None:
                        kinds.add(_TYPES.get(shape[0], "GeometryCollection"))
                        box = own if box is None else (*np.minimum(box[:2], own[:2]), *np.maximum(box[2:], own[2:]))
                writer.write_batch(part)
        finish()
        return Written(files, task, schema.serialize().to_pybytes() if files else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        keep = {f for m in messages if m for f in m.files}
        fs.create_dir(root, recursive=True)
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.is_file and info.path.endswith(".parquet") and info.path.lstrip("/") not in {f.lstrip("/") for f in keep}:
                fs.delete_file(info.path)
        done = [m for m in messages if m and m.geo]
        if done:  # one message for each task, so the driver merges as many boxes as there are tasks
            schema = pa.ipc.read_schema(pa.py_buffer(done[0].schema))
            pq.write_metadata(schema.with_metadata({**(schema.metadata or {}), "geo": merged_metadata([m.geo for m in done])}), f"{root}/{SUMMARY}", filesystem=fs)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f)


class CellSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_cells"

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(self.options)


def footer(path: str) -> dict | None:
    """The GeoParquet metadata of a Parquet file, or of a folder: its summary's, else its first file's; None without any."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    summary = f"{root.rstrip('/')}/{SUMMARY}"
    files = [root] if info.is_file else [summary] if fs.get_file_info(summary).is_file else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".parquet"))
    raw = (pq.read_metadata(files[0], filesystem=fs).metadata or {}).get(b"geo") if files else None
    return json.loads(raw) if raw else None


def crs_of_footer(path: str) -> str | None:
    """EPSG code of a GeoParquet source's geometry; without an entry it is longitude and latitude."""
    try:
        found = footer(path)
    except (OSError, ValueError, pa.ArrowException):
        return None
    if not found:
        return None
    column = found["columns"][found["primary_column"]]
    if "crs" not in column:
        return "EPSG:4326"
    own = (column["crs"] or {}).get("id") or {}
    return f"{own['authority']}:{own['code']}" if own else None
