"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs a re-read, never a recomputation of an iterative plan.

Hadoop's local file system starts a program for the mode of each file and folder
it makes, and until that program runs the child counts all of the JVM's memory a
second time.  A store made with ``by_python`` starts none: in a folder of the
``file`` scheme the Python workers write its tables, elsewhere Spark does.

An operator's lazy result reads its tables, so they stay until the caller is
done: code that has stored the result itself gives them back with ``released``
(the pipeline does after each stage), and all others go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local master, whose executors are the driver, may do without one; it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, if its scheme is ``file``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    return os.path.abspath(hadoop.toUri().getPath()) if scheme == "file" else None


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of a row group that a Python worker writes.
GROUP = 8 << 20


def _writes(folder: str, run: Run | None) -> Run:
    """Writes the rows (what ``run`` makes of them) of a task to a file of its attempt, which stays hidden until the driver has heard of the task's end."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        writer, held, size = None, [], 0
        for batch in run(batches) if run else batches:
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(f"{folder}/.{name}", batch.schema, write_page_checksum=True)
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP:
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if writer:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            yield pa.record_batch([pa.array([name])], names=["name"])

    return write


class Store:
    """A set of tables of one operator call; ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str, by_python: bool = False):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.folder = local_folder(spark, self.base) if by_python else None
        if not _OWN:
            atexit.register(_clear)
        _OWN.append((spark, self.base))

    def put(self, df: DataFrame, run: Run | None = None, schema: str | None = None) -> DataFrame:
        """``df``, or what ``run`` makes of its Arrow batches, with the columns of ``schema``."""
        self.made += 1
        path = f"{self.base}/t{self.made}"
        made = df.mapInArrow(run, schema) if run else df
        if self.folder:
            folder = f"{self.folder}/t{self.made}"
            os.makedirs(folder)
            for row in df.mapInArrow(_writes(folder, run), "name string").collect():
                os.rename(f"{folder}/.{row.name}", f"{folder}/{row.name}")
        else:
            made.write.parquet(path)
        # Hadoop keeps no checksums of files that Python wrote; Parquet has them by page.
        out = self.spark.read.option("parquet.page.verify-checksum.enabled", "true").schema(made.schema).parquet(path)
        out._gridloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._gridloom_path)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Frees at its end the tables of all stores made inside; what they gave must be stored or done with by then."""
    before = len(_OWN)
    yield
    for spark, base in _OWN[before:]:
        delete(spark, base)
    del _OWN[before:]


def _clear() -> None:
    for spark, base in _OWN:
        try:
            delete(spark, base)
        except Exception:  # the session may have ended before the interpreter does
            pass
