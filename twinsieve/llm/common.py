"""What the operators of this subpackage share: tables, the shared folder, files, Arrow."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets the Python workers import this package where it was put on the driver's path only, and keeps Arrow batches of long texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    known = os.pathsep.join([env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]).split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [env.get("PYTHONPATH", ""), ROOT] if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir or the one that setCheckpointDir named.

    Without one there is no folder of which that is known: an error says so. Only local masters, tests among them, may take "checkpoints" in the warehouse.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.startswith("local"):
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new place in the shared folder, deleted when the application ends, or by discard() before that, unless kept."""
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def written(df: DataFrame, label: str, compression: str = "zstd", rows_per_file: int = 0) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives a lost executor. rows_per_file: for large rows, so that few are read at once."""
    at = fresh_dir(df.sparkSession, label)
    df.write.option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written(); nothing may read them any more."""
    for df in tables:
        remove(df.sparkSession, df.written_at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(names: list[str], wanted: str) -> str:
    """wanted, or a name like it that is no column yet; Spark takes names that differ by case for the same."""
    taken, name = {n.lower() for n in names}, wanted
    while name.lower() in taken:
        name += "_"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, for file:, hdfs:, s3: and the like, or a plain local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    at, path = open_fs(uri)
    at.create_dir(path, recursive=True)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def trim() -> None:
    """Gives what a Python worker has freed back to the machine: it waits beside the JVM for its next task."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few bytes, so that what is made of a batch stays small. A single row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    trim()
