"""A log that is only appended to, as a Spark data source: ground truth and the history of runs.

    register(spark)
    df.write.format("append_log").mode("append").option("path", at).option("batch", "2024-05-01").save()
    spark.read.format("append_log").option("path", at).load()

Tasks write files of their own; nothing counts until the job's commit, which adds one manifest with
the batch's files and the number at which each file's ids start. So rows of a failed attempt are never read, a batch
that is appended again is left out, and ids run on without gaps: in a batch by partition and row, over batches in their order.
One job at a time may append to a log; a second one that finishes meanwhile finds the manifest taken and fails.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri))


def manifests(uri: str) -> list[dict]:
    """All batches of a log, in order; none where there is no log."""
    files, path = opened(uri)
    held = sorted(f.path for f in files.get_file_info(pafs.FileSelector(f"{path}/commits", allow_not_found=True)) if f.path.endswith(".json"))
    out = []
    for f in held:
        with files.open_input_stream(f) as s:
            out.append(json.loads(s.read()))
    return out


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


@dataclass
class File(InputPartition):
    file: str
    first: int
    rows: int
    skip: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, id_col: str) -> None:
        self.path, self.batch, self.schema, self.id_col = options["path"], options.get("batch") or uuid.uuid4().hex, schema, id_col

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, path = opened(self.path)
        files.create_dir(f"{path}/data", recursive=True)
        part = TaskContext.get().partitionId()
        name, rows, out = f"{part:06d}-{uuid.uuid4().hex}.parquet", 0, None
        for b in iterator:
            if b.num_rows:
                out = out or pq.ParquetWriter(f"{path}/data/{name}", b.schema, filesystem=files, compression="zstd")
                out.write_batch(b)
                rows += b.num_rows
        if out:
            out.close()
        return Written(part, name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = opened(self.path)
        done = manifests(self.path)
        own = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        if any(m["batch"] == self.batch for m in done):
            self.abort(messages)  # appended before
            return
        first = sum(f["rows"] for m in done for f in m["files"])
        listed = []
        for m in own:
            listed.append({"file": m.file, "first": first, "rows": m.rows})
            first += m.rows
        body = json.dumps({"batch": self.batch, "files": listed, "id": self.id_col, "schema": self.schema.json()}).encode()
        files.create_dir(f"{path}/commits", recursive=True)
        at = f"{path}/commits/{len(done):08d}.json"
        if files.get_file_info(at).type != pafs.FileType.NotFound:
            raise RuntimeError(f"another job has appended to {self.path} meanwhile")
        new = f"{path}/commits/{uuid.uuid4().hex}.new"
        with files.open_output_stream(new) as s:
            s.write(body)
        files.move(new, at)  # a reader sees the whole manifest or none

    def abort(self, messages: list[Written | None]) -> None:
        files, path = opened(self.path)
        for m in messages:
            if m and m.file and files.get_file_info(f"{path}/data/{m.file}").type != pafs.FileType.NotFound:
                files.delete_file(f"{path}/data/{m.file}")


class Reader(DataSourceReader):
    """A partition for each file. last: only the last rows of the log, and only their files."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.last, self.schema = options["path"], int(options.get("last", 0)), schema

    def partitions(self) -> list[File]:
        held = [f for m in manifests(self.path) for f in m["files"]]
        least = max(0, sum(f["rows"] for f in held) - self.last) if self.last else 0
        return [File(f["file"], f["first"], f["rows"], max(0, least - f["first"])) for f in held if f["first"] + f["rows"] > least]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        files, path = opened(self.path)
        at = partition.first
        for b in pq.ParquetFile(f"{path}/data/{partition.file}", filesystem=files).iter_batches():
            ids = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            out = pa.RecordBatch.from_arrays([ids, *b.columns], names=[self.schema.fieldNames()[0], *b.schema.names])
            skip = min(b.num_rows, max(0, partition.first + partition.skip - (at - b.num_rows)))
            if skip < b.num_rows:
                yield out.slice(skip)


class AppendLog(DataSource):
    """Options: path; batch (write: the batch's name, by which a repeat is known; a new one without it); id (write: name of the number's column, `id`); last (read)."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> StructType:
        held = manifests(self.options["path"])
        if not held:
            raise ValueError(f"no log at {self.options['path']}")
        fields = [StructType.fromJson(json.loads(m["schema"])).fields for m in held]
        seen: dict[str, StructField] = {}
        for f in (f for fs in fields for f in fs):
            seen.setdefault(f.name, f)
        return StructType([StructField(held[0]["id"], LongType()), *seen.values()])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("an append_log is only appended to")
        held = manifests(self.options["path"])
        if held and (known := StructType.fromJson(json.loads(held[0]["schema"]))) != schema and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"the log has columns {known.simpleString()}, not {schema.simpleString()}")
        return Writer(self.options, schema, self.options.get("id", "id"))


def register(spark: SparkSession) -> None:
    """Makes the format known; its code goes to the workers by value, as they may not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(AppendLog)


def append(df: DataFrame, path: str, batch: str | None = None, id_col: str = "id", order: list[str] | None = None) -> None:
    """Appends rows, numbered on from the log's last. order: rows are numbered in this order, dealt by ranges of it; else as they are dealt."""
    register(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out = rows.write.format("append_log").mode("append").option("path", path).option("id", id_col)
    (out.option("batch", batch) if batch else out).save()


def read(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("append_log").option("path", path).option("last", str(last)).load()


def swept(path: str) -> int:
    """Deletes files of failed attempts, which no manifest names, while nothing appends. How many."""
    files, at = opened(path)
    named = {f["file"] for m in manifests(path) for f in m["files"]}
    gone = [f.path for f in files.get_file_info(pafs.FileSelector(f"{at}/data", allow_not_found=True)) if f.base_name not in named]
    for f in gone:
        files.delete_file(f)
    return len(gone)
