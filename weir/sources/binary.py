"""Headerless fixed-width binary records.

Spark's ``binaryFile`` source lists the files, in batch or as a stream (its log
of seen files is the stream's progress); their bytes are not read there.  Each
file is cut into ranges on record borders, the ranges are dealt out, and a task
reads one range a chunk at a time and decodes the fields that are wanted.  So
one large file is read by many tasks, in bounded memory.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from weir.plans.schema import Schema

ROWS_PER_BATCH = 65_536
#: Tasks of a batch's scan at most; beyond that, tasks read several ranges one after another.
MOST_TASKS = 100_000


def _text(column: np.ndarray) -> list[str]:
    """Bytes up to the first NUL, as text."""
    return [v.split(b"\0", 1)[0].decode("utf-8", "replace") for v in column.tolist()]


def batches(content: bytes, schema: Schema, strict: bool, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    kind = schema.dtype()
    stray = len(content) % kind.itemsize
    if stray and strict:
        raise ValueError(f"{stray} bytes are left after the last record of {kind.itemsize} bytes")
    rows = np.frombuffer(content, kind, len(content) // kind.itemsize)
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    for at in range(0, len(rows), ROWS_PER_BATCH):
        part = rows[at : at + ROWS_PER_BATCH]
        decoded = [pa.array(_text(part[f.name]), pa.string()) if f.data_type.is_text else pa.array(np.ascontiguousarray(part[f.name])) for f in fields]
        yield pa.RecordBatch.from_arrays(decoded, names=[f.name for f in fields])


def _store(path: str):
    """The pyarrow file system of a file that Spark has listed, and the path in it."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else path).lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@?&=%"))


def _splittable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the store of ``path`` by themselves; else Spark reads whole files for them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    try:
        _store(full)
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


def read(spark: SparkSession, path: str, schema: Schema, streaming: bool, files_per_trigger: int, options: dict, columns: list[str] | None = None) -> DataFrame:
    """The records of all files under ``path``; only the fields ``columns`` of them, if given.

    Of a stream, the files of a micro-batch arrive in the order of their names.

    Options: ``strict`` (default true): fail on bytes after the last record of
    a file.  ``range_bytes``: of a file for one task, by default
    ``spark.sql.files.maxPartitionBytes``.
    """
    strict = str(options.get("strict", True)).lower() == "true"
    wanted = None if columns is None else [f.name for f in schema.fields if f.name in columns] or [min(schema.fields, key=lambda f: np.dtype(f.packed()).itemsize).name]
    result = T.StructType([f for f in schema.struct().fields if wanted is None or f.name in wanted])
    if streaming:
        files = (
            spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max(1, files_per_trigger))
            .schema("path string, modificationTime timestamp, length long, content binary").load(path)
        )
    else:
        files = spark.read.format("binaryFile").load(path)
    if not _splittable(spark, path):

        def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for content in frame.column(0):
                    yield from batches(content.as_py(), schema, strict, wanted)

        return files.select("content").mapInArrow(cut, result)

    record = schema.record_size()
    size = options.get("range_bytes") or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = max(1, int(size) // record) * record
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).filter("length > 0")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not streaming:
        tasks = min(MOST_TASKS, max(1, ranges.count()))  # from the listing, no file is opened

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [r for frame in frames for r in zip(*(frame.column(c).to_pylist() for c in range(3)), strict=True)]
        for name, length, start in sorted(listed, key=lambda r: (r[0], r[2])):
            store, at = _store(name)
            end = min(start + size, length)
            with store.open_input_file(at) as file:
                for here in range(start, end, record * ROWS_PER_BATCH):
                    yield from batches(file.read_at(min(record * ROWS_PER_BATCH, end - here), here), schema, strict, wanted)

    # a stream's windows count rows as they arrive: partitions, ranges in them and rows in these are in that order
    return (ranges.repartitionByRange(tasks, "path", "start") if streaming else ranges.repartition(tasks)).mapInArrow(decode, result)


def write(df: DataFrame, path: str, schema: Schema) -> None:
    """Pack rows into files under ``path``, one for each partition of ``df``.

    Executors write through pyarrow's file systems, so ``path`` must be a
    folder that they share; without a scheme it is in Spark's default store.  A partition always has the same file: a task that
    runs again replaces what the one before it left.  Names are in the order of the calls and of the partitions.
    """
    names, call = [f.name for f in schema.fields], f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(at)
        store.create_dir(folder, recursive=True)
        written, name, out = 0, f"{folder}/{call}-{TaskContext.get().partitionId():05d}.bin", None
        for frame in frames:
            rows = np.zeros(frame.num_rows, schema.dtype())
            for i, f in enumerate(schema.fields):
                values = frame.column(i)
                if f.data_type.is_text:
                    rows[f.name] = [v.encode() for v in values.to_pylist()]
                else:
                    rows[f.name] = values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False)
            out = out or store.open_output_stream(name)
            out.write(rows.tobytes())
            written += frame.num_rows
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"rows": pa.array([written], pa.int64())})

    df.select(*names).mapInArrow(pack, "rows long").agg(F.sum("rows")).first()
