"""Rows of a stream on their way to its state: packed by buckets of keys, in the order of arrival.

A shuffle keeps no order, and a call of Python for each key costs more than its
rows.  So the task that reads rows packs them, some hundred thousand at a time,
into a compressed Arrow stream for each bucket of keys; what is shuffled and
sorted are these packs, each with its place.  The order of arrival is that of
the partitions that are read and of the rows in them: for binary files, by name
of file and place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of keys, each a key of the state; a stream goes on from its checkpoint with as many.
BUCKETS = 256
#: Rows that are packed, or unpacked, at a time.
ROWS = 1 << 18


def to_bytes(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed Arrow stream, a format that later versions read too."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stored(frame: pd.DataFrame) -> bytes:
    return to_bytes(pa.RecordBatch.from_pandas(frame, preserve_index=False))


def stored_by(frame: pd.DataFrame, by: np.ndarray) -> dict[int, bytes]:
    """The rows of ``frame`` of each value of ``by``, converted together: a conversion costs more than a few rows."""
    order = np.argsort(by, kind="stable")
    rows = pa.RecordBatch.from_pandas(frame.iloc[order], preserve_index=False)
    own, starts = np.unique(by[order], return_index=True)
    return {int(x): to_bytes(rows.slice(a, b - a)) for x, a, b in zip(own, starts, [*starts, len(by)][1:], strict=True)}  # there may be no rows


def opened(content: bytes) -> pa.Table:
    return pa.ipc.open_stream(content).read_all()


def loaded(content: bytes) -> pd.DataFrame:
    return opened(content).to_pandas()


def bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int") if keys else F.lit(0)


def _packs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, n = TaskContext.get().partitionId() << 32, [], 0

    def packs() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        own = table.column("b").to_numpy()
        order = np.argsort(own, kind="stable")
        buckets, starts = np.unique(own[order], return_index=True)
        rows = table.drop_columns(["b"]).take(pa.array(order)).combine_chunks()
        parts = [rows.slice(a, b - a).to_batches()[0] for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([at] * len(buckets), pa.int64()), pa.array([to_bytes(p) for p in parts], pa.binary())], names=["b", "at", "rows"])

    for frame in frames:
        held.append(frame)
        n += frame.num_rows
        if n >= ROWS:
            yield packs()
            at, held, n = at + 1, [], 0
    if n:
        yield packs()


def packed(df: DataFrame) -> DataFrame:
    """``b, at, rows``: the rows of ``df`` by its column ``b``, packed."""
    return df.mapInArrow(_packs, "b int, at long, rows binary")


def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the packs of one bucket, in the order of their arrival."""
    packs = sorted(((at, rows) for f in frames for at, rows in zip(f["at"], f["rows"], strict=True)), key=lambda p: p[0], reverse=True)
    held, n = [], 0
    while packs:
        held.append(pa.ipc.open_stream(packs.pop()[1]).read_all())
        n += held[-1].num_rows
        if n >= ROWS or not packs:
            yield pa.concat_tables(held).to_pandas()
            held, n = [], 0


def places(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``, a number that grows in the order of arrival."""

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for frame in frames:
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(np.arange(at, at + frame.num_rows))], names=[*frame.schema.names, name])
            at += frame.num_rows

    return df.mapInArrow(number, df.withColumn(name, F.lit(0).cast("long")).schema)


def coded(seen: pd.DataFrame, frame: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """For each row of ``frame`` the row of ``seen`` with its ``by``, and the values of ``by`` that ``seen`` lacks, which follow its rows."""
    if not by:
        return np.zeros(len(frame), np.int64), frame.iloc[: 0 if len(seen) else 1][by]
    both = pd.concat([seen[by], frame[by]], ignore_index=True) if len(seen) else frame[by]
    codes = both.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    first = np.unique(codes, return_index=True)[1][len(seen) :]
    return codes[len(seen) :], both.iloc[first]
