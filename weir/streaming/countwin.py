"""Row-count windows of a stream, kept in Spark's state store.

With aggregations the state of a bucket of keys is the merged parts of their open
windows (a row for each group in one), whatever the size of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from weir.functions.aggregates import Merging
from weir.operators.countwin import free
from weir.streaming.packed import bucket, coded, loaded, packed, places, stored, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _bytes(frame: pd.DataFrame) -> bytes:
    """A frame as an Arrow stream, a format that later versions read too."""
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _frame(stored: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(stored).read_all().to_pandas()


class RowCounter(StatefulProcessor):
    """Numbers the rows of a key as they arrive, by ``place``; state is one count."""

    def __init__(self, size: int, keep: list[str], place: str) -> None:
        self.size, self.keep, self.place = size, keep, place

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))
        self.rows = handle.getListState("rows", T.StructType([T.StructField("row", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        index = self.count.get()[0] if self.count.exists() else 0
        waiting = [_frame(r[0]) for r in self.rows.get()] if self.rows.exists() else []
        arrived = [f for f in rows if len(f)]  # of one key and batch
        for frame in [pd.concat(arrived, ignore_index=True).sort_values(self.place, kind="stable")] if arrived else []:
            frame = frame[self.keep]
            if waiting:
                frame = pd.concat([*waiting, frame], ignore_index=True)
            full = len(frame) // self.size * self.size
            if full:
                out = frame.iloc[:full].copy()
                out["window_index"] = [index + i // self.size for i in range(full)]
                index += full // self.size
                yield out
            rest = frame.iloc[full:]
            waiting = [rest] if len(rest) else []
        self.count.update((index,))
        if waiting:
            self.rows.put([(_bytes(f),) for f in waiting])
        else:
            self.rows.clear()

    def close(self) -> None:
        pass


#: A value of each type that stands where there is none, so that a column keeps its type in pandas.
_BLANK = {T.StringType: "''", T.BooleanType: "false", T.TimestampType: "timestamp'1970-01-01'", T.TimestampNTZType: "timestamp_ntz'1970-01-01'", T.DateType: "date'1970-01-01'"}


def _blank(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "0"
    for of, text in _BLANK.items():
        if isinstance(kind, of):
            return text
    raise ValueError(f"values of type {kind.simpleString()} are not kept in the state of a stream's windows")


def _whole(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of 64-bit integers; one that passes them is an error, as in batch."""
    if np.abs(np.add.reduceat(values.astype(np.float64), starts)).max() > 9.2e18:
        raise OverflowError("a sum in a count window passes 64 bits")
    return np.add.reduceat(values, starts)


def _merged(values: np.ndarray, starts: np.ndarray, how: str) -> np.ndarray:
    """Merge of each run of ``values``; not-a-number is the largest, as in Spark."""
    if how == "sum":
        return _whole(values.astype(np.int64), starts) if values.dtype.kind in "iu" else np.add.reduceat(values, starts)
    if values.dtype.kind == "f":
        return (np.fmin if how == "min" else np.maximum).reduceat(values, starts)
    return (np.minimum if how == "min" else np.maximum).reduceat(values, starts)


class PartKeeper(StatefulProcessor):
    """Merges the parts of the rows of a bucket of keys window by window; state is the open windows' parts.

    A row has ``k0..`` (its key), ``g0..`` (its group), ``v0..`` (its parts)
    and ``hk0.., hg0.., hv0..`` (whether it has them).
    """

    def __init__(self, size: int, keys: int, groups: int, merges: list[str], state: T.StructType) -> None:
        self.size, self.merges, self.state = size, merges, state
        self.keys = [f"{h}k{i}" for i in range(keys) for h in ("", "h")]
        self.groups = ["c", *(f"{h}g{i}" for i in range(groups) for h in ("", "h"))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = T.StructType([T.StructField("seen", T.BinaryType()), T.StructField("open", T.BinaryType())])
        self.kept = handle.getValueState("kept", kept)

    def _sums(self, frame: pd.DataFrame) -> pd.DataFrame:
        """A row for each ``w`` and group of ``frame``."""
        by = ["w", *self.groups]
        codes, out = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy(), frame.drop_duplicates(by)[by].reset_index(drop=True)
        for i, how in enumerate(self.merges):
            has = frame[f"hv{i}"].to_numpy(dtype=bool)
            values = frame[f"v{i}"]
            values = (values if values.dtype.kind in "iuf" else values.astype(object)).to_numpy()
            order = np.argsort(codes[has], kind="stable")
            own, starts = np.unique(codes[has][order], return_index=True)
            merged = pd.Series(values[:1].repeat(len(out)) if len(values) else [], dtype=values.dtype)
            if len(own):
                merged.iloc[own] = _merged(values[has][order], starts, how)
            out[f"v{i}"], out[f"hv{i}"] = merged, np.isin(np.arange(len(out)), own)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """``seen`` has a key's full windows and the rows in its open one; ``open`` the parts of that, by the key's row in ``seen`` (c)."""
        seen, kept = pd.DataFrame(), None
        if self.kept.exists():
            seen, kept = (x if x is None else loaded(x) for x in self.kept.get())
        for frame in unpacked(rows):
            codes, new = coded(seen, frame, self.keys)
            seen = pd.concat([seen, new.assign(index=0, filled=0)], ignore_index=True)
            index, filled = seen["index"].to_numpy(), seen["filled"].to_numpy()
            place = pd.Series(codes).groupby(codes).cumcount().to_numpy() + filled[codes]
            found = self._sums(frame[self.state.names].assign(w=place // self.size, c=codes))
            if kept is not None:
                found = self._sums(pd.concat([kept.assign(w=0), found], ignore_index=True))
            filled = filled + np.bincount(codes, minlength=len(seen))
            full, own = filled // self.size, found["c"].to_numpy()
            done = found[found["w"] < full[own]]
            if len(done):
                named = seen[self.keys].iloc[done["c"]].reset_index(drop=True)
                done = done.assign(window_index=index[done["c"]] + done["w"]).reset_index(drop=True)
                yield pd.concat([named, done[[*self.state.names, "window_index"]]], axis=1)
            kept = found[found["w"] >= full[own]].drop(columns="w")
            kept = kept if len(kept) else None
            seen["index"], seen["filled"] = index + full, filled % self.size
        if len(seen):
            self.kept.update((stored(seen), None if kept is None else stored(kept)))

    def close(self) -> None:
        pass


def key_columns(df: DataFrame, keys: list[str]) -> tuple[list[Column], list[T.StructField]]:
    """``k0, hk0..``: values of the keys, with a blank where there is none, and whether there is one."""
    kinds = [df.schema[c].dataType for c in keys]
    columns = [x for i, (c, k) in enumerate(zip(keys, kinds, strict=True)) for x in (F.coalesce(c, F.expr(_blank(k)).cast(k)).alias(f"k{i}"), F.col(c).isNotNull().alias(f"hk{i}"))]
    return columns, [x for i, k in enumerate(kinds) for x in (T.StructField(f"k{i}", k), T.StructField(f"hk{i}", T.BooleanType()))]


def stream_count_aggregates(df: DataFrame, size: int, keys: list[str], groups: list[str], aggregations) -> DataFrame:
    """``keys`` (or ``groups``), ``window_index`` and the aggregates of each window as it fills.

    ``keys`` count the rows of each key; with ``groups`` the windows are over
    all rows in their order of arrival, so one task counts them, and a window
    has a row for each group.  Without aggregations the rows themselves are
    returned.  Keys that are null are a key.
    """
    if not aggregations:
        return stream_count_windows(df, size, keys, groups, aggregations)
    if size < 1:
        raise ValueError("a count window needs at least one row")
    merging = Merging.of(df, aggregations)
    if merging is None:
        raise ValueError("a stream's count window needs aggregations that can be merged: give them parts() and result()")
    _need_rocksdb(df)
    flat = merging.flat
    sums = df.groupBy().agg(*(p.over(p.value).alias(f"v{i}") for i, p in enumerate(flat))).schema.fields
    kept = [(f"g{i}", F.col(c), df.schema[c].dataType) for i, c in enumerate(groups)]
    kept += [(f"v{i}", p.value.cast(f.dataType), f.dataType) for i, (p, f) in enumerate(zip(flat, sums, strict=True))]
    columns = [x for n, c, kind in kept for x in (F.coalesce(c, F.expr(_blank(kind)).cast(kind)).alias(n), c.isNotNull().alias(f"h{n}"))]
    state = T.StructType([x for n, _, kind in kept for x in (T.StructField(n, kind), T.StructField(f"h{n}", T.BooleanType()))])
    by, own = key_columns(df, keys)
    rows = df.select(*by, *columns, bucket(keys).alias("b"))
    out = packed(rows).groupBy("b").transformWithStateInPandas(
        PartKeeper(size, len(keys), len(groups), [p.merge for p in flat], state), T.StructType([*own, *state.fields, T.StructField("window_index", T.LongType())]), "append", "none"
    )
    kept += [(f.name, None, f.dataType) for f in own[::2]]
    nan = {n: F.lit(float("nan")) for n, _, kind in kept if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)}
    value = lambda n: F.coalesce(n, nan[n]) if n in nan else F.col(n)  # noqa: E731  pandas hands not-a-number back as null
    known = lambda n: F.when(F.col(f"h{n}"), value(n))
    named = [known(f"k{i}").alias(c) for i, c in enumerate(keys)] + [known(f"g{i}").alias(c) for i, c in enumerate(groups)]
    return out.select(*named, "window_index", *merging.results([known(f"v{i}") for i in range(len(flat))]))


def _need_rocksdb(df: DataFrame) -> None:
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"count windows of a stream need spark.sql.streaming.stateStore.providerClass={ROCKSDB}")


def stream_count_windows(df: DataFrame, size: int, keys: list[str], groups: list[str], aggregations) -> DataFrame:
    """Rows of full windows as they fill, with ``window_index``.

    For whole rows; their aggregates come from :func:`stream_count_aggregates`.
    """
    _need_rocksdb(df)
    place, all_ = free(df, "place", "all")
    keyed = places(df if keys else df.withColumn(all_, F.lit(0)), place)
    schema = T.StructType([*df.schema.fields, T.StructField("window_index", T.LongType())])
    return keyed.groupBy(*(keys or [all_])).transformWithStateInPandas(RowCounter(size, df.columns, place), schema, "append", "none")


def aggregate_full(rows: DataFrame, keys: list[str], aggregations) -> DataFrame:
    """For ``foreachBatch``: every window in ``rows`` is complete."""
    return rows.groupBy(*keys, "window_index").agg(*(c for a in aggregations for c in a.columns(rows)))
