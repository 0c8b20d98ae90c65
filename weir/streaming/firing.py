"""Time windows of a stream that fire more than once: before their end, and again for late rows.

A window is kept as the merged parts of its rows, in the state of its bucket of keys.  The
watermark is the largest event time of the batches before; a window ends when
that passes its end.  Until then a ``CountTrigger`` may fire it at every n-th
row, and what it holds goes (purging) or stays (accumulating).  With an allowed
lateness it is kept on after its end, and each batch that brings it late rows
gives a corrected result; rows that come later still are handed out by
:func:`too_late`, and nowhere else.
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
from weir.operators.panes import MICROS, instant, micros
from weir.streaming.countwin import PartKeeper, _blank, _need_rocksdb, key_columns
from weir.streaming.packed import bucket, coded, loaded, opened, packed, stored, stored_by, unpacked


class FiringWindows(PartKeeper):
    """Rows of a bucket of keys have ``w`` (their window's start, microseconds), key and parts as for :class:`PartKeeper`.

    State is, for each window, what there is of its keys: rows since the last
    firing, firings so far and whether it has ended, and apart from these the
    parts that it holds, by the key's row (w).
    """

    def __init__(self, span: int, every: int, purge: bool, lateness: int, keys: int, merges: list[str], state: T.StructType) -> None:
        super().__init__(1, keys, 0, merges, state)
        self.span, self.every, self.purge, self.lateness, self.groups = span, every, purge, lateness, ["chunk"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = T.StructType([T.StructField("seen", T.BinaryType()), T.StructField("held", T.BinaryType())])
        self.windows = handle.getMapState("windows", T.StructType([T.StructField("w", T.LongType())]), kept)

    def _both(self, how: str, a, has_a: bool, b, has_b: bool) -> tuple:
        """The merge of two values, each with whether it is there."""
        if not (has_a and has_b):
            return (b, has_b) if has_b else (a, has_a)
        if how == "sum":
            both = a + b
            if isinstance(both, int | np.integer) and not -(1 << 63) <= int(a) + int(b) < 1 << 63:
                raise OverflowError("a sum in a window passes 64 bits")
        elif a != a or b != b:  # not-a-number is the largest
            both = (b if a != a else a) if how == "min" else float("nan")
        else:
            both = min(a, b) if how == "min" else max(a, b)
        return both, True

    def _add(self, held: tuple | None, more: tuple) -> tuple:
        """The merge of two windows' parts, each a value and whether it is there."""
        if held is None:
            return more
        return tuple(x for i, how in enumerate(self.merges) for x in self._both(how, *held[2 * i : 2 * i + 2], *more[2 * i : 2 * i + 2]))

    def _running(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Rows in the order of ``w``, each with the merged parts of those of its ``w`` up to it."""
        own = frame["w"].to_numpy()
        n, first = len(own), np.r_[True, own[1:] != own[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        out = {}
        for i, how in enumerate(self.merges):
            column, has = frame[f"v{i}"], frame[f"hv{i}"].to_numpy(dtype=bool)
            values, upto = column.to_numpy(), np.cumsum(has)
            some = upto - upto[start] + has[start] > 0
            if values.dtype.kind not in "iuf" or not np.isfinite(values).all():
                values = values.astype(object)
                for j in np.flatnonzero(~first):
                    values[j] = self._both(how, values[j - 1], some[j - 1], values[j], has[j])[0]
                values = pd.Series(values, dtype=column.dtype)
            elif how == "sum" and values.dtype.kind in "iu":
                values = np.where(has, values, 0).astype(np.int64)
                about = np.cumsum(values.astype(np.float64))
                if np.abs(about - about[start] + values[start]).max() > 9.2e18:
                    raise OverflowError("a sum in a window passes 64 bits")
                total = np.cumsum(values)
                values = total - total[start] + values[start]
            elif how == "sum":
                values = pd.Series(np.where(has, values, 0)).groupby(own).cumsum().to_numpy()
            else:
                ends = np.finfo(values.dtype) if values.dtype.kind == "f" else np.iinfo(values.dtype)
                filled = pd.Series(np.where(has, values, ends.max if how == "min" else ends.min).astype(values.dtype)).groupby(own)
                values = (filled.cummin() if how == "min" else filled.cummax()).to_numpy()
            out[f"v{i}"], out[f"hv{i}"] = values, some
        return frame.assign(**out)

    def _load(self, w: int) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        seen, held = self.windows.getValue((w,))
        return loaded(seen), None if held is None else loaded(held)

    def _save(self, w: int, seen: pd.DataFrame, held: pd.DataFrame | None) -> None:
        self.windows.updateValue((w,), (stored(seen), None if held is None or not len(held) else stored(held)))

    def _fired(self, seen: pd.DataFrame, out: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of key, ``w``, firing and parts: ``out`` has ``w``, the row of its window in ``seen``."""
        if len(out):
            named = seen[[*self.keys, "at"]].iloc[out["w"]].rename(columns={"at": "w"}).reset_index(drop=True)
            yield pd.concat([named, out[["firing", *self.state.names]].reset_index(drop=True)], axis=1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now, names = timers.getCurrentWatermarkInMs() * 1000, self.state.names
        seen, held, known, by = pd.DataFrame(), None, set(), ["at", *self.keys]
        for frame in unpacked(rows):
            frame = frame[frame["at"] + self.span + self.lateness > now].reset_index(drop=True)  # the others are too late
            if not len(frame):
                continue
            for w in map(int, np.setdiff1d(frame["at"].unique(), list(known))):
                known.add(w)
                if self.windows.containsKey((w,)):
                    more, parts = self._load(w)
                    if parts is not None:
                        parts = parts.assign(w=parts["w"] + len(seen))
                        held = parts if held is None else pd.concat([held, parts], ignore_index=True)
                    seen = pd.concat([seen, more.assign(at=w)], ignore_index=True)
                else:
                    self.handle.registerTimer((w + self.span + (self.lateness if w + self.span <= now else 0)) // 1000)
            codes, new = coded(seen, frame, by)
            seen = pd.concat([seen, new.assign(waiting=0, firing=0, ended=False)], ignore_index=True)
            waiting, firing, counts = seen["waiting"].to_numpy(), seen["firing"].to_numpy(), np.bincount(codes, minlength=len(seen))
            open_ = ~seen["ended"].to_numpy(dtype=bool) & (seen["at"].to_numpy() + self.span > now)
            chunk = np.zeros(len(frame), np.int64)
            if self.every:
                place = pd.Series(codes).groupby(codes).cumcount().to_numpy() + waiting[codes]
                chunk = np.where(open_[codes], place // self.every, 0)
            sums = self._sums(frame[names].assign(w=codes, chunk=chunk))
            if held is not None:
                touched = counts[held["w"]] > 0
                sums = self._sums(pd.concat([held[touched].assign(chunk=0), sums], ignore_index=True))
                held = held[~touched]
            sums = sums.sort_values(["w", "chunk"], ignore_index=True)
            if not self.purge:
                sums = self._running(sums)
            own, at = sums["w"].to_numpy(), sums["chunk"].to_numpy()
            if self.every:
                full = open_[own] & ((at + 1) * self.every <= (waiting + counts)[own])
                yield from self._fired(seen, sums[full].assign(firing=firing[own[full]] + at[full]))
                seen["firing"] = firing + np.bincount(own[full], minlength=len(seen))
            else:
                full = np.zeros(len(sums), bool)
            last = np.r_[own[1:] != own[:-1], True] & ~(full & self.purge)
            held = sums[last].drop(columns="chunk") if held is None else pd.concat([held, sums[last].drop(columns="chunk")], ignore_index=True)
            left = waiting + counts
            seen["waiting"] = np.where(open_, left % self.every, left) if self.every else left
            seen["ended"] = seen["ended"].to_numpy(dtype=bool) | ~open_ & (counts > 0)
            seen["late"] = (seen["late"].fillna(False).to_numpy(dtype=bool) if "late" in seen else False) | ~open_ & (counts > 0)
        if not len(seen):
            return
        late = seen.pop("late").to_numpy(dtype=bool)
        out = held[late[held["w"]]].sort_values("w")
        yield from self._fired(seen, out.assign(firing=seen["firing"].to_numpy()[out["w"]]))
        seen["firing"], seen["waiting"] = seen["firing"] + late, np.where(late, 0, seen["waiting"])
        if self.purge:
            held = held[~late[held["w"]]]
        places = seen.groupby("at").cumcount().to_numpy()
        at = seen["at"].to_numpy()
        parts = stored_by(held.assign(w=places[held["w"]]), at[held["w"]])
        for w, mine in stored_by(seen.drop(columns="at"), at).items():
            self.windows.updateValue((w,), (mine, parts.get(w)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        w = at - self.span
        if self.windows.containsKey((w,)):
            seen, held = (x if x is None else opened(x) for x in self.windows.getValue((w,)))
            due = ~seen["ended"].to_numpy().astype(bool) & (seen["waiting"].to_numpy() > 0)
            if held is not None:
                own = held["w"].to_numpy()
                rows = np.flatnonzero(due[own])
                rows = rows[np.argsort(own[rows], kind="stable")]
                if len(rows):  # as Arrow columns: a window has few rows of a bucket, and pandas costs more than these
                    named, parts = seen.take(own[rows]), held.take(rows)
                    columns = {c: named[c] for c in self.keys} | {"w": pa.array(np.full(len(rows), w)), "firing": named["firing"]}
                    yield pa.table(columns | {c: parts[c] for c in self.state.names}).to_pandas()
            if self.lateness:
                seen, held = seen.to_pandas(), held if held is None else held.to_pandas()
                if held is not None and self.purge:
                    held = held[~due[held["w"]]]
                self._save(w, seen.assign(firing=seen["firing"] + due, waiting=0, ended=True), held)
                self.handle.registerTimer((at + self.lateness) // 1000)
            else:
                self.windows.removeKey((w,))
        w = at - self.span - self.lateness
        if self.lateness and self.windows.containsKey((w,)):
            self.windows.removeKey((w,))


class TooLate(StatefulProcessor):
    """Lets through the rows whose window has been let go; keeps nothing."""

    def __init__(self, keep: int, names: list[str]) -> None:
        self.keep, self.names = keep, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            late = frame[frame["w"] + self.keep <= now]
            if len(late):
                yield late[self.names]

    def close(self) -> None:
        pass


def _starts(df: DataFrame, time: str, window) -> Column:
    """The start of a row's window; rows of a sliding window stand in each of theirs."""
    us, slide = micros(f"`{time}`", df.schema[time].dataType), (window.slide or window.size).seconds_ * MICROS
    last = us - F.pmod(us - F.lit(window.offset.seconds_ * MICROS), F.lit(slide))
    return F.explode(F.sequence(last - F.lit(window.size.seconds_ * MICROS - slide), last, F.lit(slide).cast("long")))


def fired(df: DataFrame, time: str, window, keys: list[str], aggregations) -> DataFrame:
    """``keys, window_start, window_end, firing`` (from 0 for each window) and the aggregates at that firing."""
    _need_rocksdb(df)
    merging = Merging.of(df, aggregations)
    if merging is None:
        raise ValueError("a window that fires again needs aggregations that can be merged: give them parts() and result()")
    flat, kind = merging.flat, df.schema[time].dataType
    sums = df.groupBy().agg(*(p.over(p.value).alias(f"v{i}") for i, p in enumerate(flat))).schema.fields
    kept = [(f"v{i}", p.value.cast(f.dataType), f.dataType) for i, (p, f) in enumerate(zip(flat, sums, strict=True))]
    columns = [x for n, c, k in kept for x in (F.coalesce(c, F.expr(_blank(k)).cast(k)).alias(n), c.isNotNull().alias(f"h{n}"))]
    state = T.StructType([x for n, _, k in kept for x in (T.StructField(n, k), T.StructField(f"h{n}", T.BooleanType()))])
    by, own = key_columns(df, keys)
    rows = df.filter(F.col(time).isNotNull()).select(*by, *columns, bucket(keys).alias("b"), _starts(df, time, window).alias("at"))  # its time is no longer among the columns, so late rows come through
    early = window.early
    machine = FiringWindows(window.size.seconds_ * MICROS, early.every() if early else 0, bool(early) and early.purges(), window.allowed.seconds_ * MICROS, len(keys), [p.merge for p in flat], state)
    out = packed(rows).groupBy("b").transformWithStateInPandas(
        machine, T.StructType([*own, T.StructField("w", T.LongType()), T.StructField("firing", T.LongType()), *state.fields]), "append", "EventTime"
    )
    nan = {n: F.lit(float("nan")) for n, k in [*((n, k) for n, _, k in kept), *((f.name, f.dataType) for f in own[::2])] if isinstance(k, T.FractionalType) and not isinstance(k, T.DecimalType)}
    known = lambda n: F.when(F.col(f"h{n}"), F.coalesce(n, nan[n]) if n in nan else F.col(n))
    bounds = [instant(F.col("w"), kind).alias("window_start"), instant(F.col("w") + window.size.seconds_ * MICROS, kind).alias("window_end")]
    return out.select(*(known(f"k{i}").alias(c) for i, c in enumerate(keys)), *bounds, "firing", *merging.results([known(f"v{i}") for i in range(len(flat))]))


def too_late(df: DataFrame, columns: list[str], time: str, window, keys: list[str]) -> DataFrame:
    """The rows of ``df`` that come when their window has been let go, each once for each such window, with its ``window_start``."""
    _need_rocksdb(df)
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.filter(F.col(time).isNotNull()).select(bucket(keys).alias("b"), F.struct(*columns).alias("row"), _starts(df, time, window).alias("w"))
    rows = rows.select("b", *(F.col("row")[c].alias(n) for c, n in zip(columns, names, strict=True)), "w")
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for c, n in zip(columns, names, strict=True)] + [T.StructField("w", T.LongType())])
    out = rows.groupBy("b").transformWithStateInPandas(
        TooLate((window.size.seconds_ + window.allowed.seconds_) * MICROS, [*names, "w"]), schema, "append", "EventTime"
    )
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), instant(F.col("w"), df.schema[time].dataType).alias("window_start"))
