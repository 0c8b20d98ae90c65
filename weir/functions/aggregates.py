"""Aggregations with their fixed output names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from weir.functions.predicates import resolve
from weir.plans.schema import Field


@dataclass(frozen=True)
class Part:
    """What a row gives to an aggregate, and how two of these are merged: ``sum``, ``try_sum``, ``min`` or ``max``.

    Merging skips nulls, is associative, and gives null of nulls alone, so an
    aggregate can be put together from those of panes, batches or tasks.
    """

    value: Column
    merge: str

    def over(self, column: Column) -> Column:
        """The merged value of ``column`` over a group or a window."""
        return getattr(F, self.merge)(column)

    def both(self, a: Column, b: Column) -> Column:
        """The merged value of two columns of one row."""
        if self.merge in ("min", "max"):
            return (F.least if self.merge == "min" else F.greatest)(a, b)
        added = F.try_add(a, b) if self.merge == "try_sum" else a + b
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(added)


class Aggregation:
    """Subclass and return columns from :meth:`columns` to add an aggregate.

    One that also has :meth:`parts` and :meth:`result` can be merged: it is
    computed once for each pane of a sliding window, and kept in the state of a
    stream's count window.
    """

    def __init__(self, field: str | Field | None = None) -> None:
        self.field = field.name if isinstance(field, Field) else field

    def columns(self, df: DataFrame) -> list[Column]:
        raise NotImplementedError

    def parts(self, df: DataFrame) -> list[Part] | None:
        """What is kept of the rows of ``df``; None if that is no fixed number of values."""
        return None

    def result(self, parts: list[Column]) -> list[Column]:
        """The columns of :meth:`columns`, in their order, from merged parts."""
        return parts

    def __str__(self) -> str:
        return f"{type(self).__name__}({self.field or ''})"


class Sum(Aggregation):
    """``<f>_sum``; long for integral input.  ``safe=True``: null on overflow."""

    def __init__(self, field, safe: bool = False) -> None:
        super().__init__(field)
        self.safe = safe

    def columns(self, df):
        add = F.try_sum if self.safe else F.sum
        return [add(resolve(df, self.field)).alias(f"{self.field}_sum")]

    def parts(self, df):  # one overflow of a safe sum is not seen again once it is null
        return None if self.safe else [Part(resolve(df, self.field), "sum")]


class Count(Aggregation):
    """``count``: rows, whatever they hold."""

    def columns(self, df):
        return [F.count(F.lit(1)).alias("count")]

    def parts(self, df):
        return [Part(F.lit(1).cast("long"), "sum")]


class Min(Aggregation):
    def columns(self, df):
        return [F.min(resolve(df, self.field)).alias(f"{self.field}_min")]

    def parts(self, df):
        return [Part(resolve(df, self.field), "min")]


class Max(Aggregation):
    def columns(self, df):
        return [F.max(resolve(df, self.field)).alias(f"{self.field}_max")]

    def parts(self, df):
        return [Part(resolve(df, self.field), "max")]


class Avg(Aggregation):
    """``<f>_avg``, ``<f>_sum`` and ``count``, in this order."""

    def columns(self, df):
        c = resolve(df, self.field)
        kind = df.schema[self.field].dataType
        mean = F.avg(c.cast("double")) if isinstance(kind, T.DecimalType) else F.avg(c)
        return [mean.alias(f"{self.field}_avg"), F.sum(c).alias(f"{self.field}_sum"), F.count(F.lit(1)).alias("count")]

    def parts(self, df):
        c = resolve(df, self.field)
        if not isinstance(df.schema[self.field].dataType, T.NumericType):
            return None
        return [Part(c.cast("double"), "sum"), Part(c.isNotNull().cast("long"), "sum"), Part(c, "sum"), Part(F.lit(1).cast("long"), "sum")]

    def result(self, parts):
        total, known, added, rows = parts
        return [F.when(known > 0, total / known), added, rows]


def distinct(columns: list[Column]) -> list[Column]:
    """Without repeats: Avg and Count, for one, both give ``count``."""
    seen: dict[str, Column] = {}
    for c in columns:
        seen.setdefault(str(c), c)
    return list(seen.values())


@dataclass(frozen=True)
class Merging:
    """The parts of several aggregations over ``df``, and their output columns."""

    aggregations: tuple[Aggregation, ...]
    parts: tuple[tuple[Part, ...], ...]
    outputs: tuple[T.StructField, ...]

    @staticmethod
    def of(df: DataFrame, aggregations) -> Merging | None:
        """None if any of them cannot be merged."""
        parts = [a.parts(df) for a in aggregations]
        if any(p is None for p in parts) or not parts:
            return None
        outputs = []
        for a in aggregations:  # one by one: two of them may give a column of one name
            outputs += df.limit(0).agg(*a.columns(df)).schema.fields if not df.isStreaming else df.groupBy().agg(*a.columns(df)).schema.fields
        return Merging(tuple(aggregations), tuple(map(tuple, parts)), tuple(outputs))

    @property
    def flat(self) -> list[Part]:
        return [p for own in self.parts for p in own]

    def results(self, merged: list[Column]) -> list[Column]:
        """The output columns, each of a name once, typed as plain aggregation types them."""
        out, at = [], 0
        for a, own in zip(self.aggregations, self.parts, strict=True):
            out += a.result(merged[at : at + len(own)])
            at += len(own)
        named = {f.name: c.cast(f.dataType).alias(f.name) for c, f in reversed(list(zip(out, self.outputs, strict=True)))}
        return [named[n] for n in dict.fromkeys(f.name for f in self.outputs)]
