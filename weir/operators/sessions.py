"""Sessions of keys with very many rows, without one task for each key.

Rows are merged first into panes as long as the gap, by key, before anything is
shuffled.  Time is cut at approximate quantiles into slices.  Sessions are formed
of the panes of a key and slice; only the first and the last of a slice can go on across its
border, and these few, two for each key and slice, are stitched together by
their ends.  Aggregates are merged from those of the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.functions.aggregates import Merging
from weir.operators.countwin import _cuts
from weir.operators.panes import MICROS, instant, micros

#: Keys that are looked for, and items that the sketch of the key counts tracks.
HOT_KEYS, TRACKED = 64, 4096


def hot_hashes(df: DataFrame, keys: list[str], partitions: int) -> list[int]:
    """Hashes of the keys that have more rows than half an even share of a partition, at most ``HOT_KEYS``.

    By a mergeable sketch of the commonest items, in one pass; a cold key that
    is taken for a hot one, or the reverse, changes no result.
    """
    found = df.agg(F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in found.top or [] if x["count"] * 2 * partitions > found.n]


def is_hot(keys: list[str], hashes: list[int]) -> Column:
    return F.xxhash64(*keys).isin(hashes) if hashes else F.lit(False)


def sliced(df: DataFrame, time: str, keys: list[str], gap: str, merging: Merging, name: str, slices: int | None = None) -> DataFrame:
    """``keys, name`` (a struct of ``start``, ``end``) and the results over the finite ``df``, as by ``session_window``; ``gap`` is a number of seconds ("10 seconds"), any number of rows a key."""
    parts, kind = merging.flat, df.schema[time].dataType
    k, p = [f"k{i}" for i in range(len(keys))], [f"p{i}" for i in range(len(merging.flat))]  # no user's columns from here on
    rows = df.filter(F.col(time).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(time).alias("t"), *(x.value.alias(n) for x, n in zip(parts, p, strict=True)))
    rows = rows.withColumn("us", micros("t", kind))
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = int(gap.split()[0]) * MICROS
    # rows of one pane are less than the gap apart, so in one session: only panes are shuffled and put in order
    merged = [x.over(F.col(n)).alias(n) for x, n in zip(parts, p, strict=True)]
    pane = F.expr(f"(us - pmod(us, {width}L)) div {width}L")
    panes = rows.groupBy(*k, pane.alias("pane")).agg(F.min("us").alias("start"), F.max("us").alias("last"), *merged)
    cuts = _cuts(rows, "us", slices)[1] if slices > 1 else []
    slice_ = F.size(F.filter(F.array(*cuts), lambda x: x <= F.col("start"))) if cuts else F.lit(0)
    within = W.partitionBy(*k, "slice").orderBy("pane")
    local = panes.withColumn("slice", slice_).withColumn("new", F.coalesce((F.col("start") - F.lag("last").over(within) > width).cast("int"), F.lit(1)))
    local = local.withColumn("session", F.sum("new").over(within.rowsBetween(W.unboundedPreceding, 0)))
    local = local.groupBy(*k, "slice", "session").agg(F.min("start").alias("start"), (F.max("last") + width).alias("end"), *merged).drop("session")
    own = W.partitionBy(*k, "slice")
    local = local.withColumn("at", F.row_number().over(own.orderBy("start"))).withColumn("all", F.count(F.lit(1)).over(own))
    border = (F.col("at") == 1) | (F.col("at") == F.col("all"))
    inner = local.filter(~border).select(*k, "start", "end", *p)
    by_start = W.partitionBy(*k).orderBy("start")  # two rows for each slice
    before = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    joined = local.filter(border).withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    joined = joined.withColumn("session", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    joined = joined.groupBy(*k, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), *merged).select(*k, "start", "end", *p)
    whole = inner.unionByName(joined)
    bounds = F.struct(instant(F.col("start"), kind).alias("start"), instant(F.col("end"), kind).alias("end"))
    return whole.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), bounds.alias(name), *merging.results([F.col(n) for n in p]))
