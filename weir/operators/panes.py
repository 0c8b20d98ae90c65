"""Sliding windows by panes: rows are aggregated once, whatever the ratio of size and slide.

A pane is one slide long.  A window covers ``ratio`` panes; blocks of ``ratio``
panes are laid over the time line, so a window is the end of one block and the
beginning of the next.  Running merges within a block, from its end and from its
beginning, give both in linear work for any mergeable aggregate (nothing is
subtracted, so sums of doubles lose nothing).  Between the starts at which a
pane enters or leaves, all windows of a key have one content: such runs of
windows are what is shuffled and merged, and the windows are counted out last.

The unit of work is a block of a key: a key with all rows is dealt over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from weir.functions.aggregates import Merging

#: Windows of fewer slides than this are expanded: copying a row so often costs less than a shuffle.
LEAST_RATIO = 8

MICROS = 1_000_000


def micros(c: str, kind: T.DataType) -> Column:
    """Microseconds since the epoch; of a time without zone as it is written, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"unix_date(cast({c} as date)) * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L + cast(extract(second from {c}) * 1000000 as bigint)"
        )
    return F.unix_micros(F.col(c))


def instant(us: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        zero = F.lit(0)
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, us.cast("decimal(20,0)") / MICROS)
    return F.timestamp_micros(us)


def slid(df: DataFrame, time: str, keys: list[str], size: int, slide: int, offset: int, merging: Merging, name: str) -> DataFrame:
    """``keys, name`` (a struct of ``start``, ``end``) and the results, over the finite ``df``; bounds in seconds.

    Rows without a time are in no window, as with Spark's ``window``.
    """
    ratio, parts, kind = size // slide, merging.flat, df.schema[time].dataType
    k = [f"k{i}" for i in range(len(keys))]  # from here on there are no user's columns, so no names can meet
    p = [f"p{i}" for i in range(len(parts))]
    us, step = micros("`t`", kind) - offset * MICROS, slide * MICROS
    rows = df.filter(F.col(time).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(time).alias("t"), *(x.value.alias(n) for x, n in zip(parts, p, strict=True)))
    rows = rows.withColumn("us", us).withColumn("pane", F.expr(f"(us - pmod(us, {step}L)) div {step}L"))
    panes = rows.groupBy(*k, "pane").agg(*(x.over(F.col(n)).alias(n) for x, n in zip(parts, p, strict=True)))
    block = F.expr(f"(pane - pmod(pane, {ratio}L)) div {ratio}L")
    whole = F.struct(*p)
    nothing = F.lit(None).cast(T.StructType(panes.select(*p).schema.fields))
    # the windows that start at `at` and later have lost a pane (`ended`) or gained one (`begun`)
    event = lambda b, at, ended, begun: F.struct(b.alias("block"), at.alias("at"), ended.alias("ended"), begun.alias("begun"))
    pane = F.col("pane")
    events = F.array(event(block, pane + 1, whole, nothing), event(block, block * ratio, nothing, nothing), event(block - 1, pane - ratio + 1, nothing, whole))
    events = panes.select(*k, F.explode(events).alias("e")).select(*k, "e.*").repartition(*k, "block")
    merged = lambda side: [x.over(F.col(f"{side}.{n}")).alias(f"{side}_{n}") for x, n in zip(parts, p, strict=True)]
    events = events.groupBy(*k, "block", "at").agg(*merged("ended"), *merged("begun"), F.count("ended").alias("old"), F.count("begun").alias("new"))
    onwards = W.partitionBy(*k, "block").orderBy("at")
    so_far, to_come = onwards.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*k, "block").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    limit = (F.col("block") + 1) * ratio
    running = [x.over(F.col(f"ended_{n}")).over(to_come).alias(f"ended_{n}") for x, n in zip(parts, p, strict=True)]
    running += [x.over(F.col(f"begun_{n}")).over(so_far).alias(f"begun_{n}") for x, n in zip(parts, p, strict=True)]
    held = F.coalesce(F.sum("old").over(to_come), F.lit(0)) + F.sum("new").over(so_far)
    runs = events.select(*k, "at", limit.alias("limit"), F.least(limit, F.coalesce(F.lead("at").over(onwards), limit)).alias("until"), held.alias("held"), *running)
    runs = runs.filter((F.col("held") > 0) & (F.col("at") < F.col("until")))
    values = merging.results([x.both(F.col(f"ended_{n}"), F.col(f"begun_{n}")) for x, n in zip(parts, p, strict=True)])
    runs = runs.select(*k, F.struct(*values).alias("values"), F.explode(F.sequence("at", F.col("until") - 1)).alias("s"))
    start = F.col("s") * step + offset * MICROS
    bounds = F.struct(instant(start, kind).alias("start"), instant(start + size * MICROS, kind).alias("end"))
    return runs.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), bounds.alias(name), "values.*")


def slid_stream(df: DataFrame, time: str, keys: list[str], size: str, slide: str, offset: str, merging: Merging, name: str) -> DataFrame:
    """The same over a stream with a watermark on ``time``, in append mode: panes first, then their windows, both in the state store."""
    parts = merging.flat
    k, p = [f"k{i}" for i in range(len(keys))], [f"p{i}" for i in range(len(parts))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(time).alias("t"), *(x.value.alias(n) for x, n in zip(parts, p, strict=True)))
    panes = rows.groupBy(*k, F.window("t", slide, slide, offset).alias("pane")).agg(*(x.over(F.col(n)).alias(n) for x, n in zip(parts, p, strict=True)))
    windows = panes.groupBy(*k, F.window(F.window_time("pane"), size, slide, offset).alias("w")).agg(*(x.over(F.col(n)).alias(n) for x, n in zip(parts, p, strict=True)))
    return windows.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), F.col("w").alias(name), *merging.results([F.col(n) for n in p]))
