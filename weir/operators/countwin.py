"""Row-count windows over finite data, without one task per key.

``row_number`` over a whole key (or over the whole table) would send all its
rows to one task.  Here the order column is cut at approximate quantiles into
slices; rows are numbered within a slice, and each slice starts where the
counts of the slices before it end.  Slices are a function of the value alone,
so a recomputed task sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to be no column of ``df`` (whatever the case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Distinct values that are drawn for each cut between slices of an order that is not a number.
DRAWN = 32


def _cuts(df: DataFrame, order_by: str, slices: int) -> tuple[Column, list[Column]]:
    """The order as a column to compare, and where it is cut."""
    kind, order = df.schema[order_by].dataType, F.col(order_by)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        order = F.unix_micros(order.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        order = F.unix_date(order)
    elif not isinstance(kind, T.NumericType):  # of the distinct values of each bucket of hashes, one
        drawn = df.filter(order.isNotNull()).groupBy(F.pmod(F.xxhash64(order), F.lit(DRAWN * slices)).alias("bucket")).agg(F.min(order).alias("v"))
        ranked = drawn.select("v", F.row_number().over(W.orderBy("v")).alias("n"), F.count(F.lit(1)).over(W.partitionBy()).alias("all"))
        picked = ranked.filter(F.floor(F.col("n") * slices / F.col("all")) > F.floor((F.col("n") - 1) * slices / F.col("all")))
        return order, [F.lit(r.v) for r in picked.orderBy("v").collect()[:-1]]
    shares = [i / slices for i in range(1, slices)]
    return order, [F.lit(q) for q in sorted(set(df.agg(F.percentile_approx(order, shares, 1000).alias("q")).first().q or []))]


def numbered(df: DataFrame, order_by: str, keys: list[str], name: str = "_rn", slices: int | None = None, total: str | None = None) -> DataFrame:
    """``df`` with ``name``: the 0-based position of a row in its key's order, and ``total``, the rows of its key, if named.

    Any type that can be ordered will do; rows without a value come first.
    ``name`` and ``total`` must be free; what is used inside takes free names.
    """
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, cut, within, n, start, whole = free(df, "_order", "_slice", "_within", "_n", "_start", "_total")
    order, cuts = _cuts(df, order_by, slices) if slices > 1 else (F.col(order_by), [])
    part = F.lit(0)
    if cuts:
        part = F.when(order.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*cuts), lambda x: x <= F.col(value))))
    sliced = df.withColumn(value, order).withColumn(cut, part).drop(value)
    before = W.partitionBy(*keys).orderBy(cut).rowsBetween(W.unboundedPreceding, -1)
    starts = (  # a row for each key and slice
        sliced.groupBy(*keys, cut).agg(F.count(F.lit(1)).alias(n))
        .withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(whole, F.sum(n).over(W.partitionBy(*keys))).drop(n)
    )
    places = sliced.withColumn(within, F.row_number().over(W.partitionBy(*keys, cut).orderBy(order_by)) - 1)
    renamed = dict(zip((*keys, cut), free(places, *(f"_key_{i}" for i in range(len(keys) + 1))), strict=True))
    starts = starts.withColumnsRenamed(renamed)
    out = places.join(starts, [F.col(k).eqNullSafe(F.col(other)) for k, other in renamed.items()], "left")
    return out.select(*df.columns, (F.col(within) + F.col(start)).cast("long").alias(name), *([F.col(whole).alias(total)] if total else []))


def count_windows(df: DataFrame, size: int, order_by: str, keys: list[str], name: str = "window_index") -> DataFrame:
    """Rows of full windows only, with ``name``, the window's number from 0 for each key; ``name`` must be free."""
    if size < 1:
        raise ValueError("a count window needs at least one row")
    at, whole = free(df, "_rn", "_all")
    rows = numbered(df, order_by, keys, at, total=whole)
    rows = rows.withColumn(name, F.floor(F.col(at) / size).cast("long"))
    return rows.filter(F.col(name) < F.floor(F.col(whole) / size)).drop(at, whole)
