"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.llm.common import hot_join, new_path, remove


def _store(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges.write.parquet(path)
    table = spark.read.schema(edges.schema).parquet(path)
    seal = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return table, path, tuple(seal)


def _with_least(sym: DataFrame, total: int) -> DataFrame:
    """``sym`` with the smallest label ``m`` beside each ``u``: aggregated before any shuffle, and hubs are not moved."""
    least = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(sym, least, "u", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(sym, 2 * total)
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down, total)
    both = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return both.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every vertex of ``edges(u, v)``; the root is the smallest, its own row included.

    Each round is written to the shared folder; the driver sees one count and
    one checksum of it.  Rounds grow with the logarithm of a component's size.
    """
    spark = edges.sparkSession
    table, path, seal = _store(edges.filter("u <> v").select("u", "v").distinct())
    while seal[0]:
        large, large_path, large_seal = _store(_large_star(table, seal[0]))
        after, next_path, next_seal = _store(_small_star(large, large_seal[0]))
        remove(spark, large_path)
        remove(spark, path)
        done = next_seal == seal
        table, path, seal = after, next_path, next_seal
        if done:
            break
    out = table.select("u", F.col("v").alias("root"))
    return out.union(table.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
