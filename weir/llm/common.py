"""Shared helpers: tables written to the shared folder, joins with hot keys, Arrow batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weir.plans.shared import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_texts(df: DataFrame, columns: list[str], schema: str, per_batch: Callable[[pa.RecordBatch], Iterator[dict]], rows: int = 256) -> DataFrame:
    """Apply ``per_batch`` to Arrow batches of ``columns``, cut to ``rows`` rows each.

    ``per_batch`` yields column dicts; names and types are those of ``schema``.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in per_batch(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    return df.select(*columns).mapInArrow(run, kind)


def hot_join(rows: DataFrame, single: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``single``, which has one row for each ``key`` and how many ``rows`` have it (``n``).

    Keys with over a thousandth of ``total`` rows, at most a thousand of them,
    are joined where their rows are; only the others are shuffled by key.
    """
    hot = single.filter(F.col("n") * 1000 > total)
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(single, key, how)
    return near.unionByName(rest)


#: Bits of the map by which rows that a join may need are told from those that it does not.
MAP_BITS = 1 << 24


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the long ``key`` is not among the one column of ``keys``.

    A map of ``bits`` bits is broadcast, at most ``bits / 64`` rows whatever
    the input, so rows that a join does not need are not shuffled for it.  As
    keys grow past the map, more rows are taken for needed; results are the same.
    """
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    at = rows.withColumn("_at", F.pmod(key, F.lit(bits)))
    at = at.join(F.broadcast(words), F.floor(F.col("_at") / 64) == F.col("_word"), "left")
    found = F.expr("shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1L") == 1
    return at.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_at", "_word", "_bits")


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
