"""Synthetic bids, uniform or skewed, drawn for the rows of any frame.

Draws are a function of the seed and a row's number, so they can be made again
row by row, by any engine, over a batch or a stream.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weir.plans.schema import DataType, Schema

BID_SCHEMA = (
    Schema.create()
    .add_fix_size_field("auction", DataType.Long)
    .add_fix_size_field("bidder", DataType.Long)
    .add_fix_size_field("price", DataType.Long)
    .add_fix_size_field("dateTime", DataType.Long)
)


def drawn(number: Column, seed: int, stream: int) -> Column:
    """48 random bits for a row: the first twelve hex digits of md5("seed:stream:number")."""
    text = F.concat(F.lit(f"{seed}:{stream}:"), number.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def below(number: Column, n: int, seed: int, stream: int) -> Column:
    """An even draw from 0 to ``n`` - 1, for ``n`` up to 2**31."""
    return F.shiftright(F.shiftright(drawn(number, seed, stream), 16) * F.lit(n).cast("long"), 32)


@lru_cache(4)
def _law(n: int, exponent: float) -> np.ndarray:
    """Chances of the first 1, 2, ... of ``n`` values, the k-th having weight ``k ** -exponent``."""
    sums = np.cumsum(np.arange(1, n + 1, dtype=np.float64) ** -exponent)
    return sums / sums[-1]


def zipf(number: Column, n: int, exponent: float, seed: int, stream: int) -> Column:
    """An exact draw from 0 to ``n`` - 1 by the discrete Zipf law, by inversion of its ``n`` summed chances (8 bytes each in a worker)."""

    @F.pandas_udf("long")
    def draw(bits: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(_law(n, exponent), bits.to_numpy() / 2.0**48, side="right"), n - 1))

    return draw(drawn(number, seed, stream))


def bids_for(df: DataFrame, number: str, persons: int, auctions: int, seed: int = 42, exponent: float | None = None) -> DataFrame:
    """``df`` with ``auction``, ``bidder``, ``price`` (0 to 99) and ``dateTime``, its ``number``; ``exponent`` skews the auctions."""
    n = F.col(number)
    auction = below(n, auctions, seed, 0) if exponent is None else zipf(n, auctions, exponent, seed, 0)
    return df.withColumns({"auction": auction, "bidder": below(n, persons, seed, 1), "price": below(n, 100, seed, 2), "dateTime": n})


def bids(spark: SparkSession, n: int, persons: int, auctions: int, seed: int = 42, zipf: float | None = None) -> DataFrame:
    """``n`` bids, numbered from 0."""
    return bids_for(spark.range(n), "id", persons, auctions, seed, zipf).select("auction", "bidder", "price", "dateTime")
