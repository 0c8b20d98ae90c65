"""Sliding windows by panes give what expanded ones give."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import weir as w
from weir.operators import panes

S = w.Time.seconds


def both(monkeypatch, spark, q):
    out = []
    for ratio in (1, 10**9):
        monkeypatch.setattr(panes, "LEAST_RATIO", ratio)
        df = q.to_df(spark)
        keys = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("double",)]
        out.append((df.schema.simpleString(), sorted((tuple(r) for r in df.select(*keys, *(c for c in df.columns if c not in keys)).collect()), key=repr)))
    return out


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(("kind", "size", "slide", "offset", "keys"), [
    ("timestamp_ntz", 60, 20, 0, ["k"]), ("timestamp", 60, 5, 3, ["_block", "k"]), ("bigint", 40, 40, 0, ["k"]), ("timestamp_ntz", 900, 1, 0, []),
])
def test_panes_equal_expanded_windows(spark, monkeypatch, zone, kind, size, slide, offset, keys):
    """Gaps of all lengths, times on the bounds and before the epoch, nulls, a clock change, keys named as inner columns."""
    at = datetime(2024, 11, 3, 5, 59) if size < 900 else datetime(1969, 12, 31, 23, 50)
    gaps = [0, 1, 19, 20, 21, 60, 59, 61, 240, 0, 5, 3600, 40] * 2
    rows, now = [], at
    for i, g in enumerate(gaps):
        now += timedelta(seconds=g, microseconds=0 if i % 3 else 1)
        rows.append((None if i % 7 == 0 else i % 2, i % 3, i, None if i % 5 == 0 else i / 8, f"v{i * 7 % 10}", now if i != 4 else None))
    df = spark.createDataFrame(rows, "k int, _block int, p0 long, d double, s string, t timestamp_ntz")
    if kind == "bigint":
        df = df.withColumn("t", F.unix_millis(F.col("t").cast("timestamp")))
    elif kind == "timestamp":
        df = df.withColumn("t", F.col("t").cast("timestamp"))
    window = w.Window(S(size), "t", S(slide), offset=S(offset))
    q = w.Query.over(df).group_by(*keys).window(window).aggregate(w.Avg("d"), w.Sum("p0"), w.Min("s"), w.Max("t"), w.Min("d"), w.Count())
    (schema, got), (want_schema, want) = both(monkeypatch, spark, q)
    assert schema == want_schema and len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, nan_ok=True) if all(isinstance(x, float | int) for x in a) else [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)])


def test_nothing_is_lost_to_cancellation(spark, monkeypatch):
    rows = [(0, 1e20), (5, 1.0), (100, 2.0)]
    df = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(seconds=s), v) for s, v in rows], "t timestamp_ntz, v double")
    q = w.Query.over(df).window(w.SlidingEventTimeWindow(S(10), S(1), "t")).aggregate(w.Sum("v"))
    (_, got), (_, want) = both(monkeypatch, spark, q)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_are_not_copied_for_each_window(spark):
    df = spark.range(10).selectExpr("id % 3 as k", "id as v", "timestamp_seconds(1700000000 + id * 997) as t")
    q = w.Query.over(df).group_by("k").window(w.SlidingEventTimeWindow(S(3600), S(1), "t")).aggregate(w.Sum("v"), w.Max("v"))
    q.to_df(spark).count()
    began = time.perf_counter()
    n = q.to_df(spark).count()
    assert n > 30_000 and time.perf_counter() - began < 10
    assert "Expand" not in q.to_df(spark)._jdf.queryExecution().executedPlan().toString()


def test_an_aggregation_of_ones_own_without_parts_is_expanded(spark):
    class Range(w.Aggregation):
        def columns(self, df):
            return [(F.max(self.field) - F.min(self.field)).alias("range")]

    df = spark.range(20).selectExpr("id as v", "timestamp_seconds(id * 3) as t")
    q = w.Query.over(df).window(w.SlidingEventTimeWindow(S(30), S(2), "t")).aggregate(Range("v"))
    assert q.to_df(spark).agg(F.max("range")).first()[0] == 9
    assert w.Query.over(df.limit(0)).window(w.SlidingEventTimeWindow(S(30), S(2), "t")).aggregate(w.Sum("v")).to_df(spark).count() == 0


def test_parts_of_seconds_are_refused():
    with pytest.raises(ValueError, match="whole number"):
        w.SlidingEventTimeWindow(timedelta(milliseconds=1500), S(1), "t")
