"""Sessions cut into slices give what whole keys give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import weir as w
from weir.functions.aggregates import Merging
from weir.operators import sessions

S = w.Time.seconds


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_sliced_sessions_equal_whole_ones(spark, kind):
    """One key with most rows, gaps of just the timeout and a microsecond more, equal times, nulls, sessions over many slices."""
    now, rows = datetime(2024, 1, 1), []
    for i in range(400):
        now += timedelta(seconds=(1, 0, 10, 3, 11)[i % 5] if i > 150 else 1, microseconds=i == 200)
        rows.append((0 if i % 9 else i % 3, None if i % 7 == 0 else i, f"v{i % 13}", None if i % 50 == 3 else now))
    df = spark.createDataFrame(rows, "k int, p0 long, slice string, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
    aggregations = [w.Sum("p0"), w.Avg("p0"), w.Min("slice"), w.Max("t")]
    plain = w.Query.over(df).group_by("k").window(w.SessionEventTimeWindow(S(10), "t")).aggregate(*aggregations).to_df(spark)
    want = sorted(map(repr, map(tuple, plain.collect())))
    for slices in (1, 2, 7, 60):
        out = sessions.sliced(df, "t", ["k"], "10 seconds", Merging.of(df, aggregations), "s", slices)
        assert sorted(map(repr, map(tuple, out.select("k", "s.*", *plain.columns[3:]).collect()))) == want
    everything = w.Query.over(df).window(w.SessionEventTimeWindow(S(10), "t")).aggregate(w.Count()).to_df(spark)
    whole = df.filter("t is not null").groupBy(F.session_window("t", "10 seconds")).count().select("session_window.*", "count")
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, whole.collect()))
    assert w.Query.over(df.limit(0)).window(w.SessionEventTimeWindow(S(10), "t")).aggregate(w.Count()).to_df(spark).count() == 0


def test_the_setting_changes_the_plan_and_not_the_rows(spark):
    """The hot key of a skewed table is found, and its rows are dealt over the slices."""
    df = spark.range(6000).selectExpr("if(id % 3 < 2, 7L, id % 500) as k", "id as v", "timestamp_seconds(id * 4) as t")
    assert sessions.hot_hashes(df, ["k"], 8) == [df.selectExpr("xxhash64(7L) as h").first().h]
    q = lambda on: w.Query.over(df, w.Config().with_distribution_opt(on)).group_by("k").window(w.SessionEventTimeWindow(S(8), "t")).aggregate(w.Sum("v"), w.Count()).to_df(spark)
    assert sorted(map(tuple, q(True).collect())) == sorted(map(tuple, q(False).collect()))
    assert "slice" in q(True)._jdf.queryExecution().analyzed().toString() and "slice" not in q(False)._jdf.queryExecution().analyzed().toString()
    cuts = sessions._cuts(df.filter("k = 7").selectExpr("unix_micros(t) as us"), "us", 8)[1]
    part = F.size(F.filter(F.array(*cuts), lambda x: x <= F.unix_micros("t")))
    assert max(r["count"] for r in df.filter("k = 7").groupBy(part).count().collect()) < 4000 / 8 * 1.5


def test_rows_are_merged_before_they_are_shuffled(spark):
    """Of 40,000 rows of two keys, what is shuffled is a row for each pane; the plan has no sessions of single rows."""
    df = spark.range(0, 40000, 1, 4).selectExpr("id % 2 as k", "id as v", "timestamp_seconds(id div 10) as t")
    out = sessions.sliced(df, "t", ["k"], "500 seconds", Merging.of(df, [w.Sum("v")]), "s", 4)
    assert sorted((r.k, r.v_sum) for r in out.collect()) == [(0, sum(range(0, 40000, 2))), (1, sum(range(1, 40000, 2)))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MergingSessions" not in plan and "pane" in plan
