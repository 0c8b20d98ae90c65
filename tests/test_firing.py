"""Windows of a stream that fire before their end and again for late rows."""

import pytest
from pyspark.sql import functions as F

import weir as w
from weir.plans.schema import DataType
from weir.sources import binary

S = w.Time.seconds
SCHEMA = w.Schema.create().add_fix_size_field("k", DataType.Long).add_fix_size_field("v", DataType.Long).add_fix_size_field("ms", DataType.Long)


def run(spark, tmp_path, build, parts):
    """What a query has written after each of ``parts``, lists of ``k, v, seconds``."""
    path, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in parts:
        binary.write(spark.createDataFrame([(k, v, s * 1000) for k, v, s in rows], SCHEMA.struct()).coalesce(1), path, SCHEMA)
        q = build(w.Query.generate(w.Config().with_run_length(1000), SCHEMA, path).input(w.InputType.BinaryFile, streaming=True)).write(out)
        q.execute(spark, checkpoint=str(tmp_path / "cp")).awaitTermination(60)
        df = spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(out)
        now = [tuple(int(x.timestamp()) if hasattr(x, "timestamp") else x for x in r) for r in df.collect()]
        seen.append(sorted(set(now) - {x for s in seen for x in s}))
        assert len(now) == len(set(now))
    return seen


PARTS = [[(1, 1, 5), (1, 2, 7), (2, 3, 4), (1, 4, 20)], [(1, 8, 6), (2, 16, 21), (3, 32, 9)], [(1, 64, 8), (1, 128, 50), (9, 1, 51)], [(1, 256, 3), (2, 512, 45)]]


def test_a_late_row_corrects_its_window(spark, tmp_path):
    """The watermark is that of the batches before: 20 s at the second, 21 at the third, 51 at the last, when the first window is gone."""
    build = lambda q: q.group_by("k").window(w.TumblingEventTimeWindow(S(10), "ms").with_allowed_lateness(S(20))).aggregate(w.Sum("v"), w.Count())
    got = run(spark, tmp_path, build, PARTS)
    assert got == [
        [(1, 0, 10, 0, 3, 2), (2, 0, 10, 0, 3, 1)],
        [(1, 0, 10, 1, 11, 3), (3, 0, 10, 0, 32, 1)],
        [(1, 0, 10, 2, 75, 4), (1, 20, 30, 0, 4, 1), (2, 20, 30, 0, 16, 1)],
        [(2, 40, 50, 0, 512, 1)],
    ]


def test_rows_that_come_too_late(spark, tmp_path):
    build = lambda q: q.group_by("k").window(w.SlidingEventTimeWindow(S(10), S(5), "ms").with_allowed_lateness(S(20))).late_rows()
    got = run(spark, tmp_path, build, PARTS)
    assert got == [[], [], [], [(1, 256, 3000, -5), (1, 256, 3000, 0)]]


@pytest.mark.parametrize("purge", [True, False])
def test_a_window_fires_at_every_nth_row_and_its_end(spark, tmp_path, purge):
    """Over batches that end between firings; windows that slide are counted each."""
    trigger = w.PurgingTrigger(w.CountTrigger(2)) if purge else w.CountTrigger(2)
    build = lambda q: q.group_by("k").window(w.SlidingEventTimeWindow(S(20), S(10), "ms").with_early_firing(trigger)).aggregate(w.Sum("v"), w.Count())
    parts = [[(1, 1, 1), (1, 2, 2), (1, 4, 3)], [(1, 8, 12), (1, 16, 13)], [(1, 32, 40)]]
    got = run(spark, tmp_path, build, parts)
    a = [(1, -10, 10, 0, 3, 2), (1, 0, 20, 0, 3, 2)]
    if purge:
        b = [(1, -10, 10, 1, 4, 1), (1, 0, 20, 1, 12, 2), (1, 10, 30, 0, 24, 2)]
        c = [(1, 0, 20, 2, 16, 1)]
    else:
        b = [(1, -10, 10, 1, 7, 3), (1, 0, 20, 1, 15, 4), (1, 10, 30, 0, 24, 2)]
        c = [(1, 0, 20, 2, 31, 5)]
    assert got == [a, b, c]


def test_parts_merge_as_in_batch():
    """Nulls, not-a-number as the largest, large integers exactly, and an error where a sum passes 64 bits."""
    from pyspark.sql import types as T

    from weir.streaming.firing import FiringWindows

    state = T.StructType([T.StructField(n, T.LongType()) for n in ("v0", "hv0", "v1", "hv1", "v2", "hv2")])
    machine = FiringWindows(1, 0, False, 0, 0, ["sum", "min", "max"], state)
    nan = float("nan")
    assert machine._add(None, (1, True, 2.0, True, 3.0, True)) == (1, True, 2.0, True, 3.0, True)
    assert machine._add((1 << 60, True, nan, True, None, False), (5, True, 1.0, True, 4.0, True)) == ((1 << 60) + 5, True, 1.0, True, 4.0, True)
    assert repr(machine._add((0, False, 3.0, True, nan, True), (0, False, nan, True, 9.0, True))) == repr((0, False, 3.0, True, nan, True))
    with pytest.raises(OverflowError):
        machine._add(((1 << 63) - 1, True, 0, True, 0, True), (1, True, 0, True, 0, True))


def test_what_cannot_fire_again(spark):
    df = spark.range(3).selectExpr("id as k", "id as ms")
    window = w.TumblingEventTimeWindow(S(10), "ms").with_allowed_lateness(S(5))
    with pytest.raises(ValueError, match="of a stream"):
        w.Query.over(df).window(window).aggregate(w.Count()).to_df(spark)
    with pytest.raises(ValueError, match="late rows"):
        w.Query.over(df).window(window).late_rows().to_df(spark)
    with pytest.raises(ValueError, match="count of rows"):
        window.with_early_firing(w.ProcessingTimeTrigger(S(1)))


class Kept(dict):
    """A bucket's map state and timers, and how often they are written."""

    def __init__(self):
        self.saved, self.timers, self.getMapState, self.registerTimer = 0, [], lambda *_: self, lambda at: self.timers.append(at)

    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__  # noqa: N815

    def updateValue(self, key, value):  # noqa: N802
        self[key], self.saved = value, self.saved + 1


def test_state_is_written_by_bucket_and_window_not_by_key():
    """500 keys of 20 windows: 20 writes and timers; what was held is merged with what comes later."""
    import pandas as pd
    from pyspark.sql import types as T

    from weir.streaming.firing import FiringWindows
    from weir.streaming.packed import stored

    state = T.StructType([T.StructField("v0", T.LongType()), T.StructField("hv0", T.BooleanType())])
    machine, kept = FiringWindows(10_000_000, 0, False, 0, 1, ["sum"], state), Kept()
    machine.init(kept)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0, "getExpiryTimeInMs": lambda self: 10_000})()
    rows = pd.DataFrame([(k, True, 1, True, w * 10_000_000) for w in range(20) for k in range(500)], columns=["k0", "hk0", "v0", "hv0", "at"])
    for _ in range(2):
        assert list(machine.handleInputRows((0,), iter([pd.DataFrame({"at": [0], "rows": [stored(rows)]})]), clock)) == []
    assert (kept.saved, len(kept.timers)) == (40, 20)
    (out,) = machine.handleExpiredTimer((0,), None, clock)
    assert sorted(out["k0"]) == list(range(500)) and set(out["v0"]) == {2} and set(out["w"]) == {0} and len(kept) == 19


def test_firings_count_in_order_over_many_ranges(spark, tmp_path):
    """Rows 0 to 1999 of one key in two files, read by ranges of 20 rows: each firing has the next five."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    binary.write(spark.range(0, 2000, 1, 2).selectExpr("7L as k", "id as v", "id as ms"), path, SCHEMA)
    window = w.TumblingEventTimeWindow(S(100), "ms").with_early_firing(w.PurgingTrigger(w.CountTrigger(5)))
    q = w.Query.generate(w.Config().with_run_length(1000), SCHEMA, path).input(w.InputType.BinaryFile, streaming=True, range_bytes=20 * SCHEMA.record_size())
    q = q.group_by("k").window(window).aggregate(w.Min("v"), w.Max("v"), w.Count()).write(out)
    q.execute(spark, checkpoint=str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(out).select("firing", "v_min", "v_max", "count")
    assert sorted(map(tuple, got.collect())) == [(i, 5 * i, 5 * i + 4, 5) for i in range(400)]


def test_running_merges_equal_merges_one_by_one():
    """Of whole numbers, doubles with not-a-number and texts, with and without values."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from weir.streaming.firing import FiringWindows

    draw = np.random.default_rng(5)
    n, merges = 300, ["sum", "min", "max", "sum", "max", "min"]
    columns = [draw.integers(-9, 9, n), draw.integers(-9, 9, n), draw.normal(size=n), draw.normal(size=n), np.where(draw.random(n) < 0.1, np.nan, draw.normal(size=n)), draw.choice(list("abc"), n).astype(object)]
    frame = pd.DataFrame({"w": np.sort(draw.integers(0, 40, n))} | {f"{h}v{i}": draw.random(n) < 0.6 if h else c for i, c in enumerate(columns) for h in ("", "h")})
    state = T.StructType([T.StructField(f"{h}v{i}", T.LongType()) for i in range(6) for h in ("", "h")])
    machine, held = FiringWindows(1, 0, False, 0, 0, merges, state), {}
    got = machine._running(frame)
    for (_, row), (_, new) in zip(frame.iterrows(), got.iterrows(), strict=True):
        held[row["w"]] = machine._add(held.get(row["w"]), tuple(row[c] for c in state.names))
        for i in range(6):
            value, has = held[row["w"]][2 * i : 2 * i + 2]
            assert bool(new[f"hv{i}"]) == bool(has)
            assert not has or new[f"v{i}"] == pytest.approx(value, nan_ok=True)


@pytest.mark.parametrize("purge", [True, False])
def test_windows_of_a_bucket_are_converted_together(monkeypatch, purge):
    """50 windows of 4 keys, of 5 or 2 rows each and fired at every third: no frame is made for a window when it is kept, none is loaded when it ends."""
    import pandas as pd
    from pyspark.sql import types as T

    from weir.streaming import firing, packed

    calls, rows = [], [(k, True, 1, True, w * 10_000_000) for w in range(50) for k in range(4) for _ in range(5 if k % 2 else 2)]
    for name in ("stored", "loaded"):
        monkeypatch.setattr(firing, name, lambda x, f=getattr(packed, name): calls.append(1) or f(x))
    state = T.StructType([T.StructField("v0", T.LongType()), T.StructField("hv0", T.BooleanType())])
    machine, kept = firing.FiringWindows(10_000_000, 3, purge, 0, 1, ["sum"], state), Kept()
    machine.init(kept)
    clock = lambda at: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0, "getExpiryTimeInMs": lambda self: at})()
    frame = pd.DataFrame(rows, columns=["k0", "hk0", "v0", "hv0", "at"])
    out = list(machine.handleInputRows((0,), iter([pd.DataFrame({"at": [0], "rows": [packed.stored(frame)]})]), clock(0)))
    for at in sorted(kept.timers):
        out += machine.handleExpiredTimer((0,), None, clock(at))
    got = sorted(map(tuple, pd.concat(out)[["w", "k0", "firing", "v0"]].to_numpy().tolist()))
    one = [(0, 0, 2), (1, 0, 3), (1, 1, 2 if purge else 5), (2, 0, 2), (3, 0, 3), (3, 1, 2 if purge else 5)]
    assert got == [(w * 10_000_000, *x) for w in range(50) for x in one]
    assert not calls and not kept


@pytest.mark.parametrize("late", [True, False])
def test_ordered_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch, late):
    """No task sorts all rows before a stream reads them: each has a range of the events, in their order."""
    from weir.plans import catalog_io

    class Stop(Exception):
        pass

    def look(df, *_):
        found.extend(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        raise Stop

    found, kept = [], spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.range(8000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) as ts", "id % 7 as user_id", "'view' as event_type", "1.5D as value").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(binary, "write", look)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Stop):
            catalog_io.refired(lambda q: q.window(w.TumblingEventTimeWindow(S(10), "dateTime").with_allowed_lateness(S(20))).late_rows(), late)(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert sum(found) == (7200 if late else 8000) and len(found) == 8 and max(found) < sum(found) / 2
