"""The same steps over a stream give what batch gives."""

import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

import weir as w
from weir.plans.schema import DataType
from weir.sources import binary
from weir.streaming.countwin import aggregate_full, stream_count_windows

SCHEMA = w.Schema.create().add_fix_size_field("k", DataType.Long).add_fix_size_field("v", DataType.Long).add_fix_size_field("ms", DataType.Long)


def source(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    binary.write(spark.createDataFrame(rows, SCHEMA.struct()).coalesce(1), path, SCHEMA)
    return w.Query.generate(w.Config(), SCHEMA, path)


def finished(query):
    query.awaitTermination(60)
    query.processAllAvailable()
    query.stop()


def test_tumbling_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, i * 400) for i in range(100)]
    base = source(spark, tmp_path, rows)
    steps = lambda q: q.filter(w.Greater("v", 9)).group_by("k").window(w.TumblingEventTimeWindow(w.Time.seconds(10), "ms")).aggregate(w.Avg("v"))
    batch = sorted(map(tuple, steps(base).execute(spark)))
    binary.write(spark.createDataFrame([(9, 99, 10**7)], SCHEMA.struct()).coalesce(1), base.path, SCHEMA)  # moves the watermark on
    live = steps(base.input(w.InputType.BinaryFile, streaming=True)).to_output_buffer("tumbled")
    finished(live.execute(spark, checkpoint=str(tmp_path / "cp")))
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert [r for r in got if r[0] != 9] == batch


def test_the_throughput_log_is_of_its_own_query(spark, tmp_path):
    """Rows before the filter, of the logged query alone; the listener goes when it ends, so a second run does not log twice."""
    base = source(spark, tmp_path, [(i % 3, i, i * 400) for i in range(100)]).input(w.InputType.BinaryFile, streaming=True).filter(w.Greater("v", 49))
    for k in range(2):
        seen, log = [], str(tmp_path / f"log-{k}.csv")
        one = base.to_output_buffer(f"one_{k}").execute(spark, checkpoint=str(tmp_path / f"one-{k}"), throughput_log=lambda n, s, seen=seen: seen.append((n, s)))
        two = base.to_output_buffer(f"two_{k}").execute(spark, checkpoint=str(tmp_path / f"two-{k}"), throughput_log=log)
        for q in (one, two):
            q.awaitTermination(60)
        deadline = time.time() + 30
        while not (seen and Path(log).exists()) and time.time() < deadline:
            time.sleep(0.1)
        time.sleep(0.5)
        assert [n for n, _ in seen] == [100] and len(Path(log).read_text().splitlines()) == 1 and spark.table(f"one_{k}").count() == 50


def test_settings_hold_while_a_query_runs(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    config = w.Config().with_parallelism(3).with_buffer_size(7)
    with config.applied(spark):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        w.Query.over(spark.range(100).selectExpr("id % 50 as k"), config).group_by("k").aggregate(w.Count()).write(path).execute(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list(Path(path).glob("part-*"))) == 3
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before


def test_a_stream_ends_after_its_duration(spark, tmp_path):
    q = w.Query(config=w.Config().with_benchmark_run_duration(2)).input(w.InputType.Rate, streaming=True, rowsPerSecond=5).to_output_buffer("rated")
    live = q.execute(spark, checkpoint=str(tmp_path / "cp"), available_now=False)
    began = time.time()
    assert live.awaitTermination(60) and time.time() - began < 50 and not live.isActive


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    """In complete mode: a stream that is killed after its write and before its commit holds each row once."""
    base = source(spark, tmp_path, [(i % 3, i, i) for i in range(30)])
    q = base.input(w.InputType.BinaryFile, streaming=True).group_by("k").aggregate(w.Count()).write(str(tmp_path / "out"))
    checkpoint = str(tmp_path / "cp")
    for _ in range(2):
        q.execute(spark, checkpoint=checkpoint, output_mode="complete").awaitTermination(60)
        read = spark.read.schema("k long, count long").option("sep", ";").csv(str(tmp_path / "out"))
        assert sorted((r["k"], r["count"]) for r in read.collect()) == [(0, 10), (1, 10), (2, 10)] and "batch" in read.columns
        for f in Path(checkpoint).glob("commits/*0*"):  # as if it had died before the commit
            f.unlink()


def test_sliding_and_session_compile_on_streams(spark, tmp_path):
    rows = [(1, i, i * 1000) for i in range(5)] + [(1, 9, 10**7)]
    base = source(spark, tmp_path, rows).input(w.InputType.BinaryFile, streaming=True)
    s = w.Time.seconds
    for name, win in (("slid", w.SlidingEventTimeWindow(s(4), s(2), "ms")), ("sess", w.SessionEventTimeWindow(s(5), "ms"))):
        q = base.group_by("k").window(win).aggregate(w.Count()).to_output_buffer(name)
        finished(q.execute(spark, checkpoint=str(tmp_path / name)))
    assert sum(r["count"] for r in spark.table("slid").collect()) == 10
    assert [r["count"] for r in spark.table("sess").collect()] == [5]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark of an earlier batch does not count, one of an open window does."""
    base = source(spark, tmp_path, [(1, 0, 10**7)])
    q = base.input(w.InputType.BinaryFile, streaming=True).group_by("k").window(w.TumblingEventTimeWindow(w.Time.seconds(10), "ms")).aggregate(w.Count()).write(str(tmp_path / "out"))
    finished(q.execute(spark, checkpoint=str(tmp_path / "cp")))
    binary.write(spark.createDataFrame([(1, 0, 5), (2, 0, 10**7 + 1), (3, 0, 10**8)], SCHEMA.struct()).coalesce(1), base.path, SCHEMA)
    finished(q.execute(spark, checkpoint=str(tmp_path / "cp")))
    got = sorted(r.value.split(";")[0::3] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == [["1", "1"], ["2", "1"]]


def test_keyed_count_windows(spark, tmp_path):
    """Rows themselves, when no aggregation is asked for; the windows of a batch are complete."""
    rows = [(i % 2, i, i) for i in range(11)]
    q = source(spark, tmp_path, rows).input(w.InputType.BinaryFile, streaming=True).key_by("k").window(w.CountWindow(3)).aggregate()
    out = []
    stream = (
        q.to_df(spark).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        .foreachBatch(lambda d, _: out.extend(map(tuple, aggregate_full(d, ["k"], [w.Sum("v")]).collect()))).start()
    )
    finished(stream)
    assert sorted(out) == [(0, 0, 6), (0, 1, 24), (1, 0, 9)]


@pytest.mark.parametrize("grouped", [False, True])
def test_count_window_aggregates_are_kept_in_state(spark, tmp_path, grouped):
    """Every type and nulls, over batches that end inside windows; as batch gives."""
    values = [float("nan") if i % 7 == 0 else None if i % 5 == 0 else i / 8 for i in range(50)]
    rows = [(None if i % 9 == 0 else i % 3, i, (1 << 60) + i if i % 4 else None, v, Decimal(i) / 4 if i % 6 else None, None if i % 8 == 0 else f"s{i % 13}", datetime(2024, 1, 1, 0, i)) for i, v in enumerate(values)]
    kinds = "k long, at long, v long, d double, m decimal(10,2), s string, t timestamp"
    wanted = [w.Min("v"), w.Max("v"), w.Avg("d"), w.Min("d"), w.Max("d"), w.Sum("m"), w.Min("s"), w.Max("t"), w.Count()]
    by = (lambda q: q.group_by("k")) if grouped else (lambda q: q.key_by("k"))
    df = spark.createDataFrame(rows, kinds)
    want = by(w.Query.over(df)).window(w.TumblingProcessingTimeWindow(w.Counter(4), on="at")).aggregate(*wanted).to_df(spark)
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = by(w.Query.over(live)).window(w.CountWindow(4)).aggregate(*wanted)
    assert q.to_df(spark).columns == want.columns
    for k in range(0, 50, 7):
        df.filter(f"at >= {k} and at < {k + 7}").coalesce(1).sortWithinPartitions("at").write.mode("append").parquet(folder)
        stream = q.to_df(spark).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        stream.format("parquet").start(str(tmp_path / "out")).awaitTermination(60)
    tidy = lambda d: sorted(repr(tuple(r)) for r in d.collect())
    assert tidy(spark.read.schema(want.schema).parquet(str(tmp_path / "out"))) == tidy(want)


def test_the_state_of_a_count_window_does_not_grow_with_it(spark, tmp_path):
    rows = [(i % 2, i, i) for i in range(20_000)]
    q = source(spark, tmp_path, rows).input(w.InputType.BinaryFile, streaming=True).key_by("k").window(w.CountWindow(9_990)).aggregate(w.Sum("v"), w.Count())
    live = q.to_output_buffer("large").execute(spark, checkpoint=str(tmp_path / "cp"))
    live.awaitTermination(60)
    state = [s for p in live.recentProgress for s in p.stateOperators]
    assert {(r["k"], r["v_sum"], r["count"]) for r in spark.table("large").collect()} == {(k, sum(range(k, 19_980, 2)), 9_990) for k in (0, 1)}
    assert max(s.numRowsTotal for s in state) <= 8  # for each of two keys: a counter and the one row of its open window


def test_count_windows_need_aggregations_that_merge(spark, tmp_path):
    class Odd(w.Aggregation):
        def columns(self, df):
            return [df[self.field].alias("x")]

    q = source(spark, tmp_path, [(1, 1, 1)]).input(w.InputType.BinaryFile, streaming=True).key_by("k").window(w.CountWindow(3)).aggregate(Odd("v"))
    with pytest.raises(ValueError, match="merged"):
        q.to_df(spark)


def test_every_sink_of_a_stream_is_fed(spark, tmp_path):
    rows = [(i % 3, i, i) for i in range(30)]
    q = source(spark, tmp_path, rows).input(w.InputType.BinaryFile, streaming=True).filter(w.Greater("v", 9))
    live = q.write(str(tmp_path / "one")).write(str(tmp_path / "two")).to_output_buffer("three").execute(spark, checkpoint=str(tmp_path / "cp"))
    live.awaitTermination(60)
    live.stop()
    assert spark.read.text(str(tmp_path / "one")).count() == 20 == spark.read.text(str(tmp_path / "two")).count() == spark.table("three").count()


def test_the_trigger_of_the_window_is_used(spark, tmp_path):
    q = source(spark, tmp_path, [(1, 1, 1), (1, 2, 10**7)]).input(w.InputType.BinaryFile, streaming=True)
    win = w.TumblingEventTimeWindow(w.Time.seconds(10), "ms").with_trigger(w.PurgingTrigger(w.ProcessingTimeTrigger(w.Time.seconds(1))))
    live = q.window(win).aggregate(w.Count()).to_output_buffer("every_second").execute(spark, checkpoint=str(tmp_path / "cp"))
    live.processAllAvailable()
    assert live.isActive and spark.table("every_second").count() == 1  # runs on, and has let go of the first window
    live.stop()
    ended = q.window(win).aggregate(w.Count()).to_output_buffer("once").execute(spark, checkpoint=str(tmp_path / "cp2"), available_now=True)
    assert ended.awaitTermination(60)


def test_waiting_rows_are_stored_as_arrow():
    import pandas as pd

    from weir.streaming.countwin import _bytes, _frame

    frame = pd.DataFrame({"k": [1, 2], "s": ["a", None], "t": pd.to_datetime(["2024-01-01", None]), "d": [0.5, float("nan")]})
    pd.testing.assert_frame_equal(_frame(_bytes(frame)), frame)


def test_processing_time_stream(spark, tmp_path):
    q = source(spark, tmp_path, [(1, 1, 1)]).input(w.InputType.BinaryFile, streaming=True)
    df = q.window(w.TumblingProcessingTimeWindow(w.Time.seconds(10))).aggregate(w.Count()).to_df(spark)
    assert df.isStreaming and df.columns == ["window_start", "window_end", "count"]


@pytest.mark.parametrize("keyed", [True, False])
def test_count_windows_count_in_order_over_many_ranges_of_many_files(spark, tmp_path, keyed):
    """Rows 0 to 5999 in three files, read by ranges of 50 rows: window i has the rows from 10 i on."""
    base = w.Query.generate(w.Config().with_run_length(1000), SCHEMA, str(tmp_path / "in"))
    rows = spark.range(0, 6000, 1, 3).selectExpr("id % 2 as k", "id as v", "id as ms")
    binary.write(rows, base.path, SCHEMA)
    q = base.input(w.InputType.BinaryFile, streaming=True, range_bytes=50 * SCHEMA.record_size())
    q = (q.key_by("k") if keyed else q).window(w.CountWindow(10)).aggregate(w.Min("v"), w.Max("v"), w.Count()).write(str(tmp_path / "out"))
    q.execute(spark, checkpoint=str(tmp_path / "cp")).awaitTermination(60)
    got = sorted(map(tuple, spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(str(tmp_path / "out")).collect()))
    if keyed:
        assert got == [(k, i, 20 * i + k, 20 * i + 18 + k, 10) for k in range(2) for i in range(300)]
    else:
        assert got == [(i, 10 * i, 10 * i + 9, 10) for i in range(600)]


def test_rows_of_count_windows_are_in_order_over_many_ranges(spark, tmp_path):
    base = w.Query.generate(w.Config().with_run_length(1000), SCHEMA, str(tmp_path / "in"))
    rows = spark.range(0, 2000, 1, 2).selectExpr("1L as k", "id as v", "id as ms")
    binary.write(rows, base.path, SCHEMA)
    df = base.input(w.InputType.BinaryFile, streaming=True, range_bytes=50 * SCHEMA.record_size()).to_df(spark)
    live = stream_count_windows(df, 10, ["k"], [], ()).writeStream.format("memory").queryName("counted_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    live.awaitTermination(60)
    assert sorted((r.v, r.window_index) for r in spark.table("counted_rows").collect()) == [(i, i // 10) for i in range(2000)]


def test_a_streams_buffer_is_in_files_and_goes_on_from_its_checkpoint(spark, tmp_path):
    base = source(spark, tmp_path, [(i, i, i) for i in range(100)])
    q = base.input(w.InputType.BinaryFile, streaming=True).to_output_buffer("in_files")
    for more in (100, 200):
        q.execute(spark, checkpoint=str(tmp_path / "cp")).awaitTermination(60)
        assert sorted(r.k for r in spark.table("in_files").collect()) == list(range(more))
        plan = spark.table("in_files")._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "MemoryPlan" not in plan
        source(spark, tmp_path, [(i, i, i) for i in range(100, 200)])


def test_a_socket_is_sent_no_more_lines_than_its_stream_takes(spark, monkeypatch):
    """With 300 lines at a time the stream has all of them, in several batches."""
    from weir.plans import catalog_io

    monkeypatch.setattr(catalog_io, "LINES", 300)
    got = catalog_io.from_socket(spark, "/root/testdata/sf0.001")
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_type <> 'click'")
    assert sorted(r.value for r in got.collect()) == sorted(f"{r.event_id},{r.event_type}" for r in want.collect())
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) > 3


def test_packs_are_read_in_the_order_of_arrival_and_are_small():
    """What one task gets for windows over all rows: packs in any order, of far fewer bytes than their rows."""
    import numpy as np
    import pandas as pd

    from weir.streaming.packed import stored, unpacked

    rows = pd.DataFrame({"v0": np.arange(60000) % 100, "hv0": True})
    packs = [(i, stored(rows.iloc[i * 20000 : (i + 1) * 20000])) for i in (2, 0, 1)]
    got = pd.concat(list(unpacked(iter([pd.DataFrame([p], columns=["at", "rows"]) for p in packs]))), ignore_index=True)
    assert got.equals(rows) and sum(len(p) for _, p in packs) < 60000 * 9 / 4
