"""Registered queries that go through the sources, the sinks and streams, each with its DuckDB twin.

Each writes its input to a new path in the shared folder, by Spark, and reads
it back the way a user would.
"""

from __future__ import annotations

import io
import socket
import threading
import uuid
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession, functions as F

import weir as w
from weir.plans.catalog import BIDS_SQL, Entry, bids, over
from weir.plans.shared import new_path
from weir.sources import binary, generator
from weir.streaming.countwin import ROCKSDB

COLUMNS = ["auction", "bidder", "price", "dateTime"]
RECORDS_SQL = f"(select auction, bidder, price, epoch_us(ts) // 1000 as dateTime from {BIDS_SQL})"
#: Milliseconds since the epoch of a timestamp without zone, whatever the session's zone.
MILLIS = "unix_date(cast(ts as date)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(second from ts) * 1000) as bigint)"
#: Files of a micro-batch: all, so that no row is late and results can be compared.
ALL_FILES = 1_000_000
#: Lines that a socket's server sends before it looks how many the stream has taken; the source's time for a batch grows with their square.
LINES = 50_000


def records(spark: SparkSession, d: str) -> DataFrame:
    """The bid stream's own record: four integers, time in milliseconds."""
    return bids(spark, d).select("auction", "bidder", "price", F.expr(MILLIS).alias("dateTime"))


def stored(spark: SparkSession, d: str, kind: w.InputType) -> str:
    path = new_path(spark, f"bids-{kind.name.lower()}")
    if kind is w.InputType.BinaryFile:
        binary.write(records(spark, d), path, generator.BID_SCHEMA)
    else:
        records(spark, d).write.format(kind.value).save(path)
    return path


def from_files(kind: w.InputType):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = w.Query.generate(w.Config(), generator.BID_SCHEMA, stored(spark, d, kind), kind)
        return q.filter(w.Greater("price", 5000)).select(COLUMNS).to_df(spark)

    return run


def from_memory(spark: SparkSession, d: str) -> DataFrame:
    """The few rows of a table that a program has at hand."""
    rows = [(r.r_name[:1], r.r_regionkey) for r in spark.read.parquet(f"{d}/region.parquet").collect()]
    schema = w.Schema.create().add_fix_size_field("k", w.DataType.String).add_fix_size_field("v", w.DataType.Long)
    q = w.Query(schema=schema).input(w.InputType.Memory, rows=rows)
    return q.group_by("k").aggregate(w.Sum("v"), w.Count()).to_df(spark)


def generated(exponent: float | None, streaming: bool = False):
    """A bid for every event, drawn by its number; as a batch, or of the table as a stream."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        make = lambda events: generator.bids_for(events.select("event_id"), "event_id", 100, 1000, exponent=exponent).select("auction", "bidder", "price", "dateTime")
        events = spark.read.parquet(f"{d}/events.parquet").select("event_id")
        if not streaming:
            return make(events)
        path, out = new_path(spark, "numbers"), new_path(spark, "drawn")
        events.write.parquet(path)
        q = w.Query.over(make(spark.readStream.schema(events.schema).parquet(path))).write(out)
        q.execute(spark, checkpoint=new_path(spark, "progress")).awaitTermination()
        return spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(out)

    return run


def delimited(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "delimited")
    w.Query.over(bids(spark, d)).group_by("auction").aggregate(w.Sum("price"), w.Count()).write(path).execute(spark)
    return spark.read.schema("value string").text(path)


def printed(spark: SparkSession, d: str) -> DataFrame:
    """What the print sink writes on the driver, a line for each of a few groups."""
    lines = io.StringIO()
    with redirect_stdout(lines):
        w.Query.over(bids(spark, d)).group_by("event_type").aggregate(w.Sum("price"), w.Count()).print().execute(spark)
    return spark.createDataFrame([(x,) for x in lines.getvalue().splitlines()], "value string")


def plan_text(spark: SparkSession, d: str) -> DataFrame:
    """The plan and the orders of its filters as text, and the rows that each order lets through, which are as many (0 beside the plan)."""
    q = w.Query.over(bids(spark, d)).filter(w.Greater("price", 5)).filter(w.Less("bidder", 9)).group_by("auction").aggregate(w.Count()).print()
    with redirect_stdout(io.StringIO()):
        plan, orders = q.print_query_plan().splitlines(), q.print_pipeline_permutations().splitlines()
    passed = [over(bids, lambda q: q.filter(w.Greater("price", 5)).filter(w.Less("bidder", 9)), w.Config().with_pipeline_permutation(k))(spark, d).count() for k in range(len(orders))]
    return spark.createDataFrame(list(enumerate(zip(plan + orders, [0] * len(plan) + passed, strict=True))), "line int, at struct<value: string, passed: long>").select("line", "at.*")


def from_socket(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a server on the driver sends, a line for each event, as a stream."""
    name, server = f"lines_{uuid.uuid4().hex}", socket.create_server(("127.0.0.1", 0))
    events = spark.read.parquet(f"{d}/events.parquet")
    lines, n = events.select(F.concat_ws(",", F.col("event_id").cast("string"), "event_type").alias("value")), events.count()

    def taken() -> int:
        """Lines that the stream has read and written: its offset in the socket."""
        report = running[0].lastProgress if running else None
        return int(report["sources"][0]["endOffset"] or -1) + 1 if report else 0

    def serve() -> None:  # a socket's source holds all lines that have come and are not taken yet, so it is given so many at most
        link, _ = server.accept()
        held: list[str] = []
        for sent, row in enumerate(lines.toLocalIterator()):
            if len(held) == LINES:
                link.sendall("".join(held).encode())
                held.clear()
                while taken() < sent - LINES:
                    if done.wait(0.1):
                        return link.close()
            held.append(f"{row.value}\n")
        link.sendall("".join(held).encode())
        done.wait()
        link.close()

    running: list = []
    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    q = w.Query(path=None).input(w.InputType.Socket, streaming=True, host="127.0.0.1", port=server.getsockname()[1])
    kept = w.Query.over(q.to_df(spark).select("value", F.substring_index("value", ",", -1).alias("kind"))).filter(w.NotEqual("kind", "click"))
    live = kept.to_output_buffer(name).execute(spark, checkpoint=new_path(spark, "progress"), available_now=False)
    running.append(live)
    try:
        while taken() < n:
            live.processAllAvailable()
            done.wait(0.1)
    finally:
        live.stop()
        done.set()
        server.close()
    return spark.table(name)


def buffered(spark: SparkSession, d: str) -> DataFrame:
    name = f"buffer_{uuid.uuid4().hex}"
    w.Query.over(bids(spark, d)).group_by("auction").aggregate(w.Count()).to_output_buffer(name).execute(spark)
    return spark.table(name)


def streamed(build):
    """The records as a stream of binary files, into delimited files; window bounds as milliseconds."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        source = w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, stored(spark, d, w.InputType.BinaryFile))
        out = new_path(spark, "streamed")
        live = build(source.input(w.InputType.BinaryFile, streaming=True)).write(out)
        kinds = live.to_df(spark).schema
        live.execute(spark, checkpoint=new_path(spark, "progress")).awaitTermination()
        rows = spark.read.schema(kinds).option("sep", ";").csv(out)
        return rows.select(*(F.unix_millis(c).alias(c) if c.startswith("window_") else c for c in rows.columns))

    return run


def by_trigger(spark: SparkSession, d: str) -> DataFrame:
    """A stream that runs on, a batch each second by its window's trigger, stopped once all is read."""
    source = w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, stored(spark, d, w.InputType.BinaryFile))
    window = w.TumblingEventTimeWindow(w.Time.seconds(10), "dateTime").with_trigger(w.PurgingTrigger(w.ProcessingTimeTrigger(w.Time.seconds(1))))
    q = source.input(w.InputType.BinaryFile, streaming=True).group_by("auction").window(window).aggregate(w.Avg("price"))
    outs = [new_path(spark, "triggered"), new_path(spark, "triggered")]
    live = q.write(outs[0]).write(outs[1]).execute(spark, checkpoint=new_path(spark, "progress"))
    live.processAllAvailable()
    live.stop()
    read = [spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(out) for out in outs]
    both = [df.select(F.lit(k).alias("sink"), *(F.unix_millis(c).alias(c) if c.startswith("window_") else c for c in df.columns)) for k, df in enumerate(read)]
    return both[0].unionByName(both[1])


def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the records first, then the others: these are behind the watermark and count nowhere."""
    rows, path, out = records(spark, d), new_path(spark, "bids-late"), new_path(spark, "late")
    middle = rows.agg(F.expr("(min(dateTime) + max(dateTime)) div 2")).first()[0]
    progress = new_path(spark, "progress")
    q = w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, path).input(w.InputType.BinaryFile, streaming=True)
    q = q.group_by("auction").window(w.TumblingEventTimeWindow(w.Time.seconds(10), "dateTime")).aggregate(w.Count()).write(out)
    for half in (F.col("dateTime") >= middle, F.col("dateTime") < middle):
        binary.write(rows.filter(half), path, generator.BID_SCHEMA)
        q.execute(spark, checkpoint=progress).awaitTermination()
    read = spark.read.schema(q.to_df(spark).schema).option("sep", ";").csv(out)
    return read.select("auction", F.unix_millis("window_start").alias("window_start"), F.unix_millis("window_end").alias("window_end"), "count")


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """The log of a stream's input: all rows that it read, before its filter, and whether each batch had a rate."""
    seen: list[tuple[int, float]] = []
    source = w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, stored(spark, d, w.InputType.BinaryFile)).input(w.InputType.BinaryFile, streaming=True)
    q = source.filter(w.Greater("price", 5000)).select(COLUMNS).write(new_path(spark, "logged"))
    q.execute(spark, checkpoint=new_path(spark, "progress"), throughput_log=lambda rows, seconds: seen.append((rows, seconds))).awaitTermination()
    for _ in range(200):  # reports come after the query's end
        if seen:
            break
        threading.Event().wait(0.1)
    return spark.createDataFrame([(sum(n for n, _ in seen), all(s > 0 for _, s in seen))], "rows long, rated boolean")


def streamed_count_windows(build):
    """Count windows of the records as they arrive: from files in the order of the events, ``dateTime`` being their number."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path, out = new_path(spark, "bids-ordered"), new_path(spark, "counted")
        binary.write(bids(spark, d).repartitionByRange("event_id").sortWithinPartitions("event_id").select("auction", "bidder", "price", F.col("event_id").alias("dateTime")), path, generator.BID_SCHEMA)
        own = spark.newSession()  # the state store is a setting of this query alone
        own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        source = w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, path).input(w.InputType.BinaryFile, streaming=True)
        q = build(source).write(out)
        q.execute(own, checkpoint=new_path(spark, "progress")).awaitTermination()
        return spark.read.schema(q.to_df(own).schema).option("sep", ";").csv(out)

    return run


def refired(build, late: bool = False):
    """The records in the order of the events, by micro-batches: with ``late``, every tenth of them only after all others."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path, out, progress = new_path(spark, "bids-ordered"), new_path(spark, "fired"), new_path(spark, "progress")
        own = spark.newSession()  # the state store is a setting of this query alone
        own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        q = build(w.Query.generate(w.Config().with_run_length(ALL_FILES), generator.BID_SCHEMA, path).input(w.InputType.BinaryFile, streaming=True)).write(out)
        rows = bids(spark, d).select("event_id", "auction", "bidder", "price", F.expr(MILLIS).alias("dateTime"))
        behind = F.col("event_id") % 10 == 0
        for part in (rows.filter(~behind), rows.filter(behind)) if late else (rows,):
            binary.write(part.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id"), path, generator.BID_SCHEMA)
            q.execute(own, checkpoint=progress).awaitTermination()
        read = spark.read.schema(q.to_df(own).schema).option("sep", ";").csv(out)
        return read.select(*(F.unix_millis(c).alias(c) if c.startswith("window_") else c for c in read.columns))

    return run


def entries() -> dict[str, Entry]:
    kinds = (w.InputType.BinaryFile, w.InputType.CSVFile, w.InputType.JSON, w.InputType.ORC, w.InputType.Parquet)
    picked = f"select * from {RECORDS_SQL} where price > 5000"
    out: dict[str, Entry] = {f"source_{k.name.lower().removesuffix('file')}": (from_files(k), picked) for k in kinds}
    bits = lambda k: f"cast('0x' || substr(md5('42:{k}:' || event_id), 1, 12) as bigint)"
    even = lambda k, n: f"(({bits(k)} >> 16) * {n}) >> 32"
    made = f"select {even(0, 1000)} as auction, {even(1, 100)} as bidder, {even(2, 100)} as price, event_id as \"dateTime\" from events"
    law = "(select k, coalesce(lag(c) over (order by k), 0) / max(c) over () as at from (select k, sum(pow(k + 1, -1.2)) over (order by k) as c from range(1000) t(k)))"
    skewed = f"""select l.k as auction, bidder, price, "dateTime" from (select *, {bits(0)} / pow(2, 48) as u from ({made.replace(' from events', ', event_id from events')})) e
        asof join {law} l on e.u >= l.at"""
    grouped = f"(select auction, cast(sum(price) as bigint) as price_sum, count(*) as count from {BIDS_SQL} group by auction)"
    s = w.Time.seconds
    on = "dateTime"
    start = lambda ms: f"dateTime // {ms} * {ms}"
    seen = f"(select max(dateTime) from {RECORDS_SQL})"  # the watermark at the end: later windows stay open
    avg = "avg(price) as price_avg, cast(sum(price) as bigint) as price_sum, count(*) as count"
    tumbled = f"select auction, {start(10000)} as window_start, {start(10000)} + 10000 as window_end, {avg} from {RECORDS_SQL} where auction >= 50 group by all"
    slid = f"""select auction, window_start, window_start + 600000 as window_end, cast(sum(price) as bigint) as price_sum from (
        select *, unnest([{start(300000)}, {start(300000)} - 300000]) as window_start from {RECORDS_SQL}) group by auction, window_start"""
    sessions = f"""select auction, min(dateTime) as window_start, max(dateTime) + 1800000 as window_end, count(*) as count from (
        select *, sum(new) over (partition by auction order by dateTime, price, bidder rows unbounded preceding) as s from (
            select *, case when dateTime - lag(dateTime) over (partition by auction order by dateTime, price, bidder) <= 1800000 then 0 else 1 end as new from {RECORDS_SQL}))
        group by auction, s"""
    ordered = f"select *, (row_number() over (partition by auction, window_start order by event_id) - 1) as rn from (select *, epoch_us(ts) // 86400000000 * 86400000 as window_start from {BIDS_SQL})"
    halves = f"""select auction, bidder, price, epoch_us(ts) // 1000 as dateTime, epoch_us(ts) // 86400000000 * 86400000 as window_start, event_id % 10 = 0 as behind,
        max(case when event_id % 10 <> 0 then epoch_us(ts) // 1000 end) over () as mark from {BIDS_SQL}"""
    closed = lambda sql, least="": f"select * from ({sql}) where window_end <= {least or seen}"
    return out | {
        "source_memory": (from_memory, "select r_name[1] as k, sum(r_regionkey)::bigint as v_sum, count(*) as count from region group by all"),
        "source_generator": (generated(None), made),
        "source_generator_skewed": (generated(1.2), skewed),
        "stream_generator_skewed": (generated(1.2, streaming=True), skewed),
        "source_socket": (from_socket, "select event_id || ',' || event_type as value, event_type as kind from events where event_type <> 'click'"),
        "sink_delimited": (delimited, f"select auction || ';' || price_sum || ';' || count as value from {grouped}"),
        "sink_print": (printed, f"select event_type || ':' || cast(sum(price) as bigint) || '|' || count(*) || '|' as value from {BIDS_SQL} group by event_type"),
        "explain_plan_text": (
            plan_text,
            """select line, value, coalesce(passed, 0) as passed from (values (0, 'print()'), (1, '  aggregate(Count(), True)'), (2, '    group_by(auction)'), (3, '      filter(bidder < 9)'),
            (4, '        filter(price > 5)'), (5, '          source(DataFrame)'), (6, '0: price > 5 -> bidder < 9'), (7, '1: bidder < 9 -> price > 5')) as t(line, value)
            left join (select count(*) as passed from """ + BIDS_SQL + """ where price > 5 and bidder < 9) on line >= 6""",
        ),
        "stream_throughput_log": (throughput, "select count(*) as rows, true as rated from events"),
        "sink_buffer": (buffered, f"select auction, count from {grouped}"),
        "stream_filter_map": (
            streamed(lambda q: q.filter(w.Greater("price", 5000)).filter(w.Less("bidder", 50)).map(w.Add("price", 7)).select(COLUMNS)),
            f"select auction, bidder, price + 7 as price, dateTime from {RECORDS_SQL} where price > 5000 and bidder < 50",
        ),
        "stream_flagship": (
            streamed(lambda q: q.filter(w.GreaterEqual("auction", 50)).group_by("auction").window(w.TumblingEventTimeWindow(s(10), on)).aggregate(w.Avg("price"))),
            closed(tumbled, f"(select max(dateTime) from {RECORDS_SQL} where auction >= 50)"),
        ),
        "stream_slide_sum": (streamed(lambda q: q.group_by("auction").window(w.SlidingEventTimeWindow(s(600), s(300), on)).aggregate(w.Sum("price"))), closed(slid)),
        "stream_slide_panes": (
            streamed(lambda q: q.group_by("bidder").window(w.SlidingEventTimeWindow(s(7200), s(600), on)).aggregate(w.Avg("price"), w.Max("auction"))),
            closed(f"""select bidder, window_start, window_start + 7200000 as window_end, {avg}, max(auction) as auction_max from (
                select *, {start(600000)} - i * 600000 as window_start from {RECORDS_SQL}, range(12) t(i)) group by bidder, window_start"""),
        ),
        "stream_session_count": (streamed(lambda q: q.group_by("auction").window(w.SessionEventTimeWindow(s(1800), on)).aggregate(w.Count())), closed(sessions)),
        "stream_trigger_and_sinks": (by_trigger, f"select unnest([0, 1]) as sink, * from ({closed(tumbled.replace('where auction >= 50', ''))})"),
        "stream_late_rows": (
            late_rows,
            closed(f"""select auction, {start(10000)} as window_start, {start(10000)} + 10000 as window_end, count(*) as count from {RECORDS_SQL}
            where dateTime >= (select (min(dateTime) + max(dateTime)) // 2 from {RECORDS_SQL}) group by all"""),
        ),
        "stream_countwin_keyed": (
            streamed_count_windows(lambda q: q.key_by("auction").window(w.CountWindow(10)).aggregate(w.Sum("price"), w.Max("dateTime"), w.Count())),
            f"""select auction, rn // 10 as window_index, cast(sum(price) as bigint) as price_sum, max(event_id) as "dateTime_max", count(*) as count
            from (select *, row_number() over (partition by auction order by event_id) - 1 as rn from {BIDS_SQL}) group by all having count(*) = 10""",
        ),
        "stream_early_purging": (
            refired(lambda q: q.group_by("auction").window(w.TumblingEventTimeWindow(s(86400), on).with_early_firing(w.PurgingTrigger(w.CountTrigger(3)))).aggregate(w.Sum("price"), w.Count())),
            f"""select auction, window_start, window_start + 86400000 as window_end, rn // 3 as firing, cast(sum(price) as bigint) as price_sum, count(*) as count from ({ordered})
            group by all having count(*) = 3 or window_end <= {seen}""",
        ),
        "stream_early_accumulating": (
            refired(lambda q: q.group_by("auction").window(w.TumblingEventTimeWindow(s(86400), on).with_early_firing(w.CountTrigger(3))).aggregate(w.Sum("price"), w.Count())),
            f"""select auction, window_start, window_start + 86400000 as window_end, firing, cast(sum(sum(price)) over so_far as bigint) as price_sum, cast(sum(count(*)) over so_far as bigint) as count
            from (select *, rn // 3 as firing from ({ordered})) group by auction, window_start, firing
            window so_far as (partition by auction, window_start order by firing) qualify count % 3 = 0 or window_end <= {seen}""",
        ),
        "stream_allowed_lateness": (
            refired(lambda q: q.group_by("auction").window(w.TumblingEventTimeWindow(s(86400), on).with_allowed_lateness(s(864000))).aggregate(w.Sum("price"), w.Max("bidder"), w.Count()), late=True),
            f"""with r as ({halves}), ended as (select *, window_start + 86400000 as window_end from r where window_start + 86400000 <= greatest(mark, (select max(dateTime) from {RECORDS_SQL})))
            select auction, window_start, window_end, 0::bigint as firing, cast(sum(price) as bigint) as price_sum, max(bidder) as bidder_max, count(*) as count
            from ended where not behind or window_end > mark group by all
            union all select auction, window_start, window_end, case when bool_or(not behind) then 1 else 0 end::bigint, cast(sum(price) as bigint), max(bidder), count(*)
            from ended where window_end <= mark and window_end + 864000000 > mark group by auction, window_start, window_end having bool_or(behind)""",
        ),
        "stream_too_late_rows": (
            refired(lambda q: q.group_by("auction").window(w.TumblingEventTimeWindow(s(86400), on).with_allowed_lateness(s(864000))).late_rows(), late=True),
            f"""select auction, bidder, price, dateTime, window_start from ({halves}) where behind and window_start + 86400000 + 864000000 <= mark""",
        ),
        "stream_countwin_grouped": (
            streamed_count_windows(lambda q: q.group_by("bidder").window(w.CountWindow(250)).aggregate(w.Avg("price"), w.Min("dateTime"))),
            f"""select bidder, rn // 250 as window_index, avg(price) as price_avg, cast(sum(price) as bigint) as price_sum, count(*) as count, min(event_id) as "dateTime_min"
            from (select *, row_number() over (order by event_id) - 1 as rn from {BIDS_SQL}) where rn // 250 < (select count(*) // 250 from events) group by all""",
        ),
    }
