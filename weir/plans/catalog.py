"""Registered queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import weir as w
from weir.plans.schema import DataType, Field

BIDS_SQL = (
    "(select event_id, user_id as auction, event_id % 100 as bidder, "
    "cast(round(value * 100) as bigint) as price, ts, event_type from events)"
)
CENTS_SQL = "(select c_custkey, c_nationkey, cast(round(c_acctbal * 100) as bigint) as bal from customer)"
LINES = "l_orderkey, l_linenumber, l_quantity"

Entry = tuple[Callable[[SparkSession, str], DataFrame], str]


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def bids(spark: SparkSession, d: str) -> DataFrame:
    return table("events")(spark, d).select(
        "event_id", F.col("user_id").alias("auction"), (F.col("event_id") % 100).alias("bidder"),
        F.round(F.col("value") * 100).cast("long").alias("price"), "ts", "event_type",
    )


def cents(spark: SparkSession, d: str) -> DataFrame:
    return table("customer")(spark, d).select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("bal"))


def over(source, build: Callable[[w.Query], w.Query], config: w.Config | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: build(w.Query.over(source(spark, d), config)).to_df(spark)


def f(name: str) -> Field:
    return Field(name, DataType.Long)


def _filters() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    kinds = [("eq", w.Equal, "="), ("ne", w.NotEqual, "<>"), ("gt", w.Greater, ">"), ("ge", w.GreaterEqual, ">="), ("lt", w.Less, "<"), ("le", w.LessEqual, "<=")]
    line_items = table("lineitem")
    for name, kind, op in kinds:
        out[f"filter_{name}_str"] = (over(table("events"), lambda q, kind=kind: q.filter(kind("event_type", "error")).select("event_id", "event_type")), f"select event_id, event_type from events where event_type {op} 'error'")
        out[f"filter_{name}_num"] = (over(line_items, lambda q, kind=kind: q.filter(kind("l_quantity", 25)).select("l_orderkey", "l_linenumber", "l_quantity")), f"select {LINES} from lineitem where l_quantity {op} 25")
    a, b, c = w.Greater("l_quantity", 25), w.Less("l_discount", 0.05), w.Equal("l_returnflag", "R")
    lines = lambda build, config=None: over(line_items, lambda q: build(q).select("l_orderkey", "l_linenumber", "l_quantity"), config)
    pick = f"select {LINES} from lineitem where "
    A, B, C = "l_quantity > 25", "l_discount < 0.05", "l_returnflag = 'R'"
    return out | {
        "filter_field_to_field": (over(bids, lambda q: q.filter(w.Greater("price", f("auction"))).select("event_id")), f"select event_id from {BIDS_SQL} where price > auction"),
        "filter_like_substring": (over(table("part"), lambda q: q.filter(w.Like("p_brand", "#1")).select("p_partkey", "p_brand")), "select p_partkey, p_brand from part where contains(p_brand, '#1')"),
        "filter_like_default_order": (lambda s, d: w.Query.over(bids(s, d)).filter(w.Like("event_type", "ic")).filter(w.Greater("price", 500)).select("event_id", "event_type").to_df(s), f"select event_id, event_type from {BIDS_SQL} where contains(event_type, 'ic') and price > 500"),
        "own_predicate": (over(bids, lambda q: q.filter(Even("auction", 3).And(w.Greater("price", 500))).select("event_id")), f"select event_id from {BIDS_SQL} where auction % 3 = 0 and price > 500"),
        "filter_and": (lines(lambda q: q.filter(a.And(b))), f"{pick}{A} and {B}"),
        "filter_or": (lines(lambda q: q.filter(a.Or(c))), f"{pick}{A} or {C}"),
        "filter_and_or_precedence": (lines(lambda q: q.filter(a.Or(c).And(b))), f"{pick}({A} and {B}) or {C}"),
        "filter_chain": (lines(lambda q: q.filter(a).filter(b).filter(c), w.Config().with_filter_opt(False)), f"{pick}{A} and {B} and {C}"),  # in the order written
        "filter_permutation": (lambda s, d: w.Query.over(line_items(s, d), w.Config().with_pipeline_permutation(4)).filter(a).filter(b).filter(c).select("l_orderkey", "l_linenumber", "l_quantity").to_df(s), f"{pick}{A} and {B} and {C}"),
        "adaptive_filter_same_result": (lambda s, d: w.Query.over(line_items(s, d)).filter(a).filter(b).filter(c).select("l_orderkey", "l_linenumber", "l_quantity").to_df(s), f"{pick}{A} and {B} and {C}"),
        "filter_after_aggregate": (over(bids, lambda q: q.group_by("auction").aggregate(w.Count()).filter(w.Greater("count", 60))), f"select * from (select auction, count(*) as count from {BIDS_SQL} group by auction) where count > 60"),
    }


class Capped(w.Mapper):
    """A user's own mapper: the lesser of a field and a value."""

    symbol = "capped at"

    def apply(self, left, right, integral):
        return F.least(left, right)


class Range(w.Aggregation):
    """A user's own aggregation: the largest less the smallest."""

    def columns(self, df):
        return [(F.max(self.field) - F.min(self.field)).alias(f"{self.field}_range")]


class Even(w.Predicate):
    """A user's own predicate: divisible by ``value``."""

    symbol = "divisible by"

    def compare(self, left, right):
        return left % right == 0


def _maps() -> dict[str, Entry]:
    ids = lambda q, *more: q.select("event_id", *more)
    sql = lambda e: f"select event_id, {e} as price from {BIDS_SQL}"
    return {
        "select_fields": (over(table("orders"), lambda q: q.select(["o_totalprice", "o_orderkey"])), "select o_totalprice, o_orderkey from orders"),
        "map_add_lit": (over(bids, lambda q: ids(q.map(w.Add("price", 7)), "price")), sql("price + 7")),
        "map_add_field": (over(bids, lambda q: ids(q.map(w.Add("price", f("bidder"))), "price")), sql("price + bidder")),
        "map_subtract_lit": (over(bids, lambda q: ids(q.map(w.Subtract("price", 700)), "price")), sql("price - 700")),
        "map_subtract_field": (over(bids, lambda q: ids(q.map(w.Subtract("price", f("bidder"))), "price")), sql("price - bidder")),
        "map_divide_lit": (over(bids, lambda q: ids(q.map(w.Subtract("price", 700)).map(w.Divide("price", 9)), "price")), sql("(price - 700) // 9")),
        "map_divide_field": (over(bids, lambda q: ids(q.filter(w.Greater("bidder", 0)).map(w.Divide("price", f("bidder"))), "price")), f"select event_id, price // bidder as price from {BIDS_SQL} where bidder > 0"),
        "map_divide_double": (over(table("lineitem"), lambda q: q.map(w.Divide("l_quantity", 4)).select("l_orderkey", "l_linenumber", "l_quantity")), "select l_orderkey, l_linenumber, l_quantity / 4 as l_quantity from lineitem"),
        "map_concat_lit": (over(bids, lambda q: ids(q.map(w.Concat("event_type", "-x")), "event_type")), f"select event_id, event_type || '-x' as event_type from {BIDS_SQL}"),
        "map_concat_field": (over(table("part"), lambda q: q.map(w.Concat("p_brand", Field("p_type", DataType.String), "both")).select("p_partkey", "both")), "select p_partkey, p_brand || p_type as both from part"),
        "own_mapper": (over(bids, lambda q: ids(q.map(Capped("price", 900)), "price")), sql("least(price, 900)")),
        "own_aggregation": (over(bids, lambda q: q.group_by("auction").aggregate(Range("price"))), f"select auction, max(price) - min(price) as price_range from {BIDS_SQL} group by auction"),
        "map_output_field": (over(bids, lambda q: ids(q.map(w.Add("price", 7, "more")), "price", "more")), f"select event_id, price, price + 7 as more from {BIDS_SQL}"),
    }


AGGREGATES = {
    "sum": (w.Sum("price"), "cast(sum(price) as bigint) as price_sum"),
    "count": (w.Count(), "count(*) as count"),
    "min": (w.Min("price"), "min(price) as price_min"),
    "max": (w.Max("price"), "max(price) as price_max"),
    "avg": (w.Avg("price"), "avg(price) as price_avg, cast(sum(price) as bigint) as price_sum, count(*) as count"),
}


def _aggregates() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for name, (agg, sql) in AGGREGATES.items():
        out[f"agg_{name}"] = (over(bids, lambda q, agg=agg: q.group_by("auction").aggregate(agg)), f"select auction, {sql} from {BIDS_SQL} group by auction")
        out[f"agg_global_{name}"] = (over(bids, lambda q, agg=agg: q.aggregate(agg)), f"select {sql} from {BIDS_SQL}")
    out["agg_several"] = (over(bids, lambda q: q.group_by("auction", "event_type").aggregate(w.Avg("price"), w.Min("price"), w.Max("price"), w.Count())), f"select auction, event_type, {AGGREGATES['avg'][1]}, min(price) as price_min, max(price) as price_max from {BIDS_SQL} group by auction, event_type")
    out["agg_min_negative"] = (over(cents, lambda q: q.group_by("c_nationkey").aggregate(w.Min("bal"))), f"select c_nationkey, min(bal) as bal_min from {CENTS_SQL} group by c_nationkey")
    out["agg_max_negative"] = (over(cents, lambda q: q.filter(w.Less("bal", 0)).group_by("c_nationkey").aggregate(w.Max("bal"))), f"select c_nationkey, max(bal) as bal_max from {CENTS_SQL} where bal < 0 group by c_nationkey")
    out["agg_sum_double"] = (over(table("lineitem"), lambda q: q.group_by("l_returnflag").aggregate(w.Sum("l_quantity"))), "select l_returnflag, sum(l_quantity) as l_quantity_sum from lineitem group by l_returnflag")
    return out


def bucket(size: str) -> str:
    """Buckets aligned to the epoch, as Spark's are."""
    return f"time_bucket(interval '{size}', ts, timestamp '1970-01-01')"


def kept_apart(key: str, gap: str, sql: str) -> str:
    """Sessions of each key, or of all rows."""
    part, first = (f"partition by {key}", f"{key}, ") if key else ("", "")
    return f"""select {first}min(ts) as window_start, max(ts) + interval '{gap}' as window_end, {sql} from (
        select *, sum(new) over ({part} order by ts, event_id rows unbounded preceding) as s from (
            select *, case when ts - lag(ts) over ({part} order by ts, event_id) <= interval '{gap}' then 0 else 1 end as new from {BIDS_SQL}))
        group by {first}s"""


def _windows() -> dict[str, Entry]:
    day = w.TumblingEventTimeWindow(w.Time.minutes(1440), "ts")
    tumble = lambda size, sql, keys="auction, ", where="": f"select {keys}{bucket(size)} as window_start, {bucket(size)} + interval '{size}' as window_end, {sql} from {BIDS_SQL} {where} group by all"
    slides = f"(select *, unnest([{bucket('5 minutes')}, {bucket('5 minutes')} - interval '5 minutes']) as window_start from {BIDS_SQL})"
    slide = lambda sql: f"select auction, window_start, window_start + interval '10 minutes' as window_end, {sql} from {slides} group by auction, window_start"
    session = f"""select auction, min(ts) as window_start, max(ts) + interval '30 minutes' as window_end, count(*) as count from (
        select *, sum(new) over (partition by auction order by ts, event_id rows unbounded preceding) as s from (
            select *, case when ts - lag(ts) over (partition by auction order by ts, event_id) <= interval '30 minutes' then 0 else 1 end as new from {BIDS_SQL}))
        group by auction, s"""
    out: dict[str, Entry] = {}
    for name, (agg, sql) in AGGREGATES.items():
        out[f"win_tumble_{name}"] = (over(bids, lambda q, agg=agg: q.group_by("auction").window(day).aggregate(agg)), tumble("1 day", sql))
    sliding = w.SlidingProcessingTimeWindow(w.Time.minutes(10), w.Time.minutes(5), on="ts")
    sessions = w.SessionEventTimeWindow(w.Time.minutes(30), "ts")
    counted = lambda size: w.TumblingProcessingTimeWindow(w.Counter(size), on="event_id")
    numbered = lambda part: f"(select *, (row_number() over ({part}order by event_id) - 1) as rn from {BIDS_SQL})"
    return out | {
        "flagship_filter_group_tumble_avg": (over(bids, flagship(50)), tumble("10 seconds", AGGREGATES["avg"][1], where="where auction >= 50")),
        "win_tumble_processing_time": (over(bids, lambda q: q.group_by("auction").window(w.TumblingProcessingTimeWindow(w.Time.minutes(60), on="ts")).aggregate(w.Count())), tumble("1 hour", "count(*) as count")),
        "win_tumble_global": (over(bids, lambda q: q.window(w.TumblingEventTimeWindow(w.Time.minutes(60), "ts")).aggregate(w.Avg("price"))), tumble("1 hour", AGGREGATES["avg"][1], "")),
        "win_tumble_no_bounds": (over(bids, lambda q: q.group_by("auction").window(day).aggregate(w.Sum("price"), include_bounds=False)), f"select auction, price_sum from ({tumble('1 day', AGGREGATES['sum'][1])})"),
        "win_slide_sum": (over(bids, lambda q: q.group_by("auction").window(sliding).aggregate(w.Sum("price"))), slide(AGGREGATES["sum"][1])),
        "win_slide_avg": (over(bids, lambda q: q.group_by("auction").window(sliding).aggregate(w.Avg("price"))), slide(AGGREGATES["avg"][1])),
        "win_slide_panes": (
            over(bids, lambda q: q.group_by("event_type").window(w.SlidingEventTimeWindow(w.Time.minutes(720), w.Time.minutes(1), "ts")).aggregate(w.Avg("price"), w.Min("price"), w.Max("auction"))),
            f"""select event_type, window_start, window_start + interval '12 hours' as window_end, {AGGREGATES['avg'][1]}, min(price) as price_min, max(auction) as auction_max
            from (select *, {bucket('1 minute')} - to_minutes(cast(i as integer)) as window_start from {BIDS_SQL}, range(720) t(i)) group by event_type, window_start""",
        ),
        "win_session_count": (over(bids, lambda q: q.group_by("auction").window(sessions).aggregate(w.Count())), session),
        "win_session_hot_keys": (
            over(bids, lambda q: q.group_by("event_type").window(w.SessionEventTimeWindow(w.Time.minutes(20), "ts")).aggregate(w.Avg("price"), w.Max("auction")), w.Config().with_distribution_opt(True)),
            kept_apart("event_type", "20 minutes", f"{AGGREGATES['avg'][1]}, max(auction) as auction_max"),
        ),
        "win_session_global": (over(bids, lambda q: q.window(w.SessionEventTimeWindow(w.Time.minutes(10), "ts")).aggregate(w.Count())), kept_apart("", "10 minutes", "count(*) as count")),
        "win_session_processing_time": (over(bids, lambda q: q.group_by("auction").window(w.SessionProcessingTimeWindow(w.Time.minutes(30), on="ts")).aggregate(w.Count())), session),
        # the wall clock is one instant of a batch: one window, or session, of each key
        "win_tumble_wall_clock": (over(bids, lambda q: q.group_by("auction").window(w.TumblingProcessingTimeWindow(w.Time.minutes(60))).aggregate(w.Count(), include_bounds=False)), f"select auction, count(*) as count from {BIDS_SQL} group by auction"),
        "win_session_wall_clock": (over(bids, lambda q: q.group_by("auction").window(w.SessionProcessingTimeWindow(w.Time.minutes(30))).aggregate(w.Sum("price"), include_bounds=False)), f"select auction, {AGGREGATES['sum'][1]} from {BIDS_SQL} group by auction"),
        "countwin_by_trigger": (
            over(bids, lambda q: q.key_by("auction").window(w.TumblingProcessingTimeWindow(w.Time.minutes(1), on="event_id").with_trigger(w.PurgingTrigger(w.CountTrigger(10)))).aggregate(w.Max("price"), w.Count())),
            f"select auction, rn // 10 as window_index, max(price) as price_max, count(*) as count from {numbered('partition by auction ')} group by all having count(*) = 10",
        ),
        "countwin_by_string": (
            over(table("customer"), lambda q: q.window(w.TumblingProcessingTimeWindow(w.Counter(25), on="c_name")).aggregate(w.Count(), w.Min("c_custkey"))),
            "select rn // 25 as window_index, count(*) as count, min(c_custkey) as c_custkey_min from (select *, row_number() over (order by c_name) - 1 as rn from customer) group by all having count(*) = 25",
        ),
        "countwin_global": (over(bids, lambda q: q.window(counted(100)).aggregate(w.Sum("price"), w.Count())), f"select rn // 100 as window_index, {AGGREGATES['sum'][1]}, count(*) as count from {numbered('')} group by all having count(*) = 100"),
        "countwin_keyed": (over(bids, lambda q: q.key_by("auction").window(counted(10)).aggregate(w.Avg("price"))), f"select auction, rn // 10 as window_index, {AGGREGATES['avg'][1]} from {numbered('partition by auction ')} group by all having count(*) = 10"),
        "countwin_grouped": (over(bids, lambda q: q.group_by("event_type").window(counted(100)).aggregate(w.Count())), f"select event_type, rn // 100 as window_index, count(*) as count from {numbered('')} where rn // 100 < (select count(*) // 100 from events) group by all"),
    }


def flagship(least: int) -> Callable[[w.Query], w.Query]:
    size = w.TumblingEventTimeWindow(w.Time.seconds(10), "ts")
    return lambda q: q.filter(w.GreaterEqual("auction", least)).group_by("auction").window(size).aggregate(w.Avg("price"))


def entries() -> dict[str, Entry]:
    return _filters() | _maps() | _aggregates() | _windows()
