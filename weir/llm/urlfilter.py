"""URL filtering against lists that change: dated entries, evaluated as of each capture's fetch time.

A list is a log of entries, each of which puts a domain on it or takes it off
from a time on.  The log becomes validity intervals; a capture is judged by
the entries of its host and of every parent domain that are active when it was
fetched.  The most specific active domain wins, then the longest listed, then
the first category by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.llm.common import rows_of, written

#: Parts into which the hosts of a hot domain are dealt, and stretches of time into which the intervals of a long-listed one are cut.
SALTS, STRETCHES = 64, 256
#: Intervals of a domain up to which each is compared with each fetch time.
FEW = 16

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; null if it has none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def intervals(log: DataFrame) -> DataFrame:
    """``domain, category, since, until`` from ``domain, category, at, listed``.

    Of entries of one domain, category and time, an addition wins.  An
    addition to what is listed, or a removal of what is not, changes nothing.
    Entries with a null domain, category, time or flag take no part.
    """
    log = log.filter("domain is not null and category is not null and at is not null and listed is not null")
    log = log.groupBy(F.lower("domain").alias("domain"), "category", "at").agg(F.max("listed").alias("listed"))
    order = W.partitionBy("domain", "category").orderBy("at")
    changes = log.withColumn("before", F.coalesce(F.lag("listed").over(order), F.lit(False))).filter("listed <> before")
    spans = changes.withColumn("until", F.lead("at").over(order)).filter("listed")
    return spans.select("domain", "category", F.col("at").alias("since"), "until")


def parents(host: Column) -> Column:
    """The host and its parent domains of at least two labels (a single label stands alone)."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(captures: DataFrame, log: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Each row of ``captures`` (``url``, ``fetched_at``) with its verdict.

    Adds ``host``, ``blocked``, ``category``, ``matched`` and ``since``.  A
    row without a host or a fetch time is not blocked.  Repeated rows stay;
    only the id, ``url`` and ``fetched_at`` are kept.

    The as-of join meets each host and parent domain with the intervals of
    that domain.  Hosts are judged once for each fetch time.  A domain above a
    large share of them is dealt out by host and time, and one with a large
    share of the intervals by stretches of time, so neither is one task's.
    """
    rows = captures.select(id_column, "url", "fetched_at").withColumn("host", host_of(F.col("url")))
    asked = rows.filter("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    asked = written(asked.withColumn("domain", F.explode(parents(F.col("host")))), "asked")
    spans = written(intervals(log), "intervals")
    active = _as_of(asked, spans)
    best = F.min(F.struct((-F.length("domain")).alias("rank"), "since", "category", "domain")).alias("best")
    verdicts = active.groupBy("host", "fetched_at").agg(best)
    verdicts = verdicts.select(F.col("host").alias("h"), F.col("fetched_at").alias("t"), "best")
    out = rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("fetched_at") == F.col("t")), "left")
    return out.select(
        id_column, "url", "host", "fetched_at", F.col("best").isNotNull().alias("blocked"), F.col("best.category").alias("category"),
        F.col("best.domain").alias("matched"), F.col("best.since").alias("since"),
    )


def _day(at: Column | str) -> Column:
    return F.unix_date(F.col(at).cast("date") if isinstance(at, str) else at.cast("date"))


def _as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """``asked(host, fetched_at, domain)`` with each interval of the domain that is active then."""
    n_asked, n_spans = rows_of(asked), rows_of(spans)
    first, last = asked.agg(F.min(_day("fetched_at")), F.max(_day("fetched_at"))).first()
    if first is None:
        first = last = 0
    # at most a thousand domains have over a thousandth of the rows, on either side
    crowded = asked.groupBy("domain").count().filter(F.col("count") * 1000 > n_asked).select("domain", F.lit(SALTS).alias("salts"))
    listed = spans.groupBy("domain").count().filter((F.col("count") * 1000 > n_spans) & (F.col("count") > FEW)).select("domain", F.lit(STRETCHES).alias("stretches"))
    cut = lambda df: df.join(F.broadcast(crowded), "domain", "left").join(F.broadcast(listed), "domain", "left").fillna(1, ["salts", "stretches"])
    stretch = lambda day: F.floor((day - first) * F.col("stretches") / (last - first + 1)).cast("int")
    left = cut(asked).withColumn("salt", F.pmod(F.xxhash64("host", "fetched_at"), "salts").cast("int")).withColumn("stretch", stretch(_day("fetched_at")))
    until = F.coalesce(_day("until"), F.lit(last))
    right = cut(spans.filter((_day("since") <= last) & (until >= first)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = right.withColumn("stretch", F.explode(F.sequence(stretch(F.greatest(_day("since"), F.lit(first))), stretch(F.least(until, F.lit(last))))))
    met = left.drop("salts", "stretches").join(right.drop("salts", "stretches"), ["domain", "salt", "stretch"])
    return met.filter("since <= fetched_at and (until is null or fetched_at < until)")
