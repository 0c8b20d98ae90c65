"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Documents are judged once, each by all filters, and counted by mask (a bit for
each filter that it fails): at most 2^k cells a part, however many documents.
The cells go to long form, a row for each filter, and meet the steps of all
orders at which that filter stands.  A running bit-or over the steps of one
order tells which filters have failed a cell's documents earlier; conditional
sums give a step's figures, and a total over a filter's steps in all orders
its Shapley share (times the number of orders).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.llm.common import hot_join, rows_of, written

WORD = r"[^\x20\x09-\x0D]+"


def quality_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D on a text that is not null and its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of each row of ``docs``; bit 0 of the mask is filter A, bit 4 filter E.

    Filter E fails a text that a smaller doc_id has too, by its SHA-256: the
    texts themselves are read once and not shuffled, and a text that many
    documents share is joined where its rows are.  A null text is empty, a
    null lang the part ``''``; a row without a doc_id never fails E; repeated
    rows are documents of their own and no smaller than each other.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(quality_failures(F.col("t"), F.col("words")).values())]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    found = written(rows.select("doc_id", "part", mask.alias("own"), F.unhex(F.sha2("t", 256)).alias("digest")), "judged")
    shared = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = hot_join(found, written(shared, "shared"), "digest", rows_of(found), "left")
    again = F.when(F.col("first") < F.col("doc_id"), F.lit(16)).otherwise(F.lit(0))
    return found.select("doc_id", "part", F.col("own").bitwiseOR(again).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic`` from ``doc_id, part, mask``.

    A document is good (toxic) if any label row of its doc_id has quality 1
    (toxic 1); rows without a doc_id have no label.
    """
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.join(one, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def interactions(of_masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of ``letters`` and step, from :func:`cells`; an empty table has none.

    A part has a row for every step, zeros included, as each of its cells
    meets all steps.  Rows: parts x k! x k, whatever the documents.
    """
    spark = of_masks.sparkSession
    steps = [(c, "".join(order), k + 1) for order in permutations(letters) for k, c in enumerate(order)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter string, filter_order string, step int"))  # k! x k rows
    bit = lambda k: F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(1 << k)).otherwise(F.lit(0))
    unpivoted = F.explode(F.array(*(F.struct(F.lit(c).alias("filter"), F.lit(1 << k).alias("bit"), bit(k).alias("failed")) for k, c in enumerate(letters))))
    long_form = of_masks.select("*", unpivoted.alias("cell")).select("part", "mask", "n", "good", "toxic", "cell.*").join(steps, "filter")
    before = W.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long_form = long_form.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    here, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    found = long_form.groupBy("part", "filter_order", "step", "filter").agg(
        total(~here & ~gone).alias("kept"), total(here & ~gone).alias("removed"), total(here & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & ~gone, "good").alias("good_lost"), total(here & ~gone, "toxic").alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, filter`` and the step's figures; other columns of either table are not read."""
    return interactions(cells(judged(docs), labels))
