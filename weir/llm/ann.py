"""Nearest neighbours by inner product with cross-polytope hashing.

A table rotates unit vectors by rounds of random signs and fast Hadamard
transforms, and files each under its nearest signed axis.  A table of several
levels joins the axes of as many rotations to one key, so its cells are smaller.
A query looks into its nearest cells of each table; what it meets there is
ranked again by the exact inner product of the original vectors.  Equal vectors
are one entry that keeps its smallest ids: with the ties going to smaller ids,
no others can be among the nearest.

Tables, levels and probes are fitted to the table: for ``FIT_QUERIES`` queries
the true neighbours are found exactly, and of the plans that would have met
``FIT_RECALL`` of them the one that compares and moves least is taken.  As a
table grows neighbours get nearer, and fewer or smaller cells do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.llm.common import map_texts, rows_of, written

SEED = 42
#: Queries and entries that a plan is fitted to, and the share of their neighbours that it must meet.
FIT_QUERIES, FIT_ENTRIES, FIT_RECALL = 128, 2048, 0.95
#: Comparisons that cost as much as moving one row of a query.
MOVE = 100
#: Axes of one level that probes are made of, by the number of levels.
AXES = {2: 48, 3: 16}
#: Entries of a bucket that one task compares; larger buckets are split.
BUCKET_ROWS = 20_000
#: Replicated queries in one Arrow batch.
BATCH_ROWS = 1 << 15


class Plan(NamedTuple):
    """So many ``tables``, each of so many rotations (``levels``), and cells that a query looks into in each."""

    tables: int
    levels: int
    probes: int


#: Tried in turn: from few tables to many, one level to three, few probes to many.
PLANS = [
    Plan(t, n, p) for t in (8, 16) for n, probes in ((1, (4, 6, 8, 12, 16, 24, 32, 48)), (2, (16, 32, 64, 128, 256, 512)), (3, (64, 256, 1024))) for p in probes
]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of each row, not scaled; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation number ``table`` of each row, padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for signs in np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (3, width)):
        y = hadamard(y * signs)
    return y


def nearest_axes(x: np.ndarray, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest of the 2 * width signed axes of rotation ``number``, nearest first, and their products."""
    y = rotated(x, number)
    both = np.concatenate([y, -y], axis=1)
    if n == 1:
        top = both.argmax(1)[:, None]
        return top, np.take_along_axis(both, top, 1)
    n = min(n, both.shape[1])
    top = np.argpartition(-both, n - 1, axis=1)[:, :n]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
    return top, np.take_along_axis(both, top, 1)


def axes_of(width: int) -> int:
    """Signed axes of vectors of ``width`` components, padded to a power of two."""
    return 2 << max(1, (width - 1).bit_length())


def cells(x: np.ndarray, table: int, levels: int, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row in a table, nearest first; the first level is the highest digit of a cell."""
    axes = axes_of(x.shape[1])
    found, products = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for level in range(levels):
        top, own = nearest_axes(x, table + level * 64, 1 if n == 1 else n if levels == 1 else AXES[levels])
        found = (found[:, :, None] * axes + top[:, None, :]).reshape(len(x), -1)
        products = (products[:, :, None] + own[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-products, axis=1, kind="stable")[:, :n]
        found, products = np.take_along_axis(found, order, 1), np.take_along_axis(products, order, 1)
    return found


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows on the unit sphere so that nearness there is the order of inner products.

    Where lengths differ, an entry gets one more component (what its length
    lacks of the longest) and a query a zero.
    """
    length = np.linalg.norm(x, axis=1, keepdims=True)
    if longest <= 0:
        return x / length
    if query:
        return np.hstack([x / length, np.zeros((len(x), 1))])
    return np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))])


def usable(v: Column) -> Column:
    """Neither null nor empty, without null or non-finite components, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _true_neighbours(entries: DataFrame, asked: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """``number, entry, score``: the ``k`` nearest entries of each asked vector but its own, by comparing all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0))] * len(asked)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                entry, scores = part.column(0).to_numpy(), asked @ matrix(part.column(1)).T
                scores[names[:, None] == entry[None, :]] = -np.inf
                top = np.argpartition(-scores, min(k, len(entry)) - 1, axis=1)[:, :k]
                for i, own in enumerate(top):
                    e, v = np.concatenate([best[i][0], entry[own]]), np.concatenate([best[i][1], scores[i, own]])
                    order = np.lexsort((e, -v))[:k]
                    best[i] = e[order], v[order]
        for i, (e, v) in enumerate(best):
            e, v = e[np.isfinite(v)], v[np.isfinite(v)]
            yield pa.RecordBatch.from_pydict({"number": np.full(len(e), i, np.int32), "entry": e, "score": v})

    found = entries.select("entry", "embedding").mapInArrow(run, "number int, entry long, score double")
    order = W.partitionBy("number").orderBy(F.desc("score"), "entry")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _place(probes: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """At which probe each home cell is looked into; the number of probes, if at none."""
    order = np.argsort(probes, kind="stable")
    at = np.minimum(np.searchsorted(probes[order], homes), len(probes) - 1)
    return np.where(probes[order[at]] == homes, order[at], len(probes))


def fit(entries: DataFrame, k: int, longest: float) -> tuple[Plan, float]:
    """The cheapest of PLANS with FIT_RECALL or more on a sample, or the one of most recall; and its recall there.

    The sample is FIT_QUERIES asked entries and FIT_ENTRIES entries, by lowest
    hash; neighbours are true ones among all entries.
    """
    drawn = lambda rows, n: rows.orderBy(F.xxhash64("entry", F.lit(29)), "entry").limit(n).toArrow()
    asked = drawn(entries.filter("asked").select("entry", "embedding"), FIT_QUERIES)
    some = drawn(entries.select("entry", "embedding"), FIT_ENTRIES)
    if not asked.num_rows:
        return PLANS[0], 1.0
    queries, total = matrix(asked.column("embedding")), rows_of(entries)
    near = written(_true_neighbours(entries, queries, asked.column("entry").to_numpy(), k), "true")
    pairs = entries.select("entry", "embedding").join(F.broadcast(near), "entry").select("number", "embedding").toArrow()
    if not pairs.num_rows:
        return PLANS[0], 1.0
    pairs = pairs.sort_by("number")
    number, nearest = pairs.column("number").to_numpy(), unit(matrix(pairs.column("embedding")), longest, False)
    spread_, queries = unit(matrix(some.column("embedding")), longest, False), unit(queries, longest, True)
    axes, ranked = axes_of(queries.shape[1]), []
    most = {levels: max(p.probes for p in PLANS if p.levels == levels) for levels in {p.levels for p in PLANS}}
    # the probe at which a pair, or an entry of the sample, is met: by levels and tables
    at_pair: dict[int, list[np.ndarray]] = {}
    at_entry: dict[int, list[np.ndarray]] = {}
    firsts: dict[int, list[np.ndarray]] = {}
    for levels, n in most.items():
        for t in range(max(p.tables for p in PLANS)):
            probes = cells(queries, t, levels, n)
            homes, others = cells(nearest, t, levels, 1)[:, 0], cells(spread_, t, levels, 1)[:, 0]
            at_pair.setdefault(levels, []).append(np.concatenate([_place(q, homes[number == i]) for i, q in enumerate(probes)]))
            at_entry.setdefault(levels, []).append(np.concatenate([_place(q, others) for q in probes]))
            firsts.setdefault(levels, []).append(probes // axes ** (levels - 1))
    for plan in PLANS:
        recall = float(np.mean(np.min(at_pair[plan.levels][: plan.tables], axis=0) < plan.probes))
        met = sum(float(np.mean(a < plan.probes)) for a in at_entry[plan.levels][: plan.tables]) * total
        moved = np.mean([len(np.unique(q)) for f in firsts[plan.levels][: plan.tables] for q in f[:, : plan.probes]]) * plan.tables
        ranked.append((recall < FIT_RECALL, -recall if recall < FIT_RECALL else met + MOVE * moved, plan, recall))
    return min(ranked)[2:]


def best_of(near: np.ndarray, bound: np.ndarray, exact, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, score)`` of the ``k`` best columns of each row, and of those that tie with the last.

    ``near`` is within ``bound`` (one for each row) of a multiple of the true
    scores; ``exact(rows, columns)`` gives these.
    """
    if near.shape[1] > k:
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        rows, columns = np.nonzero(near >= (least - 2 * bound)[:, None])
    else:
        rows, columns = np.indices(near.shape).reshape(2, -1)
    score = exact(rows, columns)
    order = np.lexsort((-score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    starts = np.searchsorted(rows, np.arange(len(near)))
    last = np.minimum(starts + k - 1, np.append(starts[1:], len(rows)) - 1)
    keep = score >= score[last][rows] if len(rows) else np.empty(0, bool)
    return rows[keep], columns[keep], score[keep]


def compared(x: np.ndarray, entry: np.ndarray, members: np.ndarray, queries: np.ndarray, rest: np.ndarray, wanted: list[np.ndarray] | None, k: int):
    """``(query entry, entry, score)`` of the best members for each query of a bucket.

    Products are taken in single precision first, on components scaled to at
    most 1; all within their rounding error of the ``k``-th are kept.  A query
    meets the members whose ``rest`` is among its ``wanted`` (all, if None).
    """
    big = max(float(np.abs(x[members]).max(initial=0.0)), 1e-300)
    small = (x[members] / big).astype(np.float32)
    error = (x.shape[1] + 4) * 2.0**-23 * float(np.linalg.norm(small, axis=1).max(initial=0.0))
    by_rest = np.argsort(rest[members], kind="stable")
    ordered = rest[members][by_rest]
    for at in range(0, len(queries), 64) if wanted is None else range(len(queries)):
        own = queries[at : at + 64] if wanted is None else queries[at : at + 1]
        chosen = np.arange(len(members))
        if wanted is not None:
            a, b = np.searchsorted(ordered, wanted[at]), np.searchsorted(ordered, wanted[at], "right")
            chosen = by_rest[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
        if not len(chosen):
            continue
        scale = np.maximum(np.abs(x[own]).max(1), 1e-300)
        asking = (x[own] / scale[:, None]).astype(np.float32)
        near = asking @ (small if wanted is None else small[chosen]).T
        exact = lambda i, j, own=own, chosen=chosen: np.concatenate(
            [(x[own[i[c : c + 65_536]]] * x[members[chosen[j[c : c + 65_536]]]]).sum(1) for c in range(0, max(1, len(i)), 65_536)]
        )
        i, j, score = best_of(near, error * np.linalg.norm(asking, axis=1).astype(float), exact, k)
        yield entry[own[i]], entry[members[chosen[j]]], score


def search(vectors: DataFrame, is_query: Column, k: int = 20, plan: Plan | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query row.

    ``vectors``: ``vec_id`` and ``embedding``.  Rows without an id, and
    vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do those of another length than the commonest (the
    smaller of two equally common).  A row repeated with the same id and
    vector counts once; unlike vectors of one id are rows of their own: each is
    a query with its own ranks, and each may be found, by the others too.
    Other columns are not read but for ``is_query``.
    Queries that meet fewer than ``k`` others (or all, if there are fewer) are
    asked again under every axis of one table, where each entry is met.
    ``plan`` is fitted if none is given.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("embedding") == (sizes.size if sizes else 0))
    least = W.partitionBy("entry").orderBy("vec_id")
    ids = rows.groupBy("embedding", "vec_id").agg(F.max("is_query").alias("is_query"))
    ids = written(ids.withColumn("entry", F.xxhash64("embedding")), "vectors")
    first = ids.select("entry", "vec_id").withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
    kept = written(first.select("entry", "vec_id"), "copies")
    asked = ids.filter("is_query").groupBy("entry").agg(F.lit(True).alias("asked"))
    entries = ids.groupBy("entry").agg(F.any_value("embedding").alias("embedding")).join(asked, "entry", "left")
    entries = written(entries, "entries")
    span = entries.agg(F.min(_length()), F.max(_length())).first()
    longest = 0.0 if not span[1] or span[1] - span[0] <= 1e-6 * span[1] else float(span[1])
    plan = plan or fit(entries, k, longest)[0]

    def nearest(entries: DataFrame, plan: Plan) -> DataFrame:
        levels = plan.levels

        def home(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
            cell, axes = cells(unit(x, longest, False), table, levels, 1)[:, 0], axes_of(x.shape[1] + (longest > 0))
            return table * axes + cell // axes ** (levels - 1), cell % axes ** (levels - 1)

        def count(batch: pa.RecordBatch) -> Iterator[dict]:
            if batch.num_rows:
                x = matrix(batch.column(0))
                bucket, n = np.unique(np.concatenate([home(x, t)[0] for t in range(plan.tables)]), return_counts=True)
                yield {"bucket": bucket, "n": n}

        def replicate(batch: pa.RecordBatch) -> Iterator[dict]:
            if not batch.num_rows:
                return
            x = matrix(batch.column(1))
            asks = np.flatnonzero(np.array(batch.column(2).to_pylist(), object) == True)  # noqa: E712
            axes = axes_of(x.shape[1] + (longest > 0))
            step = max(1, BATCH_ROWS // min(plan.probes, axes))
            for t in range(plan.tables):
                bucket, rest = home(x, t)
                yield {"bucket": bucket, "asks": np.zeros(len(x), bool), "entry": batch.column(0), "embedding": batch.column(1), "rests": rest[:, None].tolist()}
                for some in (asks[i : i + step] for i in range(0, len(asks), step)):
                    probes = cells(unit(x[some], longest, True), t, levels, plan.probes)
                    buckets, who, rests = [], [], []
                    for i, own in zip(some.tolist(), probes, strict=True):
                        at, inverse = np.unique(own // axes ** (levels - 1), return_inverse=True)
                        buckets.append(t * axes + at)
                        who += [i] * len(at)
                        rests += [own[inverse == j] % axes ** (levels - 1) for j in range(len(at))] if levels > 1 else [[0]] * len(at)
                    at = pa.array(who)
                    yield {"bucket": np.concatenate(buckets), "asks": np.ones(len(who), bool), "entry": batch.column(0).take(at), "embedding": batch.column(1).take(at), "rests": [list(r) for r in rests]}

        counts = map_texts(entries, ["embedding"], "bucket int, n long", count, rows=2048).groupBy("bucket").agg(F.sum("n").alias("n"))
        # a row for each axis and table: bounded
        split = counts.select(F.col("bucket").alias("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("int").alias("parts"))
        dealt = map_texts(entries, ["entry", "embedding", "asked"], "bucket int, asks boolean, entry long, embedding array<double>, rests array<long>", replicate, rows=2048)
        dealt = dealt.join(F.broadcast(split), F.col("bucket") == F.col("b"))  # a bucket without entries has nothing to meet
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        own = F.array(F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), every).otherwise(own))).select("bucket", "part", "asks", "entry", "embedding", "rests")

        def compare(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy()
            x, entry = matrix(table.column("embedding")), table.column("entry").to_numpy()
            members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            rests = table.column("rests").to_pylist() if levels > 1 else None
            rest = np.array([r[0] for r in rests]) if rests else np.zeros(len(x), np.int64)
            wanted = [np.array(rests[q]) for q in queries] if rests else None
            out = list(compared(x, entry, members, queries, rest, wanted, k + 1)) if len(members) else []
            a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pa.table({"q": a, "v": b, "score": s})

        met = dealt.groupBy("bucket", "part").applyInArrow(compare, "q long, v long, score double")
        best = met.groupBy("q", "v").agg(F.max("score").alias("score"))
        # entries first: of k + 1 entries each has an id, and those of equal score are settled by the ids below
        by_score = W.partitionBy("q").orderBy(F.desc("score"))
        best = best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= k + 1).drop("place")
        named = best.join(kept.select(F.col("entry").alias("v"), "vec_id"), "v")
        order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        named = named.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("q", "v", "vec_id", "score")
        asking = ids.filter("is_query").select(F.col("entry").alias("q"), F.col("vec_id").alias("query_id"))
        pairs = named.join(asking, "q").filter("not (vec_id = query_id and v = q)")
        final = W.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id", "v")
        return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("q", "query_id", "rank", "vec_id", "score")

    found = written(nearest(entries, plan), "nearest")
    others = rows_of(ids) - 1
    asking = ids.filter("is_query").select(F.col("entry").alias("q"), F.col("vec_id").alias("query_id"))
    met = found.groupBy("q", "query_id").agg(F.count(F.lit(1)).alias("met"))
    short = asking.join(met, ["q", "query_id"], "left").filter(F.coalesce("met", F.lit(0)) < min(k, others))
    short = written(short.select(F.col("q").alias("entry")).distinct(), "short")
    if short.isEmpty():
        return found.drop("q")
    again = entries.drop("asked").join(short.withColumn("asked", F.lit(True)), "entry", "left")
    more = nearest(again, Plan(1, 1, 1 << 30))
    return found.join(short.select(F.col("entry").alias("q")), "q", "left_anti").unionByName(more).drop("q")


def _length() -> Column:
    return F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
