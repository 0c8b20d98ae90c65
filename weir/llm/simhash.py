"""SimHash near-duplicates, found at the anchors of a covering code.

Fingerprint bits are cut into blocks of at most 23.  The anchors of a block
are the 4096 words of the perfect Golay code, whose covering radius is 3: each
block value lies within 3 bits of exactly one anchor.  A fingerprint goes to
every anchor within the covering radius plus the block's threshold of 1 (5.3
on average), so two values that differ in at most one bit of a block meet at
the anchor nearest to either.  With 64 bits in three blocks, at most 4
differing bits leave one block with at most 1: no pair is missed.

Fingerprints meet once each (copies are one row before anything is dealt
out), an anchor's fingerprints are compared inside its task, and only a
spanning star of what links there leaves it.  Anchors with more than
``ANCHOR_ROWS`` fingerprints of 64 bits are dealt a second time, by exact
parts, of which a pair within the threshold shares one.  What is still larger,
and large anchors of wider fingerprints, are split, and every pair of parts is
a task of its own: all pairs at an anchor are compared, however many.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weir.llm.common import hot_join, map_texts, maybe_in, rows_of, written
from weir.llm.components import components

RADIUS, LENGTH = 3, 23
#: Generator polynomial of the binary Golay code: a fixed value.
GOLAY = 0b101011100011
#: Fingerprints at one anchor that one task compares.
ANCHOR_ROWS = 20_000
#: Rows that are compared with each other at once; groups looked for row by row before the rest of a large anchor.
TILE, SEEDS = 1024, 64
#: Share of the words of a wide fingerprint that are compared first: pairs over the limit there are not read on.
FIRST = 5 / 8
#: Bytes of a text that are cut into words at a time.
SEGMENT = 1 << 22
#: Shingles whose bits are counted at a time.
CHUNK = 255 * 64
SPACE = re.compile(rb"[ \t-\r]")
LANES = np.uint64(0x0101010101010101)
#: Steps and multipliers that spread one 64-bit hash over further words: fixed values, of the SplitMix64 generator.
STEP, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# --- fingerprints -------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the ``width``-word shingles, repeats included, in parts.

    Words are runs without ASCII white space, with A-Z lower-cased.  A text of
    fewer words gives its whole sequence; one of no words gives nothing.
    """
    raw, at, carry, seen = text.encode("utf-8", "surrogatepass"), 0, [], False
    digest = xxhash.xxh64_intdigest
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        if end < len(raw):
            gap = SPACE.search(raw, end)
            end = gap.start() if gap else len(raw)
        words = carry + raw[at:end].lower().split()
        at = end
        if len(words) >= width:
            seen = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not seen and carry:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def spread(h: np.ndarray, n_words: int) -> np.ndarray:
    """``n_words`` rows of hashes: ``h``, then further ones, as good as independent of it and of each other."""
    steps = np.array([STEP * i & (1 << 64) - 1 for i in range(n_words)], np.uint64)
    x = h[None, :] + steps[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    x[0] = h
    return x


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each of the 64 bits: eight byte lanes at a time."""
    out = np.zeros((len(hashes), 64), np.int64)
    cuts = np.arange(0, hashes.shape[1], 255)
    for k in range(8):
        lanes = np.ascontiguousarray(np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts, axis=1))
        out[:, k::8] = lanes.view(np.uint8).reshape(len(hashes), -1, 8).sum(1, dtype=np.int64)
    return out


def fingerprint(text: str | None, width: int = 4, n_words: int = 1) -> np.ndarray:
    """``n_words`` 64-bit words; a bit is 1 if set in over half the shingles."""
    counts, n = np.zeros((n_words, 64), np.int64), 0
    for h in shingle_hashes(text or "", width):
        n += len(h)
        for at in range(0, len(h), CHUNK):
            counts += bit_counts(spread(h[at : at + CHUNK], n_words))
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = 4, n_words: int = 1) -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` is binary, 8 bytes a word, little-endian."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1)
        yield {"doc_id": batch.column(0), "fp": [fingerprint(t.as_py(), width, n_words).tobytes() for t in texts]}

    return map_texts(docs, ["doc_id", "text"], "doc_id long, fp binary", per_batch)


def digits(fp: Column | str) -> Column:
    """The 16 hex digits of a fingerprint of one word, its highest byte first (``F.reverse`` would turn characters, not bytes)."""
    low_first = F.lower(F.hex(fp))
    return F.concat(*[F.substring(low_first, 2 * k + 1, 2) for k in reversed(range(8))])


def number(fp: Column | str) -> Column:
    """A fingerprint of one word as a long: different ones give different numbers."""
    return F.conv(digits(fp), 16, -10).cast("long")


# --- anchors ------------------------------------------------------------------


def _remainder(x: np.ndarray) -> np.ndarray:
    """Syndrome: the remainder of the polynomial ``x`` by the generator."""
    x = x.copy()
    for k in range(LENGTH - 1, 10, -1):
        x ^= np.where((x >> k) & 1, GOLAY << (k - 11), 0)
    return x


@lru_cache(1)
def _offsets() -> tuple[np.ndarray, np.ndarray]:
    """Errors of at most RADIUS + 1 bits, sorted by syndrome and weight, and where each syndrome starts."""
    from itertools import combinations

    errors = np.array([sum(1 << b for b in c) for k in range(RADIUS + 2) for c in combinations(range(LENGTH), k)], np.int64)
    syndromes = _remainder(errors)
    order = np.lexsort((np.bitwise_count(errors), syndromes))
    return errors[order], np.searchsorted(syndromes[order], np.arange((1 << 11) + 1))


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)`` for every anchor within RADIUS + 1 of each 23-bit value; a row's nearest is its first."""
    errors, starts = _offsets()
    syndrome = _remainder(values)
    n = starts[syndrome + 1] - starts[syndrome]
    rows = np.repeat(np.arange(len(values)), n)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, values[rows] ^ errors[starts[syndrome[rows]] + within]


def nearest_anchor(values: np.ndarray) -> np.ndarray:
    errors, starts = _offsets()
    return values ^ errors[starts[_remainder(values)]]


def block_values(fps: np.ndarray, n_blocks: int) -> list[np.ndarray]:
    """Blocks of at most 23 bits: three of a 64-bit word in all, or 23-bit runs of a wider fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    cuts = [0, 22, 43, 64] if bits.shape[1] == 64 else list(range(0, 23 * n_blocks + 1, 23))
    return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)]


def as_words(column: pa.Array | pa.ChunkedArray, n_words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, n_words)


# --- links at one anchor ------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row linked, directly or not, to each of ``n`` rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``x`` and each of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of ``x`` and of ``y`` differ in at most ``limit`` bits."""
    if x.shape[1] == 1:
        return _distance(x, y) <= limit
    first = math.ceil(FIRST * x.shape[1])
    near = _distance(x[:, :first], y[:, :first]) <= limit
    i, j = np.nonzero(near)
    if 8 * len(i) > near.size:
        return near & (_distance(x, y) <= limit)
    near[i, j] = np.bitwise_count(x[i] ^ y[j]).sum(1, dtype=np.uint16) <= limit
    return near


def parts(fps: np.ndarray, limit: int) -> list[np.ndarray]:
    """One more part of the 64 bits than ``limit``: two values within it have one part in common."""
    cuts = np.linspace(0, 64, max(limit, 1) + 2).astype(int).tolist()
    return [(fps[:, 0] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _spread_search(fps: np.ndarray, limit: int, seeds: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Star links of the groups of the first ``seeds`` rows, and the rows in none of these groups.

    Each row is met once, so dense groups cost no square of links.
    """
    left, a, b = np.arange(len(fps)), [], []
    for _ in range(seeds):
        if not len(left):
            break
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(left), 4096):
                hit[at : at + 4096] = _near(fps[front[:256]], fps[left[at : at + 4096]], limit).any(0)
            found, left = left[hit], left[~hit]
            a.append(found)
            b.append(np.full(len(found), root))
            front = np.concatenate([front[256:], found])
    return a, b, left


def _every_link(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows which the pairs within ``limit`` connect, by comparing all."""
    if len(fps) <= TILE:
        return np.nonzero(np.triu(_near(fps, fps, limit), 1))
    a, b, left = _spread_search(fps, limit, SEEDS)
    for at in range(0, len(left), TILE):
        here, there = left[at : at + TILE], left[at:]
        x, y = _links_across(fps[here], fps[there], limit)
        both = np.concatenate([here, there])
        a.append(both[x])
        b.append(both[y])
    return np.concatenate([np.empty(0, int), *a]), np.concatenate([np.empty(0, int), *b])


def _links(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_every_link`; many rows of one word are compared within equal parts only, which misses no pair."""
    if len(fps) <= TILE or fps.shape[1] > 1:
        return _every_link(fps, limit)
    a, b = [], []
    for key in parts(fps, limit):
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                x, y = _every_link(fps[run], limit)
                a.append(run[x])
                b.append(run[y])
    return np.concatenate([np.empty(0, int), *a]), np.concatenate([np.empty(0, int), *b])


def _links_across(x: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of a row of ``x`` and a row of ``y`` connect; rows of ``y`` count on from ``x``."""
    a, b = [np.empty(0, int)], [np.empty(0, int)]
    for s in range(0, len(x), 512):
        near = np.zeros((min(512, len(x) - s), len(y)), bool)
        for t in range(0, len(y), 4096):
            near[:, t : t + 4096] = _near(x[s : s + 512], y[t : t + 4096], limit)
        i, j = np.nonzero(near)
        root = _roots(len(near) + len(y), i, j + len(near))
        i = np.flatnonzero(root != np.arange(len(root)))
        both = np.concatenate([np.arange(s, s + len(near)), len(x) + np.arange(len(y))])
        a.append(both[i])
        b.append(both[root[i]])
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, n_words: int, n_blocks: int, limit: int, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the nodes which pairs within ``limit`` bits at some anchor connect.

    ``nodes``: ``(node long, fp binary)``, one row for each fingerprint.
    """

    def crowd(batch: pa.RecordBatch) -> Iterator[dict]:
        for k, values in enumerate(block_values(as_words(batch.column(0), n_words), n_blocks)):
            anchor, n = np.unique(anchors(values)[1], return_counts=True)
            yield {"anchor": (k << LENGTH) | anchor, "n": n}

    crowds = map_texts(nodes, ["fp"], "anchor int, n long", crowd, rows=4096).groupBy("anchor").agg(F.sum("n").alias("n"))
    # at most 4096 anchors a block, whatever the input
    crowded = crowds.filter(F.col("n") > anchor_rows).select("anchor").toArrow().column(0).to_numpy()
    by_parts = crowded if n_words == 1 else crowded[:0]

    def replicate(batch: pa.RecordBatch) -> Iterator[dict]:
        fps = as_words(batch.column(1), n_words)
        for k, values in enumerate(block_values(fps, n_blocks)):
            rows, anchor = anchors(values)
            anchor |= k << LENGTH
            again = np.isin(anchor, by_parts)
            plain, rows, hot, hot_rows = anchor[~again], rows[~again], anchor[again], rows[again]
            at = pa.array(rows)
            yield {"anchor": plain, "second": np.zeros(len(plain), np.int64), "node": batch.column(0).take(at), "fp": batch.column(1).take(at)}
            if len(hot):
                keys = parts(fps[hot_rows], limit)
                at = pa.array(hot_rows)
                for n, key in enumerate(keys):
                    yield {"anchor": hot, "second": key.astype(np.int64) * len(keys) + n + 1, "node": batch.column(0).take(at), "fp": batch.column(1).take(at)}

    dealt = map_texts(nodes, ["node", "fp"], "anchor int, second long, node long, fp binary", replicate, rows=4096 if n_words == 1 else 1024)
    if len(crowded):
        large = dealt.filter(F.col("anchor").isin(crowded.tolist())).groupBy("anchor", "second").count().filter(F.col("count") > anchor_rows)
        cuts = large.select(F.col("anchor").alias("hot"), F.col("second").alias("hot_second"), F.ceil(F.col("count") / anchor_rows).cast("int").alias("cuts"))
        dealt = dealt.join(cuts, (F.col("anchor") == F.col("hot")) & (F.col("second") == F.col("hot_second")), "left")
    else:
        dealt = dealt.withColumn("cuts", F.lit(None).cast("int"))
    own = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    others = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = (
        dealt.withColumn("own", own).withColumn("other", F.explode(others))
        .select("anchor", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp")
    )

    def compare(table: pa.Table) -> pa.Table:
        nodes_, own_, i, j = (table.column(c).to_numpy() for c in ("node", "own", "i", "j"))
        fps = as_words(table.column("fp"), n_words)
        if i[0] == j[0]:
            order = np.argsort(nodes_)
            a, b = _links(fps[order], limit)
        else:
            order = np.lexsort((nodes_, own_ == j[0]))
            n = int((own_ == i[0]).sum())
            a, b = _links_across(fps[order[:n]], fps[order[n:]], limit)
        root = _roots(len(order), a, b)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": nodes_[order[at]], "v": nodes_[order[root[at]]]})

    return dealt.groupBy("anchor", "second", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, n_words: int = 1, n_blocks: int = 3, limit: int = 4) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp`` (binary) and ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links.  With one
    word and a limit of 4 (the defaults) all pairs within the limit link.
    Wider fingerprints link the pairs within ``limit`` that meet at an anchor.

    A null or empty text has fingerprint zero and links like any other.
    Rows with a null doc_id get a fingerprint and link, but never name a
    component; a component without any doc_id has a null id.  Repeated rows
    stay.  Other columns are not read.
    """
    table = written(fingerprints(docs, width, n_words), "fingerprints")
    # a fingerprint of one word names itself; of a wider one, a 64-bit hash does
    name = number("fp") if n_words == 1 else F.xxhash64("fp")
    nodes = table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.withColumn("node", name), "nodes")
    roots = written(components(links(nodes.select("node", "fp"), n_words, n_blocks, limit)), "roots")
    linked = nodes.join(roots, nodes["node"] == roots["u"])
    sizes = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    moved = hot_join(linked.select("fp", "root"), sizes, "root", rows_of(roots)).select("fp", "component")
    ids = nodes.select("fp", "least", "n").join(moved, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id"))
    return hot_join(table, written(ids, "ids"), "fp", rows_of(table)).select("doc_id", "fp", "component_id")


#: The pipeline's setting: 5-word shingles, 512 bits, anchors of six blocks.  Shingle sets
#: of similarity 0.8 differ in 77 of 512 bits on average; as candidates are verified,
#: the limit leaves room for five standard deviations.  Such a pair meets at an anchor of
#: one block with a probability of 0.6, of one of six with 0.996.
WIDE = {"width": 5, "n_words": 8, "n_blocks": 6, "limit": 118}
#: Largest sets whose neighbours, one element more, less or other, are found without fingerprints.
SHORT = 10
#: Shingle sets, and shingles in them, that one task verifies against each other.
PART_SETS, PART_SHINGLES = 4096, 1 << 21


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = np.empty(0, np.uint64)
    for h in shingle_hashes(text or "", width):
        found = np.union1d(found, h) if len(found) else np.unique(h)
    return found


def set_fingerprint(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """As :func:`fingerprint`, over distinct shingles: a repeated line counts once."""
    counts = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += bit_counts(spread(hashes[at : at + CHUNK], n_words))
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def short_keys(hashes: np.ndarray) -> list[int]:
    """Names of a short set and of it without each element: sets that differ in one element, or in one each, share a name."""
    if not 4 <= len(hashes) <= SHORT:  # smaller ones are never similar without being equal
        return []
    sets = [hashes, *(np.delete(hashes, k) for k in range(len(hashes)))]
    return [int.from_bytes(set_name(x)[:8], "little", signed=True) for x in sets]


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of all runs of ``n`` from ``starts``."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def verified_links(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of sets of Jaccard similarity 0.8 or more connect; of unlike ``side`` only, if given.

    A set is met once: it is compared with those not yet reached, so a dense
    group costs no square.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    n_holders = np.bincount(flat, minlength=len(names))
    at_holders = np.cumsum(n_holders) - n_holders
    open_, a, b = sizes > 0, [], []
    mark = np.zeros(len(names), bool)
    for first in range(len(sets)):
        front = [first] if open_[first] else []
        open_[first] = False
        while front:
            row = front.pop()
            ok = open_ & (5 * sizes >= 4 * sizes[row]) & (4 * sizes <= 5 * sizes[row])
            left = np.flatnonzero(ok if side is None else ok & (side != side[row]))
            if not len(left):
                continue
            own = flat[starts[row] : starts[row] + sizes[row]]
            if sizes[left].sum() <= n_holders[own].sum():
                mark[own] = True
                shared = np.add.reduceat(mark[flat[_ranges(starts[left], sizes[left])]].astype(np.int64), np.cumsum(sizes[left]) - sizes[left])
                mark[own] = False
            else:
                shared = np.bincount(holders[_ranges(at_holders[own], n_holders[own])], minlength=len(sets))[left]
            found = left[9 * shared >= 4 * (sizes[left] + sizes[row])]  # shared / (a + b - shared) >= 4 / 5
            open_[found] = False
            a.append(found)
            b.append(np.full(len(found), row))
            front += found.tolist()
    return np.concatenate([np.empty(0, int), *a]), np.concatenate([np.empty(0, int), *b])


def verify(docs: DataFrame, members: DataFrame, width: int, part_sets: int = PART_SETS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Edges ``(u, v)`` that connect the ``members(doc_id, name, n, node, root)`` which similar pairs of one root connect.

    Every pair of a root is compared, by the shingle sets of the texts in
    ``docs``; the sets of a large root are split, each pair of parts a task.
    """
    cuts = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    cuts = cuts.withColumn("cuts", F.ceil(F.greatest(F.col("sets") / part_sets, F.col("shingles") / part_shingles)).cast("int")).filter("cuts > 1")
    members = members.join(cuts.select("root", "cuts"), "root", "left").select(F.col("doc_id").alias("member"), "name", "node", "root", F.coalesce("cuts", F.lit(1)).alias("cuts"))
    asked = maybe_in(docs.select("doc_id", "text"), F.xxhash64("doc_id"), members.select(F.xxhash64("member"))).filter("_maybe")
    texts = asked.join(members, F.col("doc_id") == F.col("member"))

    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
        at = [k for k, s in enumerate(found) if set_name(s) == batch.column(1)[k].as_py()]  # a doc_id may have several texts
        yield {"hashes": [found[k].tobytes() for k in at], **{c: batch.column(k).take(pa.array(at, pa.int64())) for k, c in ((2, "node"), (3, "root"), (4, "cuts"))}}

    dealt = map_texts(texts, ["text", "name", "node", "root", "cuts"], "hashes binary, node long, root long, cuts int", sets)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        hashes = table.column("hashes")
        found = [np.frombuffer(hashes[int(k)].as_py(), np.uint64) for k in at]
        across = table.column("i")[0] != table.column("j")[0]
        a, b = verified_links(found, table.column("own").to_numpy()[at] if across else None)
        return pa.table({"u": nodes[a], "v": nodes[b]})

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, group``: one row for each row of ``docs`` with a doc_id; ``copy`` tells texts of one doc_id apart.

    Texts of equal 5-word shingle sets are copies.  Wide fingerprints of the
    sets give candidates, groups that may link; within a group all pairs are
    compared exactly, and a Jaccard similarity of 0.8 or more links.  A null
    or empty text is a copy of any other.  Columns other than ``doc_id`` and
    ``text`` are not read.
    """
    width, n_words = WIDE["width"], WIDE["n_words"]
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("copy"))

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [shingle_set(t.as_py(), width) for t in batch.column(2)]
        yield {
            "doc_id": batch.column(0), "copy": batch.column(1), "name": [set_name(s) for s in found], "n": [len(s) for s in found],
            "fp": [set_fingerprint(s, n_words).tobytes() for s in found], "keys": [short_keys(s) for s in found],
        }

    table = map_texts(named, ["doc_id", "copy", "text"], "doc_id long, copy long, name binary, n long, fp binary, keys array<long>", per_batch)
    table = written(table, "sets")
    firsts = [F.any_value(c).alias(c) for c in ("n", "fp", "keys")]
    nodes = table.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *firsts)
    nodes = written(nodes.withColumn("node", F.xxhash64("name")), "nodes")
    short = nodes.select("node", F.explode("keys").alias("key"))
    least = short.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = hot_join(short, least, "key", rows_of(short)).filter("node <> v").select(F.col("node").alias("u"), "v")
    near = links(nodes.select("node", "fp"), n_words, WIDE["n_blocks"], WIDE["limit"])
    candidates = components(near.unionByName(stars))
    members = written(nodes.join(candidates, nodes["node"] == candidates["u"]).select("doc_id", "name", "n", "node", "root"), "members")
    linked = components(verify(named, members, width)).select("u", F.col("root").alias("group"))
    of_set = nodes.join(linked, nodes["node"] == linked["u"], "left").select("name", F.col("copies").alias("n"), F.coalesce("group", "node").alias("group"))
    return hot_join(table.select("doc_id", "copy", "name"), written(of_set, "groups"), "name", rows_of(table)).select("doc_id", "copy", "group")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: that of the smallest doc_id.

    See :func:`groups`.  Of rows with one doc_id, those of one text are reduced
    to one; those of unlike texts are different documents.  Rows without a
    doc_id cannot be told apart: they stay and link nothing.
    """
    found = written(groups(docs), "of_each")
    keep = found.groupBy("group").agg(F.min(F.struct("doc_id", "copy")).alias("kept")).select("kept.*")
    keep = written(keep.select(F.col("doc_id").alias("_kept"), F.col("copy").alias("_copy")), "kept")
    kept = (F.col("doc_id") == F.col("_kept")) & (F.col("copy") == F.col("_copy"))
    # rows that go, and rows that are there several times: only these are moved
    several = found.groupBy("doc_id", "copy").count().filter("count > 1").select("doc_id", "copy")
    moved = written(found.join(keep, kept, "left_anti").select("doc_id", "copy").union(several).select(F.xxhash64("doc_id", "copy")), "moved")
    # a row goes as one value: its columns may have any names
    marked = docs.filter(F.col("doc_id").isNotNull()).select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("copy"))
    marked = maybe_in(marked, F.xxhash64("doc_id", "copy"), moved)
    held = (marked["doc_id"] == keep["_kept"]) & (marked["copy"] == keep["_copy"])
    rest = marked.filter("_maybe").join(keep, held, "left_semi").dropDuplicates(["doc_id", "copy"])
    return marked.filter("not _maybe").unionByName(rest).select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))
