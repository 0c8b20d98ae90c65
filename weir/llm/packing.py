"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A gene is a whole sequence ("bin").  Crossover injects well-filled bins of one
parent into the other, drops the other's bins that hold the same pieces, and
best-fits the pieces displaced by that.  Pieces are dealt by a hash into
groups; each group evolves on several islands (a task each), the elites of an
island migrate to the next one between epochs through a shuffle, and a group's
best island wins.  The worst-filled bins of all groups are then opened and
evolved once more in new groups, so what is left over in one group meets what
is left over in others.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from weir.llm.common import map_texts, rows_of, written

CAPACITY = 2048
#: Pieces of a group, islands of a group, epochs between which elites migrate.
GROUP, ISLANDS, EPOCHS = 768, 2, 2
#: Parents kept on an island, children made in an epoch, elites that migrate.
POPULATION, CHILDREN, ELITES = 4, 10, 2
#: Bins filled below this share are opened for the second round.
OPEN_BELOW = 0.985
#: Distinct words whose ids a task remembers, and bytes of text cut at a time.
CACHE, SEGMENT = 600_000, 1 << 22
#: Words that need no normalising but lower case: letters of Latin-1, then a few ASCII marks but the apostrophe.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]{0,8})")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


# --- tokens -------------------------------------------------------------------


class WordTokens:
    """Token ids of a text as little-endian 32-bit bytes, a word at a time.

    For tokenizers whose pre-tokenizer never joins across ASCII white space
    and drops it, as the default one does: the ids of a text are then those of
    its words in turn, and a word met before need not be encoded again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.parts = Tokenizer.from_file(path), {}, {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def word(self, raw: bytes) -> bytes:
        """The ids of one word; of Latin letters and marks, by the tokenizer's model on each of the two."""
        text = raw.decode()
        plain = PLAIN.fullmatch(text)
        if not plain:
            return self.whole(text)
        letters, mark = plain.groups()
        letters = letters.lower()
        parts = self.parts
        if letters not in parts:
            spelled = letters if letters.isascii() else "".join([BYTE_LETTERS[b] for b in letters.encode()])
            parts[letters] = b"".join([self.id_bytes[t.id] for t in self.tokenizer.model.tokenize(spelled)])
        if mark and mark not in parts:
            parts[mark] = self.whole(mark)
        return parts[letters] + parts[mark] if mark else parts[letters]

    def encode(self, text: str) -> Iterator[bytes]:
        raw, at, cache = text.encode("utf-8", "replace"), 0, self.cache
        while at < len(raw):
            end = min(len(raw), at + SEGMENT)
            while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            words = raw[at:end].split()
            at = end
            fresh = {w for w in words if w not in cache}
            if len(cache) + len(fresh) > CACHE:
                cache.clear()
                self.parts.clear()
                fresh = set(words)
            for w in fresh:
                cache[w] = self.word(w)
            yield b"".join(map(cache.__getitem__, words))


_TOKENS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """One tokenizer for each Python worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def cut(stream: Iterator[bytes], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece of a document's ids with the closing id 0."""
    size, start, rest = 4 * capacity, 0, b""
    for part in stream:
        rest += part
        at = 0
        while len(rest) - at >= size:
            yield start, capacity, zlib.crc32(rest[at : at + size])
            start, at = start + capacity, at + size
        rest = rest[at:]
    rest += b"\0\0\0\0"
    yield start, len(rest) // 4, zlib.crc32(rest)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each row of ``docs``."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        words = tokens(tokenizer)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for n, found in enumerate(cut(words.encode(text or ""), capacity)):
                for name, value in zip(out, (doc, n, *found), strict=True):
                    out[name].append(value)
        yield out

    return map_texts(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", per_batch)


# --- one island ---------------------------------------------------------------


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Put each item, in the order given, where least room is left; open a bin if none has room."""
    room = sorted((capacity - f, k) for k, f in enumerate(fill))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            fill.append(0)
        fill[k] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))


def fitness(fill: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller bins, by the sum of squared fills."""
    return -len(fill), sum((f / capacity) ** 2 for f in fill)


def crossover(sizes: list[int], mother: list[list[int]], father: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The mother with a draw of the father's well-filled bins injected."""
    load = [sum(sizes[i] for i in b) for b in father]
    good = [k for k, f in enumerate(load) if f >= 0.99 * capacity] or [int(np.argmax(load))]
    injected = [father[k] for k in rng.choice(good, max(1, len(good) // 2), replace=False)]
    taken = {i for b in injected for i in b}
    # a mother's bin goes if it shares a piece; a few of the emptiest go too
    kept = [b for b in mother if taken.isdisjoint(b)]
    kept.sort(key=lambda b: sum(sizes[i] for i in b), reverse=True)
    kept = kept[: len(kept) - max(1, len(kept) // 20)]
    bins = [list(b) for b in injected] + [list(b) for b in kept]
    held = {i for b in bins for i in b}
    loose = [i for i in range(len(sizes)) if i not in held]
    order = sorted(loose, key=lambda i: (-sizes[i], rng.random()))
    best_fit(sizes, order, bins, [sum(sizes[i] for i in b) for b in bins], capacity)
    return bins


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, seed: int, children: int = CHILDREN) -> list[list[list[int]]]:
    """The fittest chromosomes after an epoch, best first."""
    rng = np.random.default_rng(seed)
    while len(population) < POPULATION:
        noise = 0 if not population else 0.05 * len(population)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))
        bins: list[list[int]] = []
        best_fit(sizes, order, bins, [], capacity)
        population.append(bins)
    score = lambda bins: fitness([sum(sizes[i] for i in b) for b in bins], capacity)
    ranked = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    least = -(-sum(sizes) // capacity)
    for n in range(children):
        if -ranked[0][0][0] <= least:
            break  # no packing has fewer bins
        a, b = rng.choice(min(POPULATION, len(ranked)), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng)
        ranked.append((score(child), len(population) + n, child))
        ranked.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        ranked = ranked[:POPULATION]
    return [p for _, _, p in ranked]


def _chromosome(column: np.ndarray) -> list[list[int]]:
    """Bins from the bin number of each item."""
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(column.tolist()):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def epoch(items: DataFrame, number: int, capacity: int, final: bool) -> DataFrame:
    """``items``: ``grp, island, item, length`` and, after the first epoch, ``elites`` (a bin number of each elite) ."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("item").to_numpy())
        table = table.take(pa.array(order))
        sizes = table.column("length").to_pylist()
        grp, island = table.column("grp")[0].as_py(), table.column("island")[0].as_py()
        start = [] if number == 0 else [_chromosome(c) for c in np.array(table.column("elites").to_pylist(), np.int32).T]
        fittest = evolve(sizes, start, capacity, zlib.crc32(f"{grp}:{island}:{number}".encode()))
        n = len(sizes)
        elites = np.stack([_numbers(p, n) for p in fittest[: 1 if final else ELITES]], axis=1)
        return pa.table({
            "grp": table.column("grp"), "island": table.column("island"), "item": table.column("item"), "length": table.column("length"),
            "elites": pa.array(elites.tolist(), pa.list_(pa.int32())),
            "bins": pa.array(np.full(n, len(fittest[0])), pa.int32()),
        })

    schema = "grp long, island int, item long, length long, elites array<int>, bins int"
    return items.groupBy("grp", "island").applyInArrow(run, schema)


def pack_round(items: DataFrame, salt: int, capacity: int, group: int = GROUP) -> DataFrame:
    """``item, length, grp, bin`` for ``items(item, length)`` after all epochs."""
    n_groups = max(1, round(rows_of(items) / group))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(n_groups)).alias("grp"))
    state = dealt.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))))
    for k in range(EPOCHS):
        if k:  # each island meets the elites of the one before it beside its own
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
            moved = moved.select("grp", "island", "item", F.col("elites").alias("immigrants"))
            state = state.join(moved, ["grp", "island", "item"]).select("grp", "island", "item", "length", F.concat("elites", "immigrants").alias("elites"))
        state = epoch(state, k, capacity, k == EPOCHS - 1)
    state = written(state, "islands")
    best = state.groupBy("grp").agg(F.min(F.struct("bins", "island")).alias("best"))
    won = state.join(best, "grp").filter(F.col("island") == F.col("best.island"))
    return won.select("item", "length", "grp", F.col("elites")[0].alias("bin"))


# --- all of it ----------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of ``docs``, with its sequence and place.

    A null or empty text is one piece of one id (the closing 0).  Repeated
    rows are packed each on its own.  Rows with a null doc_id are packed like
    any other.  Only texts of more than ``capacity`` ids are cut.  Other
    columns are not read.
    """
    table = written(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    loose = table.filter(F.col("length") < capacity).select("item", "length")
    first = written(pack_round(loose, 1, capacity), "packed")
    fills = first.groupBy("grp", "bin").agg(F.sum("length").alias("fill"))
    opened = fills.filter(F.col("fill") < OPEN_BELOW * capacity).select("grp", "bin")
    closed = first.join(opened, ["grp", "bin"], "left_anti").select("item", F.lit(1).alias("round"), "grp", "bin")
    again = pack_round(first.join(opened, ["grp", "bin"], "left_semi").select("item", "length"), 2, capacity)
    placed = closed.union(again.select("item", F.lit(2), "grp", "bin"))
    number = F.when(F.col("round").isNull(), F.col("item") * 4).otherwise((F.col("grp") * 100_000 + F.col("bin")) * 4 + F.col("round"))
    whole = table.join(placed, "item", "left").withColumn("sequence_id", number)
    ahead = W.partitionBy("sequence_id").orderBy("item").rowsBetween(W.unboundedPreceding, -1)
    return whole.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
