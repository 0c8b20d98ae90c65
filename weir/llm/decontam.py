"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Items are dealt out to indexes by their length.  Every passage of every text
(overlapping windows, as wide as the lengths of the index need) is a query
against the items.  An item's scores are divided by its own
score against itself, so one threshold serves all.  Retrieved items are
verified: a text is contaminated if both the question and the answer of the
item overlap one passage.

Scores rest on the statistics of all items (how many have a word, their mean
length).  Items of more than ``INDEX_BYTES`` are indexed a part at a time: each
part is searched in a pass of its own and what it finds is written, so
the driver never holds more than two parts, a task one, and what is found
does not depend on the number of parts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.llm.common import map_texts, written

#: Characters of scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD, RUN = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]+")
WORD_OR_RUN = re.compile(f"[{UNSPACED}]+|[^\\W{UNSPACED}]+")
K1, B = 1.2, 0.75
#: Postings in a block that shares one bound.
BLOCK = 2
#: Share of an item's own BM25 score from which it is retrieved, and share of
#: distinct question and answer words that must stand in the passage.
THRESHOLD, OVERLAP = 0.6, 0.8
#: The last part of an item's words is its answer, the rest its question.
ANSWER = 1 / 3
#: Bytes of item text that are indexed at a time.
INDEX_BYTES = 8 << 20
#: Characters of a text that are cut into words at a time.
SEGMENT = 1 << 20


def words(text: str | None) -> list[str]:
    """Words in lower case; a run of characters of an unspaced script gives each pair of neighbours, one alone itself."""
    low = (text or "").lower()
    if low.isascii() or not RUN.search(low):
        return WORD.findall(low)
    out: list[str] = []
    for word in WORD_OR_RUN.findall(low):
        out += map("".join, zip(word, word[1:], strict=False)) if len(word) > 1 and RUN.match(word) else (word,)
    return out


def segment(text: str, at: int) -> tuple[int, int]:
    """Where the piece of ``text`` from ``at`` on ends, and where the next begins.

    Words of the pieces are those of the text: no word is cut, and of a run
    of an unspaced script the last character is read again.
    """
    unspaced = lambda i: at <= i < len(text) and RUN.match(text[i]) is not None
    end = min(len(text), at + max(2, SEGMENT))
    if unspaced(end) and unspaced(end - 1):
        end += not unspaced(end - 2)
        return end, end - unspaced(end)
    while end < len(text) and (text[end].isalnum() or text[end] == "_") and not unspaced(end):
        end += 1
    return end, end


@dataclass
class Statistics:
    """Of all items that have a word: their number, their mean length, and how many have each word."""

    n: int
    mean: float
    df: dict[str, int]

    @staticmethod
    def of(items: list[tuple[int, str | None]]) -> Statistics:
        found = [w for w in (words(t) for _, t in items) if w]
        return Statistics(len(found), sum(map(len, found)) / max(1, len(found)), Counter(t for w in found for t in set(w)))


class Index:
    """Postings by term, sorted by item, with bounds for each block and list."""

    def __init__(self, items: list[tuple[int, str | None]], among: Statistics | None = None, half: int | None = None) -> None:
        """``among``: the statistics of all items (of these by default); ``half``: words of half a window, by the longest item if none is given."""
        among = among or Statistics.of(items)
        found = [(i, words(t)) for i, t in sorted(items, key=lambda x: x[0])]
        found = [(i, w) for i, w in found if w]
        self.ids = [i for i, _ in found]
        self.parts = []
        for _, w in found:
            cut = max(1, len(w) - max(1, round(len(w) * ANSWER)))
            self.parts.append((frozenset(w[:cut]), frozenset(w[cut:]) or frozenset(w)))
        self.half = half or max(64, max((len(w) for _, w in found), default=0))
        n_items, mean, df = among.n, among.mean, among.df
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        for k, (_, w) in enumerate(found):
            tf = Counter(w)
            raw = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in tf.items()}
            own = sum(raw.values())
            for t, v in raw.items():
                at, impact = self.postings.setdefault(t, ([], []))
                at.append(k)
                impact.append(v / own)
        self.block_max = {t: [max(v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)] for t, (_, v) in self.postings.items()}
        self.bound = {t: max(v) for t, (_, v) in self.postings.items()}
        self.blocks: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for t, (at, v) in self.postings.items():  # by blocks of item numbers, for bounds of many items at once
            best: dict[int, float] = {}
            for k, x in zip(at, v, strict=True):
                best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
            self.blocks[t] = np.fromiter(best, np.int64), np.fromiter(best.values(), float)

    def reaches(self, window: list[str], least: float) -> bool:
        """Whether the block bounds let any item score ``least`` or more in ``window``."""
        blocks = self.blocks
        lists = [blocks[t] for t in set(window) if t in blocks]
        if not lists:
            return False
        totals = np.bincount(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]))
        return bool(totals.max() >= least - 1e-9)

    def search(self, terms: list[str], least: float) -> list[tuple[int, float]]:
        """Items that score ``least`` or more, by document-at-a-time block-max WAND."""
        cursors = [[self.postings[t][0], self.postings[t][1], self.block_max[t], self.bound[t], 0] for t in set(terms) if t in self.postings]
        out, eps = [], 1e-12
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            total, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                total += c[3]
                if total >= least - eps:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == item:
                pivot += 1
            bound, ahead = 0.0, item + 1 << 40
            for c in cursors[: pivot + 1]:  # bounds of the blocks that hold the pivot item
                at = bisect_left(c[0], item, c[4])
                if at < len(c[0]):
                    bound += c[2][at // BLOCK]
                    end = min(len(c[0]), (at // BLOCK + 1) * BLOCK) - 1
                    ahead = min(ahead, c[0][end] + 1)
            if bound < least - eps:  # no item of these blocks can reach it
                after = cursors[pivot + 1][0][cursors[pivot + 1][4]] if pivot + 1 < len(cursors) else 1 << 60
                to = max(item + 1, min(ahead, after))
            elif cursors[0][0][cursors[0][4]] == item:
                score = sum(c[1][c[4]] for c in cursors[: pivot + 1] if c[0][c[4]] == item)
                if score >= least - eps:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                c[4] = bisect_left(c[0], to, c[4])
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return out

    def passages(self, text: str, least: float = 0.0) -> Iterator[list[str]]:
        """Windows of ``2 * half`` words, each starting half a window after the last.

        They are left out four halves at a time where the bounds are below ``least``.
        """
        half = self.half
        carry: list[str] = []
        at, any_yet = 0, False
        while at < len(text):
            end, following = segment(text, at)
            carry += words(text[at:end])
            at = following
            k, last = 0, at >= len(text)
            while k + 4 * half <= len(carry) or last and (k + half < len(carry) or not any_yet and k == 0):
                any_yet = True
                if not least or self.reaches(carry[k : k + 4 * half], least):
                    for i in range(k, k + 3 * half, half):
                        if i == k or i + half < len(carry):
                            yield carry[i : i + 2 * half]
                k += 3 * half
            carry = carry[k:]

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Item id to its best (score, question overlap, answer overlap) over the passages where it is verified."""
        found: dict[int, tuple[float, float, float]] = {}
        for passage in self.passages(text or "", THRESHOLD):
            have = set(passage)
            for k, score in self.search(passage, THRESHOLD):
                question, answer = self.parts[k]
                q, a = len(question & have) / len(question), len(answer & have) / len(answer)
                if q >= OVERLAP and a >= OVERLAP:
                    found[self.ids[k]] = max(found.get(self.ids[k], (0.0, 0.0, 0.0)), (score, q, a))
        return found


def by_length(items: list[tuple[int, str | None]], among: Statistics | None = None) -> list[Index]:
    """An index for each length class (up to 64 words, 128, 256, ...), scored as one index of all items would.

    Windows have twice the words of the class, so a long item does not widen
    those in which the words of a short one are sought.
    """
    among = among or Statistics.of(items)
    longest: dict[int, int] = {}
    for i, t in items:
        longest[i] = max(longest.get(i, 0), len(words(t)))
    classes: dict[int, list[tuple[int, str | None]]] = {}
    for i, t in items:
        classes.setdefault(max(64, 1 << (longest[i] - 1).bit_length()) if longest[i] else 64, []).append((i, t))
    return [Index(rows, among, half) for half, rows in sorted(classes.items())] or [Index([])]


def parts(items: DataFrame, index_bytes: int | None = None) -> Iterator[list[Index]]:
    """The indexes of all items, a part of about ``index_bytes`` at a time; statistics are those of all parts.

    Items are dealt out by a hash of their id.  Rows without an id or a text
    are left out, repeated rows count once.
    """
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (index_bytes or INDEX_BYTES)))
    if n == 1:
        yield by_length([(r.item_id, r.text) for r in rows.collect()])
        return

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [words(t) for t in batch.column(1).to_pylist()]
        yield {"item_id": batch.column(0), "text": batch.column(1), "length": [len(w) for w in found], "terms": [sorted(set(w)) for w in found]}

    table = map_texts(rows, ["item_id", "text"], "item_id long, text string, length long, terms array<string>", cut)
    table = written(table.filter("length > 0").withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n))), "items")
    count, mean = table.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = written(table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    for k in range(n):
        part = table.filter(F.col("part") == k)
        own = df.join(part.select(F.explode("terms").alias("term")).distinct(), "term").collect()
        yield by_length([(r.item_id, r.text) for r in part.collect()], Statistics(count, mean, {r.term: r.df for r in own}))


def _leaks(indexes: list[Index], text: str | None) -> dict[int, tuple[float, float, float]]:
    """As :meth:`Index.leaks`, over all length classes; an item is in one."""
    return {i: v for index in indexes for i, v in index.leaks(text).items()}


def _found(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        got = [(d, c, i, *v) for d, c, t in rows for i, v in sorted(_leaks(indexes, t).items())]
        yield {name: [r[k] for r in got] for k, name in enumerate(("doc_id", "copy", "item_id", "score", "question", "answer"))}

    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return map_texts(rows, ["doc_id", "copy", "text"], "doc_id long, copy long, item_id long, score double, question double, answer double", per_batch)


def contaminated(docs: DataFrame, items: DataFrame, index_bytes: int | None = None) -> DataFrame:
    """``doc_id, item_id, score, question, answer``: one row for each item found in each text.

    A null or empty text or item matches nothing.  An item too short to have
    two words has the same question and answer.  Repeated rows of a document
    repeat its matches.  Other columns are not read.
    """
    return _contaminated(docs, items, index_bytes)[0].drop("copy")


def _contaminated(docs: DataFrame, items: DataFrame, index_bytes: int | None) -> tuple[DataFrame, list[Index] | None]:
    """The rows found, with the hash of the text; and the indexes, if they are one part."""
    out, every = None, parts(items, index_bytes)
    indexes = next(every)
    following = next(every, None)
    if following is None:
        return _found(docs, indexes), indexes
    while indexes is not None:  # written before the next part but one is built
        found = written(_found(docs, indexes), "found")
        out = found if out is None else out.union(found)
        indexes, following = following, next(every, None)
    return out, None


def clean(docs: DataFrame, items: DataFrame, index_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item; repeated rows are judged alike, null and empty texts stay.

    Without items all rows stay.  Items of one part are sought in the pass
    that filters; else the texts found in any part are joined by id and hash.
    """
    found, indexes = _contaminated(docs, items, index_bytes)
    if indexes is None:
        bad = found.select(F.col("doc_id").alias("of"), F.col("copy").alias("said")).distinct()
        rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("copy"))  # a row goes as one value: its columns may have any names
        return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("said")), "left_anti").select("row.*")
    kinds, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [not any(index.leaks(t.as_py()) for index in indexes) for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, kinds)
