"""Phrase collocation mining by hierarchical pair naming.

A word is named by a hash of its language and letters.  Level by level, two
adjacent names of frequent (k-1)-word phrases are replaced by the name of the
pair: ``name(w1..wk) = pair(name(w1..wk-1), name(w2..wk))``.  Equal phrases have
equal names in all tasks, pairs are counted globally, and the table of frequent
pairs keeps both names a pair was made of.  These are parent pointers: by two
joins with the level below, a phrase gets the counts of all its first and last
parts (for the cuts) and hands its own count to the two phrases that it holds
(for the subsumption, which goes by the next level alone, as a phrase is never
more frequent than one inside it).

Texts are read once for each level; names are made anew from the words, so
nothing of the size of the corpus is written or shuffled, only counts of pairs
of frequent phrases.  Which phrases are frequent is told by a map of fixed size
that is broadcast: it may take a rare phrase for a frequent one, whose pairs are
then counted too; the exact counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.llm.common import map_texts, written

#: Occurrences of a phrase; words of the longest; rows returned of each language.
LEAST, LONGEST, BEST = 30, 4, 2000
#: Of the count of a phrase, in hundredths: a longer one with as many drops it.
SUBSUMED = 80
#: Bits of the map of a level's frequent names.
MAP_BITS = 1 << 25
#: Bytes of text whose words are counted together.
CHUNK = 4 << 20
#: Separate preselections of the best phrases of a language.
SALTS = 64

_BREAK = b"\xff"  # in no UTF-8 text
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``size``, cut before a blank or break; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(_BREAK, at, end))
            after = [p for p in (data.find(b" ", end), data.find(_BREAK, end)) if p >= 0]
            end = cut if cut > at else min(after, default=len(data))
        yield data[at:end]
        at = end


def _words(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, list[bytes], int]]:
    """``(lang, words, known)`` of the rows ``lang, text``; breaks are words, the first ``known`` were at the end of the words before."""
    of_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        of_lang.setdefault("und" if lang is None else lang, []).append(text or b"")
    for lang, texts in of_lang.items():
        data = _BREAK.join(texts).lower().translate(_MARKS)
        last: list[bytes] = []
        for chunk in _chunks(data, size):
            new = chunk.replace(_BREAK, b" " + _BREAK + b" ").split()
            yield lang, last + new, len(last)
            last = (last + new)[1 - LONGEST :]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, by a multiply-xorshift mix of 64 bits."""
    x = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _names(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64(lang, word)``; 0 for a break."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    names = np.array([0 if w == _BREAK else xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
    return names[coded.indices.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``docs`` (``lang, text``); the row whose word is null has all words of the language."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for lang, words, known in _words(batch, CHUNK):
            coded = pa.array(words[known:], pa.binary()).dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
            found = [(w, n) for w, n in zip(coded.dictionary.to_pylist(), counts, strict=True) if w != _BREAK]
            texts = pa.array([None, *(w for w, _ in found)], pa.binary()).view(pa.string())
            yield {"lang": [lang] * len(texts), "word": texts, "n": [sum(n for _, n in found), *(n for _, n in found)]}

    return map_texts(docs, ["lang", "text"], "lang string, word string, n long", per_batch).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, maps: list[Broadcast]) -> DataFrame:
    """``left, right, n`` of the pairs of adjacent frequent phrases of ``len(maps)`` words, ``maps`` telling the frequent ones of each level."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for lang, words, known in _words(batch, CHUNK):
            names = _names(lang, words)
            for level, frequent in enumerate(maps, 1):
                bits = frequent.value
                at = names & np.uint64(len(bits) * 8 - 1)
                names[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 0] = 0
                left, right = names[:-1], names[1:]
                both = (left != 0) & (right != 0)
                if level == len(maps):
                    both[: max(0, known - level)] = False  # these end in words that have been counted
                    left, right = left[both], right[both]
                    _, first, n = np.unique(pair(left, right), return_index=True, return_counts=True)
                    yield {"left": left[first].view(np.int64), "right": right[first].view(np.int64), "n": n}
                else:
                    names = np.where(both, pair(left, right), np.uint64(0))

    return map_texts(docs, ["lang", "text"], "left long, right long, n long", per_batch).groupBy("left", "right").agg(F.sum("n").alias("n"))


def named(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their ``name``; the frequent ones alone get one, so that no name is shuffled while pairs are counted."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        left, right, n = (batch.column(c).to_numpy() for c in range(3))
        yield {"name": pair(left.view(np.uint64), right.view(np.uint64)).view(np.int64), "left": left, "right": right, "n": n}

    return map_texts(pairs, ["left", "right", "n"], "name long, left long, right long, n long", per_batch, rows=1 << 16)


def name_map(names: DataFrame, bits: int = MAP_BITS) -> Broadcast:
    """The names of ``names`` as a map of ``bits`` bits: at most ``bits / 64`` rows go to the driver, whatever the input."""
    place = names.select(F.col("name").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = place.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return names.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def score(a: str, left: str, right: str) -> Column:
    """``floor(2000000 a / (left + right))``, exact for any longs."""
    return F.expr(f"(cast({a} as decimal(19,0)) * 2000000BD) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")


def _level(counts: DataFrame, below: DataFrame) -> DataFrame:
    """The frequent pairs, with what their parents in the level ``below`` know: ``firsts`` (counts of the first 1, 2, ... words), ``lasts`` likewise."""
    pairs = named(counts.filter(F.col("n") >= LEAST))
    a = below.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("head"), F.array_append("firsts", F.col("a")).alias("firsts"))
    b = below.select(F.col("name").alias("right"), F.col("last"), F.array_append("lasts", F.col("a")).alias("lasts"))
    return pairs.join(a, "left").join(b, "right").select("lang", "name", "left", "right", F.col("n").alias("a"), F.concat_ws(" ", "head", "last").alias("phrase"), "last", "firsts", "lasts")


def levels(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All words of each language (``lang, n``), and the frequent phrases of 1 to LONGEST words, each level a table of its own."""
    words = written(word_counts(docs).filter(F.col("word").isNull() | (F.col("n") >= LEAST)), "words")
    total = words.filter("word is null").select("lang", "n")
    none = F.array().cast("array<bigint>")
    found = [words.filter("word is not null").select("lang", F.xxhash64("lang", "word").alias("name"), F.col("n").alias("a"), F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("firsts"), none.alias("lasts"))]
    maps = []
    for _ in range(2, LONGEST + 1):
        maps.append(name_map(found[-1]))
        found.append(written(_level(pair_counts(docs, maps), found[-1]), "phrases"))
    return total, found


def mined(docs: DataFrame, best: int = BEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language of ``docs`` (``lang, text``).

    A null lang is ``und`` (with those that are so named), a null text is
    empty; repeated rows count each; a language without candidates, as an
    empty table, has no rows; other columns are not read.  Long texts are read
    in chunks of CHUNK bytes, with the phrases across the cuts.
    """
    total, found = levels(docs)
    kept = []
    for k in range(2, LONGEST + 1):
        cut = lambda j, k=k: F.struct(score("a", f"firsts[{j - 1}]", f"lasts[{k - j - 1}]").alias("score"), F.lit(j).alias("cut"), F.col("firsts")[j - 1].alias("l"), F.col("lasts")[k - j - 1].alias("r"))
        rows = found[k - 1]
        if k < LONGEST:
            longer = found[k].select(F.explode(F.array("left", "right")).alias("name"), "a").groupBy("name").agg(F.max("a").alias("longer"))
            rows = rows.join(longer, "name", "left").filter(F.expr(f"longer is null or 100BD * longer < {SUBSUMED}BD * a"))
        kept.append(rows.select("lang", "phrase", "a", F.array_min(F.array(*map(cut, range(1, k)))).alias("cut"), F.pmod("name", F.lit(SALTS)).alias("salt")))
    rows = reduce(DataFrame.unionByName, kept)
    rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "salt")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)  # best x SALTS rows of a language
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
