"""Language identification with a string kernel.

A text is the set of its character n-grams of one to four characters (the
blended spectrum, presence only), kept as a bitmap of ``FEATURES`` hashed
positions.  A longer text than ``PIECE`` characters is read in pieces, each a
bitmap, as one bitmap would fill up; its score is the mean of theirs, by their
lengths.  Kernel: shared n-grams over the geometric mean of both counts.
Landmark texts give Nystroem features, and kernel ridge regression, one
language versus the rest, gives the scores; both are batched matrix products.
The scores say which language is nearest, not how near: a text that shares
nothing with any has a score of 0.5.  So a text is taken to be in that
language only if enough of its n-grams are known from it; the limit comes from
the labelled texts, each held against the others.

Every language is learned.  Fitting uses a sample of labelled rows, at most
``PER_LANGUAGE`` of each language and about ``SAMPLE`` in all, drawn by a hash
of doc_id over the whole table; of a long text one piece, drawn alike.  Only
their bitmaps (8 KB each) reach the driver, so a few thousand languages are
the most that it can learn.  Prediction reads every whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weir.llm.common import map_texts

FEATURES = 1 << 16
#: Labelled rows of each language that are fitted on, and landmarks among them; both of all languages (each has one at least).
PER_LANGUAGE, LANDMARKS, SAMPLE, ALL_LANDMARKS = 256, 24, 4096, 768
BUCKETS, RIDGE = 16, 1e-2
#: Characters of a text that make one bitmap; bitmaps that are multiplied at a time.
PIECE, ROWS = 1 << 14, 128
#: Letters and numerals beyond the digits, which are told apart by their category.
WORDLIKE = re.compile(r"[^\W\d_]")
#: Texts of a language that must have an n-gram for it to be known, and the share of labelled texts that may be unlike the others.
HOLDERS, UNLIKE = 2, 0.02
MIX = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script (``\\p{L}``); ½, ² and Ⅷ are none."""
    return any(unicodedata.category(m[0])[0] == "L" for m in WORDLIKE.finditer(text))


def presence(text: str) -> np.ndarray:
    """Bitmap of the n-grams of the lower-cased text, white space as one space."""
    flags = np.zeros(FEATURES, bool)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes <= 32, np.uint32(32), codes)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(4):  # n + 1 characters
        if len(codes) <= n:
            break
        gram = (gram[: len(codes) - n] * np.uint32(0x01000193) + codes[n:] + np.uint32(n + 1)) * MIX
        gram ^= gram >> np.uint32(15)
        flags[gram & np.uint32(FEATURES - 1)] = True
    return flags


def pieces(text: str) -> list[str]:
    """``text`` cut every PIECE characters; each begins with the three before it, so that no n-gram is lost."""
    return [text[max(0, at - 3) : at + PIECE] for at in range(0, len(text), PIECE)]


@dataclass
class Scorer:
    """What tasks need of a model: no landmarks, one column for each language."""

    languages: list[str]
    used: np.ndarray  # features that a landmark has
    folded: np.ndarray  # those features by languages
    known: np.ndarray  # languages by features, as packed bits: the n-grams known from each
    limits: np.ndarray  # for each language, the share of known n-grams from which a text is in it

    def scores(self, bitmaps: np.ndarray) -> np.ndarray:
        shared = bitmaps[:, self.used].astype(np.float32) @ self.folded
        return shared / np.sqrt(np.maximum(1, bitmaps.sum(1)))[:, None]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of each text, and whether it is in the language that scores best, not just nearer to it than to the others."""
        cut = [pieces(t) for t in texts]
        starts = np.cumsum([0, *map(len, cut[:-1])])
        sizes = np.array([len(p) for ps in cut for p in ps], float)
        flat = (p for ps in cut for p in ps)
        packed, scores, grams = [], [], []
        while len(some := [presence(p) for p in islice(flat, ROWS)]):
            bitmaps = np.array(some)
            packed.append(np.packbits(bitmaps, axis=1))
            scores.append(self.scores(bitmaps))
            grams.append(bitmaps.sum(1))
        mean = np.add.reduceat(np.concatenate(scores) * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
        best = mean.argmax(1)
        known = self.known[np.repeat(best, [len(ps) for ps in cut])]
        shared = np.bitwise_count(np.concatenate(packed) & known).sum(1, dtype=np.int64)
        return mean, np.add.reduceat(shared, starts) >= self.limits[best] * np.add.reduceat(np.concatenate(grams), starts)


def limits_of(bitmaps: np.ndarray, labels: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``known`` and ``limits`` of a :class:`Scorer`.

    A limit is halfway between the share of n-grams that are known by chance
    (of a text in another script, as positions are shared) and the share that
    nearly all labelled texts reach by the other texts of their language.
    """
    known, limits = [], []
    for k in languages:
        own = bitmaps[np.array(labels) == k]
        holders = own.sum(0)
        others = (own & (holders > HOLDERS)).sum(1) / np.maximum(1, own.sum(1))  # held by that many besides the text itself
        known.append(np.packbits(holders >= HOLDERS))
        limits.append((np.mean(holders >= HOLDERS) + np.quantile(others, UNLIKE, method="lower")) / 2 if others.any() else 0.0)
    return np.array(known), np.array(limits)


@dataclass
class Model:
    languages: list[str]
    used: np.ndarray  # features that a landmark has
    rows: np.ndarray  # those features by landmarks, 0 or 1
    sizes: np.ndarray  # n-grams of each landmark
    known: np.ndarray
    limits: np.ndarray

    def kernel(self, bitmaps: np.ndarray) -> np.ndarray:
        """Texts by landmarks: products of 0/1 matrices with the landmarks' 0/1 matrix."""
        shared = np.concatenate([bitmaps[k : k + ROWS, self.used].astype(np.float32) @ self.rows for k in range(0, len(bitmaps), ROWS)])
        sizes = np.maximum(1, bitmaps.sum(1)).astype(np.float32)
        return shared / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def set_weights(self, weights: np.ndarray) -> None:
        """The kernel is linear in a text's n-grams, so landmarks and weights fold into one matrix."""
        self.weights = weights
        self.scorer = Scorer(self.languages, self.used, (self.rows @ (weights / np.sqrt(self.sizes)[:, None])).astype(np.float32), self.known, self.limits)

    def scores(self, bitmaps: np.ndarray) -> np.ndarray:
        """``kernel(bitmaps) @ weights``."""
        return self.scorer.scores(bitmaps)


def fit(bitmaps: np.ndarray, labels: list[str]) -> Model:
    """Ridge regression on Nystroem features of ``bitmaps`` (texts by features)."""
    languages = sorted(set(labels))
    target = np.array([[1.0 if y == k else -1.0 for k in languages] for y in labels])
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    marks = np.concatenate([np.flatnonzero(np.array(labels) == k)[:each] for k in languages])
    used = np.flatnonzero(bitmaps[marks].any(0))
    rows = np.ascontiguousarray(bitmaps[marks][:, used].T, np.float32)
    model = Model(languages, used, rows, np.maximum(1, bitmaps[marks].sum(1)).astype(np.float32), *limits_of(bitmaps, labels, languages))
    full = model.kernel(bitmaps).astype(float)
    values, vectors = np.linalg.eigh(full[marks])
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = full @ root
    inner = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ target)
    model.set_weights(root @ inner)
    return model


def learn(docs: DataFrame, learnable: Column | None = None, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fit on the rows of ``docs`` with text, doc_id and lang under ``learnable``; None if there are none.

    The sample is chosen without moving the texts, of rows whose text has a
    letter: doc_ids are hashed into ``BUCKETS`` for each row that is wanted,
    the lowest hash of a bucket stays (in each task, then among tasks), and of
    these the lowest of a language.  Of rows with one doc_id and language, the
    one with the least bitmap is fitted on.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.filter(learnable) if learnable is not None else rows
    keys = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(17)).alias("draw"))
    languages = keys.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(per_language, sample // max(1, languages)))
    lowest = keys.groupBy("lang", F.pmod("draw", F.lit(BUCKETS * each))).agg(F.min(F.struct("draw", "doc_id")).alias("first"))
    order = W.partitionBy("lang").orderBy("first")
    chosen = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("first.doc_id").distinct().collect()
    if not chosen:
        return None
    texts = rows.filter(F.col("doc_id").isin([r.doc_id for r in chosen])).select("doc_id", "lang", "text")

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        flags = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cut = pieces(text)
            flags.append(np.packbits(presence(cut[zlib.crc32(str(doc).encode()) % len(cut)])).tobytes())
        yield {"doc_id": batch.column(0), "lang": batch.column(1), "bits": flags}

    found = map_texts(texts, ["doc_id", "lang", "text"], "doc_id long, lang string, bits binary", per_batch)
    found = found.groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).collect()
    found = sorted(found, key=lambda r: (r.lang, r.doc_id))
    bitmaps = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in found], bool)
    return fit(bitmaps, [r.lang for r in found])


def _read(scorer: Scorer | None, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The numbers of the texts with a letter, their scores, and whether they are in the language that scores best."""
    named = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not scorer or not named:
        return named, np.empty((0, 0)), np.empty(0, bool)
    return named, *scorer.read([texts[i] for i in named])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of each row.

    ``und`` with score 0 if the text is null, empty or has no letter, or if
    nothing was learned.  Ties go to the first language by name.  Repeated
    rows stay; other columns are not read.
    """

    scorer = model.scorer if model else None

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1).to_pylist()
        named, scores, _ = _read(scorer, texts)
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        for i, row in zip(named, scores, strict=scorer is not None):
            best = int(row.argmax())
            pred[i], score[i] = scorer.languages[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
        yield {"doc_id": batch.column(0), "lang_pred": pred, "score": score}

    return map_texts(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", per_batch, rows=64)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def identified(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, score of ``least`` or more, n-grams known from it.

    Works on each row by itself: the model rejects or keeps it with all its
    columns.  Null and empty texts and those without a letter go.  Where no
    row is labelled nothing can be learned, and all others stay.  Repeated
    rows are judged alike.
    """
    model = learn(docs)
    scorer = model.scorer if model else None
    at, kinds = docs.columns.index("text"), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                named, scores, known = _read(scorer, part.column(at).to_pylist())
                if scorer and named:
                    good = ((scores.max(1) + 1) / 2 >= least) & known
                    named = [i for i, ok in zip(named, good.tolist(), strict=True) if ok]
                yield part.take(pa.array(named, pa.int64()))

    return docs.mapInArrow(keep, kinds)
