"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept.  Columns beyond ``doc_id``, ``text``, ``lang`` and ``n_chars``
pass through all stages but the last, whatever their names; an empty table
gives an empty one; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import decontam, langid, packing, pii, simhash
from weir.llm.common import written
from weir.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or far from every learned one, go: null and empty texts and those without a letter among them.

    Learned from the labelled rows; where there are none, all texts with a letter stay.  Repeated rows are judged alike.
    """
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest doc_id.

    Repeated rows become one; unlike texts of one doc_id are different documents.  Rows without a doc_id stay.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none.  Repeated rows are judged alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in it is replaced by its kind, and ``n_chars`` follows.  A null text stays null."""
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place; a null or empty text is one piece, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", sequences),
]

#: Kernels, fingerprints, BM25, transducers and the packing search are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
