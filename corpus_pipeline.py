"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, suffix-array dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, near_dedup, packing, queries, suffix_dedup
from tidemark.llm.common import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a network trained on the labelled ones can tell."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a smaller doc_id, or an earlier place, already says in 100 bytes or more."""
    return suffix_dedup.cut_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its training sequence and its place there."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = packing.token_pieces(docs, f.read(), end_id=0, capacity=2048)
    return packing.pack(pieces, 2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's result written and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name, scan=True)
    return STAGES[-1][1](spark, docs, sf_dir)
