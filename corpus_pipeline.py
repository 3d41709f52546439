"""Corpus preparation in stages, each an operator of ``ragloom.llm``.

Every stage takes what its predecessor kept, and its decisions take effect: rows that a stage
drops are gone, rows that the mix takes twice are there twice.  All stages but the last return the
columns of ``documents``; the last returns the packed pieces.

Classifiers, mix and packing treat each row by itself, so null and repeated ids are like any others,
and a null text is an empty one.  The join decides by id and text: rows that repeat both are one
document, a null id is linked with nothing.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import common, mixing, ngram_join, packing, quality, toxicity
from ragloom.llm.queries import tokenizer_file

#: A classifier over documents with a learned sampling of sources can't be put in SQL; the stages
#: are tested one by one against plain versions instead.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.3 or more."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"), threshold=0.3)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below 0.5."""
    return toxicity.keep_clean(docs, common.read(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of sets of five-word shingles."""
    return ngram_join.keep_first(docs, size=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences of 2048 and their places there."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and reread."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            common.discard(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
