"""The registered queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled, mixing, near_vectors, ngram_join, packing, ppm, quality, token_files, topk, toxicity, warc
from .common import crc_mod, read


def tokenizer_file(name: str) -> str:
    """The public vocabulary file `name`; RAGLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("RAGLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents"), size=4, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return labelled.report(quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels"))), threshold=0.3)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    folder, captures = warc.write_archives(pages, min_bytes=0)
    warc.write_index(captures, f"{folder}/index")
    found = warc.CaptureIndex(spark, f"{folder}/index").lookup_all(pages)
    records = warc.read_captures(folder, found, common.tasks(pages), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.token_file_digests(spark, files)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return labelled.report(toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"))), threshold=0.5)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality": op2_quality,
    "op3_ppm": op3_ppm,
    "op4_warc": op4_warc,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.oracle(size=4, percent=85),
    "op4_warc": warc.oracle(min_bytes=0),
    "op5_exact_top_k": topk.oracle(k=5, scale=256, query="q.vec_id % 50 = 0"),
    "op7_mixing": mixing.oracle(),
    "op10_embedding_near_dedup": near_vectors.oracle(threshold=0.9),
}
