"""What the classifiers share: labelled training rows, scoring of every document, and filtering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoding
from .common import crc_mod

FOLDS, HELD_OUT_FOLD = 5, 0
#: Makes, in a worker, what scores a list of texts.
Scorer = Callable[[], Callable[[list[str | None]], object]]


def training_features(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, features: Callable, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, x of at most max_rows labelled documents outside the held-out fold, written
    to the shared folder.

    features() gives, in a worker, what makes an Arrow array of the type `kind` of a list of texts.
    The documents are those whose ids have the smallest hashes, so the sample is the same in each
    run.  Null labels and ids don't count; of repeated labels the largest does.  Of rows with one id
    and different texts that with the smallest hash of its text counts, so max_rows bounds the rows
    as well as the ids and labels that are broadcast.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), FOLDS) != HELD_OUT_FOLD))
    given = given.groupBy(F.col(id_col).cast("long").alias("labelled_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = given.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", F.xxhash64("text").alias("of_text"), "text")

    def run(batches):
        import pyarrow as pa

        encoding.forget()
        make = features()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], make(part.column(3).to_pylist())], ["doc_id", "label", "of_text", "x"])

    made = rows.mapInArrow(common.tidy(run), f"doc_id long, label int, of_text long, x {kind}")
    once = made.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "of_text").alias("of"))
    return common.materialise(once.select("doc_id", "of.label", "of.x"), "training")


def score_texts(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        score = scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_bounded(score, part.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(common.tidy(run), "doc_id long, score double")


def _bounded(score, texts):
    import numpy as np

    return np.clip(np.asarray(score(texts.to_pylist()), np.float64), 0.0, 1.0)


def report(scored: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, scorer: Scorer, good: Callable, text_col: str = "text") -> DataFrame:
    """The rows of docs whose scores are good, all their columns unchanged.

    Each row is decided by its own text and stays where it is: nothing is shuffled, null and
    repeated ids are like any others, equal texts share their fate."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        encoding.forget()
        score = scorer()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield part.filter(pa.array(good(_bounded(score, part.column(at)))))

    return docs.mapInArrow(common.tidy(run), docs.schema)
