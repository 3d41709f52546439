"""Evaluation results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the order of columns.
PREDICTION_COLUMNS = ("query_id", "query_type", "is_correct", "query", "ground_truth", "prediction")


def save_predictions_csv(predictions: DataFrame, path: str) -> None:
    predictions.select(*PREDICTION_COLUMNS).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def save_predictions_json(predictions: DataFrame, path: str, include_context: bool = False, context_length: int = 1000) -> None:
    """Contexts are cut to their first code points."""
    columns = list(PREDICTION_COLUMNS)
    if include_context:
        predictions = predictions.withColumn("context", F.substring("context", 1, context_length))
        columns += [c for c in ("context", "retrieval_metadata") if c in predictions.columns]
    predictions.select(*columns).write.mode("overwrite").json(path)


def save_result(predictions: DataFrame, by_type: DataFrame, path: str, include_context: bool = True) -> None:
    save_predictions_json(predictions, f"{path}/predictions.json", include_context)
    save_predictions_csv(predictions, f"{path}/predictions.csv")
    by_type.write.mode("overwrite").json(f"{path}/accuracy.json")


def save_comparison(overall: DataFrame, by_type: DataFrame, pairs: DataFrame, path: str) -> None:
    """A row for each method, method and type, and pair of methods: no more rows than that."""
    for name, df in (("overall", overall), ("by_type", by_type), ("pairs", pairs)):
        df.coalesce(1).write.mode("overwrite").json(f"{path}/comparison/{name}")
