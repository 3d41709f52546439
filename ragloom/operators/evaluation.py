"""Scores of answers, by method and type of question, and comparisons of methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Metric:
    """A named condition on (prediction, truth)."""

    name: str
    match: Callable[[Column, Column], Column]

    def __call__(self, prediction: Column, truth: Column) -> Column:
        return self.match(prediction, truth)


def exact_metric(normalize: bool = True) -> Metric:
    return Metric("exact_match", lambda p, t: text.exact_match(p, t, normalize))


def contains_metric(normalize: bool = True) -> Metric:
    return Metric("contains_match", lambda p, t: text.contains_match(p, t, normalize))


def fuzzy_metric(threshold: float = 0.8, normalize: bool = True) -> Metric:
    return Metric(f"fuzzy_match_{threshold}", lambda p, t: text.fuzzy_match(p, t, normalize, threshold))


def type_distribution(samples: DataFrame, type_col: str = "query_type") -> DataFrame:
    return samples.groupBy(F.col(type_col).alias("query_type")).agg(F.count("*").alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """accuracy of is_correct; 0 without rows."""
    return predictions.agg(F.coalesce(F.avg(F.col("is_correct").cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("total"))


def accuracy_by_type(predictions: DataFrame) -> DataFrame:
    """query_type, is_overall, correct, total, accuracy: a row for each type and one for all of
    them, told apart by is_overall, since a type may be called overall."""
    grouped = predictions.rollup("query_type").agg(F.grouping("query_type").cast("boolean").alias("is_overall"), F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
    return grouped.select("query_type", "is_overall", "correct", "total", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)).alias("accuracy"))


def compare_overall(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("method_name").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count("*").alias("total"))


def compare_by_type(predictions: DataFrame, methods: list[str]) -> DataFrame:
    """query_type and a column of accuracy for each method; null where a method has no such type."""
    return predictions.groupBy("query_type").pivot("method_name", methods).agg(F.avg(F.col("is_correct").cast("double")))


def complementarity(predictions: DataFrame, methods: list[str]) -> DataFrame:
    """For each two methods, in the order given: questions that only the first, only the second,
    both or neither got right, and their percentages; null percentages without questions."""
    place = F.array_position(F.lit(list(methods)), F.col("method_name"))
    ranked = predictions.where(place > 0).select("query_id", "method_name", "is_correct", place.alias("place"))
    left = ranked.select("query_id", F.col("method_name").alias("method_1"), F.col("is_correct").alias("c1"), F.col("place").alias("p1"))
    right = ranked.select("query_id", F.col("method_name").alias("method_2"), F.col("is_correct").alias("c2"), F.col("place").alias("p2"))
    paired = left.join(right, "query_id").where("p1 < p2")
    counted = paired.groupBy("method_1", "method_2").agg(
        F.count_if(F.expr("c1 AND NOT c2")).alias("only_1"), F.count_if(F.expr("c2 AND NOT c1")).alias("only_2"),
        F.count_if(F.expr("c1 AND c2")).alias("both"), F.count_if(F.expr("NOT c1 AND NOT c2")).alias("neither"), F.count("*").alias("total"),
    )
    return counted.select("*", *(F.try_divide(F.col(c) * 100.0, F.col("total")).alias(f"{c}_pct") for c in ("only_1", "only_2", "both", "neither")))


def judged(answers: DataFrame, metric: Metric = exact_metric()) -> DataFrame:
    """answers (query_id, query, ground_truth, prediction, query_type, ...) with is_correct."""
    return answers.withColumn("is_correct", metric(F.col("prediction"), F.col("ground_truth")))
