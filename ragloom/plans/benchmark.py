"""Comparing retrieval methods on a set of questions with known answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import METHODS, Settings
from ..functions import prompts
from .. import shared
from ..operators import evaluation, knn, retrieval, summaries
from ..providers import Chat, Embedder
from ..sources import reports
from ..sources.index_store import IndexStore
from . import indexing


def needs(methods: tuple[str, ...]) -> tuple[bool, bool]:
    """(vector index, graph index)."""
    return any(m == "vector_rag" or m.startswith("hybrid") for m in methods), any(m != "vector_rag" for m in methods)


class Retrievers:
    """Contexts (query_id, context, num_chunks) by method; each part is planned once."""

    def __init__(self, queries: DataFrame, store: IndexStore, chat: Chat, settings: Settings):
        self.queries, self.store, self.chat, self.settings = queries, store, chat, settings

    def vector_rag(self) -> DataFrame:
        chunks = self.store.read("chunks")
        hits = knn.with_content(knn.nearest(chunks, self.queries, self.settings.vector.top_k), chunks.select("chunk_id", "content"))
        return retrieval.for_all(self.queries.select("query_id"), retrieval.joined_context(hits)).select("query_id", "context", "num_chunks")

    def graphrag_local(self) -> DataFrame:
        s = self.store
        return retrieval.local_search(self.queries, s.read("entity_vectors"), s.read("membership"), s.read("communities"), self.settings.graph.top_k).select("query_id", "context", "num_chunks")

    def graphrag_global(self) -> DataFrame:
        return retrieval.global_for(self.queries, self.store.read("communities"))

    def hybrid_selection(self) -> DataFrame:
        replies = shared.written(summaries.chat_column(self.queries.select("query_id", "query"), "query", self.chat, "reply", prompts.CLASSIFY_SYSTEM))
        classified = replies.withColumn("query_classification", retrieval.query_class(F.col("reply")))
        return retrieval.select_side(classified, self.vector_rag(), self.graphrag_local()).select("query_id", "context", "num_chunks")

    def hybrid_integration(self) -> DataFrame:
        return retrieval.integrate(self.queries, self.vector_rag(), self.graphrag_local())

    def of(self, method: str) -> DataFrame:
        if method not in METHODS:
            raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
        return getattr(self, method)()


def evaluate(samples: DataFrame, contexts: DataFrame, chat: Chat, method: str, metric: evaluation.Metric) -> DataFrame:
    """Predictions of one method; questions without a context have the fixed answer."""
    rows = samples.select("query_id", "query", F.col("answer").alias("ground_truth"), "query_type").join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    asked = summaries.chat_column(rows.where("context <> ''").withColumn("prompt", prompts.simple_prompt(F.col("context"), F.col("query"))), "prompt", chat, "prediction", prompts.ANSWER_SYSTEM).drop("prompt")
    silent = rows.where("context = ''").withColumn("prediction", F.lit(retrieval.NO_ANSWER))
    return evaluation.judged(asked.unionByName(silent), metric).withColumn("method_name", F.lit(method))


def run(samples: DataFrame, documents: DataFrame, store: IndexStore, embedder: Embedder, chat: Chat, settings: Settings = Settings(), metric: evaluation.Metric | None = None, rebuild: bool = False, cache: bool = True) -> DataFrame:
    """Predictions of all methods of the settings, written with their comparison to output_dir.

    Without `cache` the vector index is built anew, with `rebuild` both are."""
    methods = tuple(settings.methods)
    chunks = shared.written(indexing.chunked(documents, settings))
    vector, graph = needs(methods)
    if vector:
        indexing.index_vectors_cached(store, chunks, embedder, settings, rebuild or not cache)
    if graph:
        indexing.build_graph_cached(store, chunks, chat, embedder, settings, rebuild)
    queries = shared.written(knn.embed(samples.select("query_id", "query"), "query", embedder, "query_embedding"))
    retrievers = Retrievers(queries, store, chat, settings)
    metric = metric or evaluation.exact_metric()
    parts = [shared.written(evaluate(samples, retrievers.of(m), chat, m, metric)) for m in methods]
    predictions = reduce(DataFrame.unionByName, parts)
    for m, part in zip(methods, parts, strict=True):
        reports.save_result(part, evaluation.accuracy_by_type(part), f"{settings.output_dir}/{m}")
    reports.save_comparison(evaluation.compare_overall(predictions), evaluation.compare_by_type(predictions, list(methods)), evaluation.complementarity(predictions, list(methods)), settings.output_dir)
    return predictions
