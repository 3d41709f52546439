"""Question answering over an index: many questions at once, or one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SERVICE, Settings
from ..functions import prompts
from ..operators import knn, retrieval, summaries
from ..providers import Chat, Embedder
from ..sources.index_store import IndexStore
from ..tracing import observed


class Service:
    """Retrieval and answers by vector, graph or both."""

    def __init__(self, store: IndexStore, embedder: Embedder, chat: Chat, settings: Settings = SERVICE):
        self.store, self.embedder, self.chat, self.settings = store, embedder, chat, settings

    def loaded(self) -> dict[str, bool]:
        return {"vector": self.store.has("chunks"), "graph": self.store.has("edges", "entity_vectors")}

    def vector_hits(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Queries (query_id, query, query_embedding)."""
        chunks = self.store.read("chunks")
        hits = knn.nearest(chunks, queries, k or self.settings.vector.top_k)
        return knn.with_content(hits, chunks.select("chunk_id", "content", "metadata")).select("query_id", "rank", "chunk_id", "content", "score", "metadata")

    def graph_hits(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """No hits, not an error, without a graph index."""
        if not self.loaded()["graph"]:
            return self.vector_hits(queries.limit(0), k) if self.loaded()["vector"] else _no_hits(queries)
        return retrieval.graph_hits(queries, self.store.read("entity_vectors"), self.store.read("edges"), self.store.read("chunks"), k or self.settings.graph.top_k)

    @observed("retrieve")
    def retrieve(self, questions: DataFrame, method: str = "hybrid", k: int | None = None) -> DataFrame:
        queries = knn.embed(questions, "query", self.embedder, "query_embedding")
        vector = self.vector_hits(queries, k) if method in ("vector", "hybrid") else None
        graph = self.graph_hits(queries, k) if method in ("graph", "hybrid") else None
        return retrieval.retrieve(vector, graph, method)

    @observed("answer")
    def answer(self, questions: DataFrame, method: str = "hybrid", k: int | None = None, max_context: int | None = None) -> DataFrame:
        """query_id, query, answer, context, n_blocks: questions without any hit have the fixed
        answer and don't reach the model."""
        packed = retrieval.pack_context(self.retrieve(questions, method, k), max_context or self.settings.generation.max_context)
        joined = questions.join(packed, "query_id", "left")
        asked = joined.where("n_blocks IS NOT NULL").withColumn("prompt", prompts.few_shot_prompt(F.col("context"), F.col("query")))
        replied = summaries.chat_column(asked, "prompt", self.chat, "answer", prompts.ANSWER_SYSTEM, on_error=None).drop("prompt")
        silent = joined.where("n_blocks IS NULL").withColumn("answer", F.lit(retrieval.NO_ANSWER))
        return replied.unionByName(silent).select("query_id", "query", "answer", "context", "n_blocks")


def _no_hits(queries: DataFrame) -> DataFrame:
    from .. import schemas

    return queries.sparkSession.createDataFrame([], schemas.HIT)


def ask(spark: SparkSession, service: Service, question: str, **options) -> str:
    """One question: the batch with a single row."""
    return service.answer(spark.createDataFrame([("0", question)], "query_id string, query string"), **options).first().answer
