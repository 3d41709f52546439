"""HTTP façade of the service: /health, /status, /query, /graph/data.  Needs fastapi, which is
imported only here."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import shortened
from .operators import graph
from .plans import indexing
from .plans.service import Service

METHODS = ("vector", "graph", "hybrid")


def checked(body: dict) -> dict:
    """The request's fields: query, method (hybrid), top_k, max_context."""
    if not isinstance(body.get("query"), str) or not body["query"].strip():
        raise ValueError("query must be a text")
    if body.get("method", "hybrid") not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    return {"query": body["query"], "method": body.get("method", "hybrid"), "k": body.get("top_k"), "max_context": body.get("max_context")}


def query(spark: SparkSession, service: Service, body: dict) -> dict:
    """Answer and its sources, their contents cut to 500 code points."""
    given = checked(body)
    questions = spark.createDataFrame([("0", given["query"])], "query_id string, query string")
    reply = service.answer(questions, given["method"], given["k"], given["max_context"]).first()
    hits = service.retrieve(questions, given["method"], given["k"]).orderBy("final_rank").limit(max(reply.n_blocks or 0, 0))
    sources = hits.select(shortened(F.col("content"), 500).alias("content"), "score", "source", "metadata").collect()  # the blocks of one context
    return {"answer": reply.answer, "query": given["query"], "method": given["method"], "sources": [s.asDict() for s in sources]}


def graph_data(service: Service, limit: int = 100) -> dict:
    """Empty without a graph index."""
    if not service.store.has("relations"):
        return {"nodes": [], "edges": []}
    nodes, edges = graph.graph_data(service.store.read("relations"), limit)
    return {"nodes": [{"id": r.id, "label": r.id} for r in nodes.orderBy("ord").collect()], "edges": [r.asDict() for r in edges.collect()]}  # at most `limit` relations


def create_app(spark: SparkSession, service: Service):
    from fastapi import FastAPI, HTTPException

    app = FastAPI()

    @app.get("/health")
    def health() -> dict:
        return {"status": "ok"}

    @app.get("/status")
    def status() -> dict:
        return indexing.status(spark, service.store.folder.path)

    @app.post("/query")
    def post_query(body: dict) -> dict:
        if not any(service.loaded().values()):
            raise HTTPException(503, "no index")
        try:
            return query(spark, service, body)
        except ValueError as e:
            raise HTTPException(422, str(e)) from e

    @app.get("/graph/data")
    def data(limit: int = 100) -> dict:
        return graph_data(service, limit)

    return app
