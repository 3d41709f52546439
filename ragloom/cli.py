"""Command line: index, status, serve, ask, benchmark."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import config
from .shared import written
from .plans import benchmark, indexing
from .plans.service import Service, ask
from .providers import HashedEmbedder, HttpChat, HttpEmbedder, OfflineChat
from .sources import documents
from .sources.index_store import IndexStore


def providers(settings: config.Settings):
    """(embedder, chat): offline stand-ins unless the settings name models."""
    e, c = settings.embedding, settings.llm
    embedder = HashedEmbedder(e.dimension) if e.model == "offline" else HttpEmbedder(e.base_url or c.endpoint(), e.model, c.key(), dimension=e.dimension, batch=e.batch)
    chat = OfflineChat() if c.model == "offline" else HttpChat(c.endpoint(), c.model, c.key(), c.timeout, c.attempts, c.temperature, c.max_tokens or 512)
    return embedder, chat


def serve(service: Service, host: str, port: int) -> int:
    """Until it is stopped."""
    try:
        import uvicorn

        from .api import create_app

        app = create_app(service.store.spark, service)
    except ImportError as e:
        print(f"serve needs fastapi and uvicorn: {e}", file=sys.stderr)
        return 1
    uvicorn.run(app, host=host, port=port)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ragloom")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("-i", "--input", required=True)
    index.add_argument("-o", "--output", required=True)
    index.add_argument("-t", "--type", choices=("vector", "graph", "all"), default="all")
    status = commands.add_parser("status")
    status.add_argument("-o", "--output", required=True)
    server = commands.add_parser("serve")
    server.add_argument("-o", "--output", required=True)
    server.add_argument("--host", default="127.0.0.1")
    server.add_argument("--port", type=int, default=8000)
    question = commands.add_parser("ask")
    question.add_argument("-o", "--output", required=True)
    question.add_argument("-m", "--method", choices=("vector", "graph", "hybrid"), default="hybrid")
    question.add_argument("question")
    compare = commands.add_parser("benchmark")
    compare.add_argument("--samples", required=True)
    compare.add_argument("--corpus", required=True)
    compare.add_argument("--methods", nargs="+", choices=config.METHODS)
    compare.add_argument("--max-samples", type=int, default=0)
    compare.add_argument("--output-dir", default="results")
    compare.add_argument("--no-cache", action="store_true", help="build the vector index anew")
    compare.add_argument("--force-rebuild", action="store_true", help="build both indexes anew")
    for p in (index, status, server, question, compare):
        p.add_argument("-c", "--config")
    options = parser.parse_args(args)
    base = config.Settings() if options.command == "benchmark" else config.SERVICE
    settings = config.load(options.config, base) if options.config else base
    spark = SparkSession.builder.appName("ragloom").getOrCreate()
    embedder, chat = providers(settings)
    if options.command == "index":
        try:
            docs = written(documents.documents_from_dir(spark, options.input))
        except Exception as e:  # noqa: BLE001
            print(f"can't read {options.input}: {e}", file=sys.stderr)
            return 1
        if docs.isEmpty():
            print("no documents", file=sys.stderr)
            return 1
        store = IndexStore(spark, options.output)
        chunks = written(indexing.chunked(docs, settings, markdown=True))
        if options.type in ("vector", "all"):
            indexing.index_vectors(store, chunks, embedder)
        if options.type in ("graph", "all"):
            indexing.build_graph_cached(store, chunks, chat, embedder, settings)
        store.folder.write_json("metadata.json", {"document_count": docs.count(), "index_types": options.type})
        return 0
    if options.command == "status":
        print(json.dumps(indexing.status(spark, options.output)))
        return 0
    if options.command == "serve":
        return serve(Service(IndexStore(spark, options.output), embedder, chat, settings), options.host, options.port)
    if options.command == "ask":
        print(ask(spark, Service(IndexStore(spark, options.output), embedder, chat, settings), options.question, method=options.method))
        return 0
    import dataclasses

    settings = dataclasses.replace(settings, methods=tuple(options.methods or settings.methods), output_dir=options.output_dir)
    samples = written(documents.samples_from_json(spark, options.samples, options.max_samples or settings.evaluation.max_samples))
    benchmark.run(samples, documents.news_corpus_from_json(spark, options.corpus), IndexStore(spark, f"{options.output_dir}/index"), embedder, chat, settings, rebuild=options.force_rebuild, cache=not options.no_cache)
    return 0


if __name__ == "__main__":
    sys.exit(main())
