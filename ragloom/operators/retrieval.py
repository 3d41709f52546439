"""Retrieval: unions, near-duplicate removal, ranks, contexts, graph searches and mixed methods.

A hit is (query_id, rank, content, score, metadata, source); queries are rows, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import SEPARATOR
from ..functions.text import context_block, pystrip
from .knn import nearest

#: Labels of the two halves of a joined context.
VECTOR_LABEL, GRAPH_LABEL = "[Vector Search Results]\n", "[Graph Search Results]\n"
NO_ANSWER = "There is no information on this in the sources."


def union_hits(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """All hits, with source_ord: vector hits first."""
    first = vector.withColumns({"source": F.lit("vector"), "source_ord": F.lit(0)})
    return first.unionByName(graph.withColumns({"source": F.lit("graph"), "source_ord": F.lit(1)}))


def prefix_key(content: Column, length: int = 200) -> Column:
    return pystrip(F.lower(F.substring(content, 1, length)))


def first_of_prefix(hits: DataFrame, length: int = 200) -> DataFrame:
    """The first hit of each query among those that begin alike, in order of source and rank.

    One struct a group is kept by a partial minimum, so a prefix that very many rows share is
    combined before it is shuffled."""
    rest = [c for c in hits.columns if c not in ("query_id", "source_ord", "rank")]
    first = hits.groupBy("query_id", prefix_key(F.col("content"), length).alias("prefix")).agg(F.min_by(F.struct(*rest), F.struct("source_ord", "rank")).alias("hit"), F.min(F.struct("source_ord", "rank")).alias("at"))
    return first.select("query_id", "at.*", "hit.*")


def ranked(hits: DataFrame) -> DataFrame:
    """With final_rank from 0: higher scores first, then vector hits, then rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source_ord", "rank")
    return hits.withColumn("final_rank", F.row_number().over(order) - 1)


def retrieve(vector: DataFrame | None, graph: DataFrame | None, method: str = "hybrid") -> DataFrame:
    """Hits of a method (vector, graph, hybrid): near duplicates go only from the hybrid, before
    the sort by score; it has up to twice as many hits as either side."""
    if method not in ("vector", "graph", "hybrid"):
        raise ValueError(f"no method {method}")
    if method == "hybrid":
        return ranked(first_of_prefix(union_hits(vector, graph)))
    side = vector if method == "vector" else graph
    return ranked(side.withColumns({"source": F.lit(method), "source_ord": F.lit(0)}))


def pack_context(hits: DataFrame, budget: int = 15000, separator: str = SEPARATOR) -> DataFrame:
    """query_id, context, n_blocks, scores: blocks in rank order up to the first that would pass
    the budget of characters.  Separators are not counted.  If the first block passes it, the
    query has an empty context."""
    blocks = hits.withColumn("block", context_block(F.col("content"), F.col("metadata")))
    so_far = Window.partitionBy("query_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = blocks.withColumn("fits", F.sum(F.length("block")).over(so_far) <= budget)
    kept = F.when(F.col("fits"), F.struct("final_rank", "block", "score"))
    listed = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(kept)).alias("kept"))
    return listed.select("query_id", F.array_join(F.transform("kept", lambda b: b["block"]), separator).alias("context"), F.size("kept").alias("n_blocks"), F.transform("kept", lambda b: b["score"]).alias("scores"))


def joined_context(hits: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """query_id, context (all contents in rank order), num_chunks, scores, chunk_ids."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content", "score"))).alias("h"))
    return listed.select("query_id", F.array_join(F.transform("h", lambda x: x["content"]), separator).alias("context"), F.size("h").alias("num_chunks"), F.transform("h", lambda x: x["score"]).alias("scores"), F.transform("h", lambda x: x["chunk_id"]).alias("chunk_ids"))


def for_all(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row for every query; those without a result have an empty context."""
    return queries.join(found, "query_id", "left").withColumns({"context": F.coalesce("context", F.lit("")), "num_chunks": F.coalesce("num_chunks", F.lit(0))})


def local_search(queries: DataFrame, entities: DataFrame, membership: DataFrame, communities: DataFrame, k: int = 10, separator: str = SEPARATOR) -> DataFrame:
    """query_id, context, num_chunks, matched_entities, matched_community_ids.

    The k most similar entities (node_key, embedding); the communities of any of them, each once;
    their summaries, if not empty, in order of community_id."""
    hits = nearest(entities, queries, k, id_col="node_key")
    matched = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_key"))), lambda x: x["node_key"]).alias("matched_entities"))
    reached = hits.join(membership, "node_key").select("query_id", "community_id").distinct()
    told = reached.join(communities.select("community_id", "summary"), "community_id", "left")
    listed = told.groupBy("query_id").agg(F.array_sort(F.collect_set("community_id")).alias("matched_community_ids"), F.array_sort(F.collect_list(F.when(F.coalesce("summary", F.lit("")) != "", F.struct("community_id", "summary")))).alias("s"))
    out = queries.select("query_id").join(matched, "query_id", "left").join(listed, "query_id", "left")
    return out.select("query_id", F.coalesce(F.array_join(F.transform("s", lambda x: x["summary"]), separator), F.lit("")).alias("context"), F.coalesce(F.size("s"), F.lit(0)).alias("num_chunks"), "matched_entities", "matched_community_ids")


def global_search(communities: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """One row: all summaries that are not empty, in order of community_id.  It is a context for
    one reply, so its size is the caller's concern."""
    told = communities.where("summary <> ''")
    return told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community_id", "summary"))), lambda x: x["summary"]), separator).alias("context"), F.count("*").cast("int").alias("num_chunks"))


def global_for(queries: DataFrame, communities: DataFrame) -> DataFrame:
    """The same context for every query; worked out once (one row)."""
    return queries.select("query_id").crossJoin(F.broadcast(global_search(communities)))


def integrate(queries: DataFrame, vector: DataFrame, graph: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """Both contexts under their labels; an empty side is left out; num_chunks are added."""
    v = vector.select("query_id", F.col("context").alias("vc"), F.col("num_chunks").alias("vn"))
    g = graph.select("query_id", F.col("context").alias("gc"), F.col("num_chunks").alias("gn"))
    both = queries.select("query_id").join(v, "query_id", "left").join(g, "query_id", "left")
    side = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return both.select("query_id", F.concat_ws(separator, side(VECTOR_LABEL, F.col("vc")), side(GRAPH_LABEL, F.col("gc"))).alias("context"), (F.coalesce("vn", F.lit(0)) + F.coalesce("gn", F.lit(0))).alias("num_chunks"))


def query_class(reply: Column) -> Column:
    return F.when(F.contains(F.lower(reply), F.lit("reasoning")), F.lit("reasoning-based")).otherwise(F.lit("fact-based"))


def select_side(classified: DataFrame, vector: DataFrame, graph: DataFrame) -> DataFrame:
    """query_id, context, num_chunks, query_classification, selected_retriever: facts from the
    vector side, reasoning from the graph side."""
    fact, reason = (classified.where(F.col("query_classification") == c).select("query_id", "query_classification") for c in ("fact-based", "reasoning-based"))
    take = lambda rows, side, name: rows.join(side.select("query_id", "context", "num_chunks"), "query_id", "left").withColumn("selected_retriever", F.lit(name))
    out = take(fact, vector, "vector").unionByName(take(reason, graph, "graph"))
    return out.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), "query_classification", "selected_retriever")


def graph_hits(queries: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, chunk_id, content, score, metadata: chunks that tell of a relation of one of
    the k nearest entities, the best entity's first."""
    hits = nearest(entities, queries, k, id_col="node_key")
    ends = edges.select("src_key", "dst_key", F.explode("relations").alias("r")).select(F.explode(F.array_distinct(F.array("src_key", "dst_key"))).alias("node_key"), F.col("r.source_chunk_id").alias("chunk_id"))
    found = hits.join(ends.where("chunk_id IS NOT NULL").distinct(), "node_key").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return best.join(chunks.select("chunk_id", "content", "metadata"), "chunk_id").select("query_id", "rank", "chunk_id", "content", "score", "metadata")
