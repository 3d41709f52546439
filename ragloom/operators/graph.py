"""Knowledge-graph tables: extraction, merging of entities and relations, look-ups.

nodes: key, name, entity_type, description, source_chunk_ids, is_entity
edges: src_key <= dst_key, relations (source, target, relation, description, source_chunk_id) in order
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import node_key, pystrip
from ..providers import Chat
from ..shared import apart

EXTRACT_SCHEMA = (
    "chunk_id string, ord long, status string, entities array<struct<name: string, entity_type: string, description: string>>, "
    "relations array<struct<source: string, target: string, relation: string, description: string>>"
)


def _text(value: object, fallback: str) -> str:
    return fallback if value is None else str(value).strip()


def parse_reply(reply: str | None) -> tuple[str, list[tuple], list[tuple]]:
    """(status, entities, relations) of an extraction reply.

    From the first to the last brace it must be one JSON object, strictly; elements that are no
    objects, entities without a name and relations without both ends are dropped."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    try:
        data = json.loads(found[0]) if found else None
    except ValueError:
        data = None
    if not isinstance(data, dict):
        return "failed", [], []
    objects = lambda key: [x for x in data.get(key) or [] if isinstance(x, dict)] if isinstance(data.get(key) or [], list) else []
    entities = [(_text(e.get("entity_name"), ""), _text(e.get("entity_type"), "Unknown"), _text(e.get("entity_description"), "")) for e in objects("entities")]
    relations = [(_text(r.get("source_entity"), ""), _text(r.get("target_entity"), ""), _text(r.get("relation"), "RELATED_TO"), _text(r.get("relationship_description"), "")) for r in objects("relationships")]
    entities, relations = [e for e in entities if e[0]], [r for r in relations if r[0] and r[1]]
    return ("ok" if entities or relations else "empty"), entities, relations


def extract(chunks: DataFrame, chat: Chat, limit: int = 10, max_tokens: int = 2048) -> DataFrame:
    """One row a chunk: what a model reads from it.  `chunks` has chunk_id, ord, content; a failed
    call gives status failed and no rows.  Write the result before it is used twice: each
    evaluation asks the model again."""
    asked = chunks.select("chunk_id", F.col("ord").cast("long"), prompts.extraction_prompt(F.coalesce("content", F.lit("")), limit).alias("prompt"))

    def run(batches):
        import pyarrow as pa

        entity = pa.struct([(n, pa.string()) for n in ("name", "entity_type", "description")])
        relation = pa.struct([(n, pa.string()) for n in ("source", "target", "relation", "description")])
        for batch in batches:
            out = []
            for chunk_id, ord_, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    status, entities, relations = parse_reply(chat.reply(prompt, prompts.EXTRACT_SYSTEM, max_tokens))
                except Exception:  # noqa: BLE001  whatever a provider raises counts as a failure of this chunk
                    status, entities, relations = "failed", [], []
                named = lambda rows, kind: [dict(zip([f.name for f in kind], r, strict=True)) for r in rows]
                out.append((chunk_id, ord_, status, named(entities, entity), named(relations, relation)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(entity), pa.list_(relation)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk_id", "ord", "status", "entities", "relations"])

    return asked.mapInArrow(run, EXTRACT_SCHEMA)


def extraction_counts(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "failed").alias("failed"))


def entity_rows(extracted: DataFrame) -> DataFrame:
    """name, entity_type, description, source_chunk_id, ord (array: order of chunk, then place)."""
    one = extracted.select("chunk_id", "ord", F.posexplode("entities").alias("pos", "e"))
    return one.select("e.*", F.col("chunk_id").alias("source_chunk_id"), F.array("ord", F.col("pos").cast("long")).alias("ord"))


def relation_rows(extracted: DataFrame) -> DataFrame:
    one = extracted.select("chunk_id", "ord", F.posexplode("relations").alias("pos", "r"))
    return one.select("r.*", F.col("chunk_id").alias("source_chunk_id"), F.array("ord", F.col("pos").cast("long")).alias("ord"))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, name (the first), mentions, documents of each capitalised word; counted before it is
    shuffled."""
    names = F.regexp_extract_all(text_col, F.lit(r"(\p{Lu}\p{L}+)"))
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(names).alias("pos", "name")).withColumn("key", node_key(F.col("name")))
    each = rows.groupBy("key", "doc").agg(F.min(F.struct("doc", "pos", "name")).alias("first"), F.count("*").alias("n"))
    return each.groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("mentions"), F.count("*").alias("documents")).select("key", "first.name", "mentions", "documents")


def merge_entities(rows: DataFrame) -> DataFrame:
    """One node a key, in order of `ord`: the first name and type; the descriptions one after the
    other, each unless it is part of what stands there; the chunk ids in order of first mention.

    Names and types are partial minima.  Descriptions and chunk ids are each made distinct, with
    their first places, before a key's are gathered, so a key that very many chunks mention is
    one row of what differs only, as a node holds it."""
    named = rows.withColumn("name", pystrip(F.col("name"))).where("name <> ''").withColumn("key", node_key(F.col("name")))
    first = named.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.min_by("entity_type", "ord").alias("entity_type"))
    once = lambda col, wanted: named.where(wanted).groupBy("key", col).agg(F.min("ord").alias("ord")).groupBy("key")
    listed = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("ord", col))), lambda x: x[col])
    told = once("description", F.coalesce("description", F.lit("")) != "").agg(listed("description").alias("told"))
    chunks = once("source_chunk_id", F.col("source_chunk_id").isNotNull()).agg(listed("source_chunk_id").alias("source_chunk_ids"))
    fold = lambda acc, d: F.when(F.contains(acc, d), acc).when(acc == "", d).otherwise(F.concat(acc, F.lit(" "), d))
    empty = F.expr("cast(array() as array<string>)")
    joined = first.join(apart(told), "key", "left").join(apart(chunks), "key", "left")
    return joined.select("key", "name", "entity_type", F.aggregate(F.coalesce("told", empty), F.lit(""), fold).alias("description"), F.coalesce("source_chunk_ids", empty).alias("source_chunk_ids"), F.lit(True).alias("is_entity"))


def merge_relations(rows: DataFrame) -> DataFrame:
    """One edge for each unordered pair of keys; every relation is kept, with its direction.  All
    relations of one pair are one row, as an edge is defined: that bounds a pair's relations."""
    relation = F.struct("ord", "source", "target", "relation", "description", "source_chunk_id")
    return _ends(rows).groupBy("src_key", "dst_key").agg(F.array_sort(F.collect_list(relation)).alias("relations"))


def edge_counts(rows: DataFrame) -> DataFrame:
    """src_key, dst_key, n_relations, first (the least `ord`) of each unordered pair: partial sums
    and minima, where the relations themselves aren't wanted."""
    return _ends(rows).groupBy("src_key", "dst_key").agg(F.count("*").alias("n_relations"), F.min("ord").alias("first"))


def _ends(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumns({"a": node_key(F.col("source")), "b": node_key(F.col("target"))}).where("a <> '' AND b <> ''")
    return keyed.withColumns({"src_key": F.least("a", "b"), "dst_key": F.greatest("a", "b")})


def with_implicit_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and those that only edges mention, of type Unknown and shown by their keys."""
    ends = edges.select(F.col("src_key").alias("key")).union(edges.select("dst_key")).distinct()
    missing = ends.join(apart(nodes), "key", "left_anti")
    empty = F.expr("cast(array() as array<string>)")
    return nodes.unionByName(missing.select("key", F.col("key").alias("name"), F.lit("Unknown").alias("entity_type"), F.lit("").alias("description"), empty.alias("source_chunk_ids"), F.lit(False).alias("is_entity")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = nodes.agg(F.count_if("is_entity").alias("entities"), F.count("*").alias("nodes"))
    return counted.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def both_ways(edges: DataFrame) -> DataFrame:
    """node, neighbour: each edge from either end; a self-loop once."""
    return edges.select(F.col("src_key").alias("node"), F.col("dst_key").alias("neighbour")).union(edges.select("dst_key", "src_key")).distinct()


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    return both_ways(edges).join(wanted.select("node").distinct(), "node", "left_semi")


def edge_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where((F.col("src_key") == min(a, b)) & (F.col("dst_key") == max(a, b)))


def triplets(relations: DataFrame, limit: int | None = None) -> DataFrame:
    """subject, relation, object in order; the first `limit`."""
    rows = relations.orderBy("ord", "source", "target", "relation")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(F.col("source").alias("subject"), "relation", F.col("target").alias("object"))


def graph_data(relations: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, ord; edges: source, relation, target) of the first `limit` relations, for display."""
    first = relations.orderBy("ord", "source", "target", "relation").limit(limit)
    ends = first.select("ord", F.posexplode(F.array("source", "target")).alias("pos", "id"))
    nodes = ends.groupBy("id").agg(F.min(F.struct("ord", "pos")).alias("seen"))
    order = Window.orderBy("seen")  # at most two rows a relation of the limit
    return nodes.select("id", (F.row_number().over(order) - 1).alias("ord")), first.select("source", "relation", "target")
