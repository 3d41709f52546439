"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_MAP = T.MapType(_S, _S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


RELATION = _table(ord=T.ArrayType(_L), source=_S, target=_S, relation=_S, description=_S, source_chunk_id=_S)
DOCUMENT = _table(doc_id=_S, content=_S, title=_S, metadata=_MAP)
CHUNK = _table(chunk_id=_S, doc_id=_S, chunk_index=_I, content=_S, start_idx=_I, end_idx=_I, metadata=_MAP)
NODE = _table(key=_S, name=_S, entity_type=_S, description=_S, source_chunk_ids=T.ArrayType(_S), is_entity=T.BooleanType())
EDGE = _table(src_key=_S, dst_key=_S, relations=T.ArrayType(RELATION))
MEMBERSHIP = _table(community_id=_I, level=_I, node_key=_S)
COMMUNITY = _table(community_id=_I, entity_names=T.ArrayType(_S), relation_lines=T.ArrayType(_S), summary=_S)
SAMPLE = _table(query_id=_S, query=_S, answer=_S, query_type=_S, evidence_ids=T.ArrayType(_S), metadata=_MAP)
HIT = _table(query_id=_S, rank=_I, content=_S, score=_D, metadata=_MAP)
CONTEXT = _table(query_id=_S, context=_S, num_chunks=_I)
PREDICTION = _table(query_id=_S, query=_S, ground_truth=_S, prediction=_S, query_type=_S, is_correct=T.BooleanType(), context=_S, method_name=_S)
