"""Embedding of texts and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..providers import Embedder

#: Queries that a task holds at once: at most so many rows of one vector each.
QUERY_BLOCK = 4096


def embed(df: DataFrame, text_col: str, provider: Embedder, out: str = "embedding", batch: int = 100) -> DataFrame:
    """df with the embeddings of a text column; null texts are embedded as empty ones."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = provider.embed([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, out])

    return df.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_embedding", digits: int = 6) -> DataFrame:
    """query_id, rank (from 0), id, score: the k most similar vectors by cosine, ties to the
    smaller id.

    Queries are written to the shared folder in files of QUERY_BLOCK rows at most; each task reads
    its vectors once, holds them, and takes the files one after the other, so neither side has to
    fit anywhere else.  A task gives k rows a query, a window over those finds the best.  Scores are
    rounded, then compared.  Zero vectors score 0; null vectors take no part; a vector of another
    length is an error.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).cast("array<double>").alias("v"))
    slim = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type, query_type = slim.schema["id"].dataType.simpleString(), asked.schema[query_id].dataType.simpleString()
    path = shared.fresh_path(queries.sparkSession, "queries")
    block = QUERY_BLOCK

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, names = TaskContext.get().partitionId(), []
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                sink = pa.BufferOutputStream()
                part = pa.Table.from_batches([batch.slice(lo, block)])
                with pa.ipc.new_file(sink, part.schema) as out:
                    out.write_table(part)
                names.append(f"{task:06d}-{len(names):06d}.arrow")
                with shared.saving(f"{path}/{names[-1]}") as f:
                    f.write(sink.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    # A name for each block of queries comes to the driver; a task that runs again writes them anew.
    names = sorted(r.name for r in asked.sortWithinPartitions(query_id).mapInArrow(save, "name string").collect())
    found = slim.mapInArrow(_scan(path, names, k, digits), f"query_id {query_type}, id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def _scan(path: str, names: list[str], k: int, digits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(column):
            n = len(column)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            size = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

        held = [(b.column(0), unit(b.column(1))) for b in batches if b.num_rows and names]
        for name in names if held else ():
            rows = pa.ipc.open_file(pa.py_buffer(shared.load(f"{path}/{name}"))).read_all()
            queries = unit(rows.column(1).combine_chunks())
            kept_q, kept_id, kept_s = [], [], []
            for ids, vectors in held:
                for lo in range(0, len(ids), 4096):
                    v = vectors[lo : lo + 4096]
                    if v.shape[1] != queries.shape[1]:
                        raise ValueError(f"vectors have {v.shape[1]} dimensions, queries {queries.shape[1]}")
                    score = np.round(queries @ v.T, digits) + 0.0
                    if score.shape[1] > k:
                        floor = np.partition(score, -k, axis=1)[:, -k]
                        q, c = np.nonzero(score >= floor[:, None])
                    else:
                        q, c = (x.ravel() for x in np.indices(score.shape))
                    kept_q.append(q)
                    kept_s.append(score[q, c])
                    kept_id.append(ids.take(pa.array(lo + c)))
                    if sum(map(len, kept_q)) > 8 * k * len(queries) + 100_000:
                        kept_q, kept_id, kept_s = _best(np, pa, kept_q, kept_id, kept_s, k)
            q, ids, s = (x[0] for x in _best(np, pa, kept_q, kept_id, kept_s, k))
            yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().take(pa.array(q)), ids, pa.array(s)], ["query_id", "id", "score"])

    return run


def _best(np, pa, q, ids, s, k: int):
    import pyarrow.compute as pc

    q, s, ids = np.concatenate(q), np.concatenate(s), pa.concat_arrays(ids)
    order = pc.sort_indices(pa.table({"q": q, "s": s, "id": ids}), [("q", "ascending"), ("s", "descending"), ("id", "ascending")]).to_numpy()
    ranked = q[order]
    top = order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]
    return [q[top]], [ids.take(pa.array(top))], [s[top]]


def with_content(hits: DataFrame, chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Hits with their chunks' rows; those not among the chunks take content from `stored`
    (chunk_id, stored_content) if that is given."""
    out = hits.join(chunks, "chunk_id", "left")
    if stored is None:
        return out
    return out.join(stored.select("chunk_id", "stored_content"), "chunk_id", "left").withColumn("content", F.coalesce("content", "stored_content")).drop("stored_content")
