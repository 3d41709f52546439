"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RESULT_SCHEMA = "query_id long, vec_id long, score long"
_EXACT = 2.0**52


def finite(embedding: Column) -> Column:
    """Not null and all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def search_block(np, queries, columns, k: int, floor, step: int = 16):
    """(query rows, candidate columns, scores) of all that may be among a query's k best.

    queries: (q, d) whole numbers; columns: (d, n), a row for each dimension; floor: (q,), scores
    below which nothing counts.  After each block of dimensions a pair's score lies within the
    product of the norms of what remains; the k-th best lower end so far raises the floor; pairs
    whose upper end is below it go, and columns without any pair are compacted away.  When few
    pairs are left, they are finished one by one instead of as a matrix.
    """
    q, d = queries.shape
    n = columns.shape[1]
    left = np.sqrt(np.cumsum((queries**2)[:, ::-1], axis=1)[:, ::-1])  # norms of dimensions from i on
    right = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1])
    at, total, floor = np.arange(n), np.zeros((q, n)), floor.copy()
    for lo in range(0, d, step):
        hi = min(lo + step, d)
        total += queries[:, lo:hi] @ columns[lo:hi]
        if hi == d:
            break
        slack = left[:, hi, None] * right[None, hi] * (1 + 1e-9) + 1e-6
        if total.shape[1] > k:
            floor = np.maximum(floor, np.partition(total - slack, -k, axis=1)[:, -k])
        alive = total + slack >= floor[:, None]
        used = alive.any(axis=0)
        if alive.mean() < 0.05:
            i, j = np.nonzero(alive)
            score = total[i, j]
            for s in range(0, len(i), 1 << 16):
                part = slice(s, s + (1 << 16))
                score[part] += np.einsum("pd,dp->p", queries[i[part], hi:], columns[hi:, j[part]])
            good = score >= floor[i]
            return i[good], at[j[good]], score[good]
        if used.mean() < 0.8:
            at, total, columns, right = at[used], total[:, used], columns[:, used], right[:, used]
    if total.shape[1] > k:
        floor = np.maximum(floor, np.partition(total, -k, axis=1)[:, -k])
    i, j = np.nonzero(total >= floor[:, None])
    return i, at[j], total[i, j]


def best(np, i, ids, scores, k: int):
    """Positions of each query's k best: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 64, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows but the query's own.

    Components become floor(scale * x); scores are whole numbers, and exact.  Queries are written
    to the shared folder and read by each task in blocks, so neither side has to fit anywhere;
    every task holds its partition of candidates, a row for each dimension.  Each task gives k
    rows a query; a window keeps the best of those.

    Null vectors and those with null or non-finite components take no part; vectors of another
    length aren't candidates.  Rows with a query's id aren't its candidates; equal query rows are one
    query, and of different ones with one id the best of both count.  Ties go to the
    smaller id; rows with null ids come first among equals.  Scores beyond 64 bits are clamped.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).where(finite(F.col("e")))
    folder = common.fresh_path(spark, "queries")
    common.make_dirs(folder)

    def arrays(batch):
        """(dimension, ids, whole-number components, null ids) for each length in the batch."""
        import numpy as np
        import pyarrow.compute as pc

        lengths = pc.list_value_length(batch.column(1))
        for dim in pc.unique(lengths).to_pylist():
            part = batch.filter(pc.equal(lengths, dim))
            ids = part.column(0)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield dim, ids.fill_null(-(1 << 63)).to_numpy(), np.floor(scale * flat).reshape(len(ids), dim)

    def save(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        files, task = [], TaskContext.get().partitionId()
        for b, batch in enumerate(batches):
            for dim, ids, x in arrays(batch):
                name = f"{task:06d}-{b:06d}-{dim}.npy"
                with common.writing(f"{folder}/{name}") as f:
                    f.write(np.column_stack([ids.view(np.float64), x]).tobytes())
                files.append((name, dim, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*files, strict=True)) or [()] * 3, [pa.string(), pa.int32(), pa.int64()], strict=True)], ["name", "dim", "n"])

    # Each query once, and in order, so that a task that runs again writes the same files; a row for
    # each Arrow batch of queries comes to the driver.
    asked = rows.where(is_query).distinct().sortWithinPartitions("vec_id", "e")
    files = [tuple(r) for r in asked.mapInArrow(save, "name string, dim int, n long").orderBy("name").collect()]

    def search(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for dim, ids, x in arrays(batch):
                held.setdefault(dim, []).append((ids, x.T.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x.T))
        for dim, parts in held.items():
            ids, columns = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
            held[dim] = None
            for name, of_dim, n in files:
                if of_dim != dim:
                    continue
                stored = common.mapped(f"{folder}/{name}", "<f8").reshape(n, dim + 1)
                for lo in range(0, n, query_block):
                    own, queries = stored[lo : lo + query_block, 0].copy().view(np.int64), stored[lo : lo + query_block, 1:].copy()
                    i, c, s = _search(np, own, queries, ids, columns, k, block)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[c], mask=ids[c] == -(1 << 63)), pa.array(s)], ["query_id", "vec_id", "score"])

    found = rows.repartition(common.tasks(rows)).mapInArrow(search, RESULT_SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(np, own, queries, ids, columns, k: int, block: int):
    """Best k of all candidate blocks for one block of queries: (query row, candidate, score)."""
    kept_i, kept_c, kept_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = np.full(len(own), -np.inf)
    for lo in range(0, columns.shape[1], block):
        part = columns[:, lo : lo + block].astype(np.float64)
        if np.abs(queries).max(initial=0) * np.abs(part).max(initial=0) * max(1, len(part)) < _EXACT:
            # A query's own rows may take places, so one more is sought for each of them.
            more = int(np.isin(ids[lo : lo + block], own).sum())
            i, c, s = search_block(np, queries, part, k + more, floor)
            s = s.astype(np.int64)
        else:  # beyond doubles' whole numbers: Python's, clamped to 64 bits
            whole = lambda x: np.vectorize(int, otypes=[object])(x)
            s = np.clip(whole(queries) @ whole(part), -(1 << 63), (1 << 63) - 1).astype(np.int64)
            i, c = (x.ravel() for x in np.indices(s.shape))
            s = s.ravel()
        other = ids[lo + c] != own[i]
        kept_i, kept_c, kept_s = np.concatenate([kept_i, i[other]]), np.concatenate([kept_c, lo + c[other]]), np.concatenate([kept_s, s[other]])
        top = best(np, kept_i, ids[kept_c], kept_s, k)
        kept_i, kept_c, kept_s = kept_i[top], kept_c[top], kept_s[top]
        full = np.flatnonzero(np.bincount(kept_i, minlength=len(own)) == k)
        worst = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(worst, kept_i, kept_s)
        floor[full] = worst[full]
    return kept_i, kept_c, kept_s


def oracle(k: int, scale: int, query: str, table: str = "embeddings") -> str:
    """top_k in DuckDB's SQL; `query` is a condition on the row q."""
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE {query})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""
