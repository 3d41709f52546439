"""Embedding near-duplicates: p-stable hashing in several tables, then exact cosine checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import connected_components

LINK_SCHEMA = "node long, links long, root long"
TABLE_BITS = 8
#: Further projections in a byte each; the 0.99999 quantile of the mean of that many chi-square numbers.
PROBES, PROBE_WIDTH, PROBE_REACH = 24, 0.05, 2.8


def usable(embedding: Column) -> Column:
    """Not null, with some nonzero component, all of them finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def hashes(np, unit, tables: int, projections: int, width: float, seed: int):
    """(n, tables) of 32-bit bucket keys: floor((a . v + b) / width) for each projection, mixed."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions, shift = rng.normal(size=(dim, tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ directions + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    key = np.full((len(unit), tables), dim, np.uint64)
    for p in range(projections):
        key = (key ^ cells[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32)


def _unit(np, column):
    """Rows of one list column of one length at unit length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int = 24, projections: int = 8, width: float = 1.5, seed: int = 3, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Equal vectors are one node, with a count, before anything else.  A pair is found if some table
    has both in one bucket, and linked if its cosine, in double precision, reaches the threshold; it
    counts in the first table that has it.  Numbers meet in the buckets first, each with a few
    more projections in a byte each; only vectors that have another in their bucket that these do
    not put far away (a linked pair is lost by them in one case of 100,000) travel there.  A bucket is compared inside one task by matrix products;
    what leaves the task is a row for each vector: links found and its root among them.  Buckets of
    more than `block` vectors are cut into parts of that size and every two parts compared, in tasks
    of their own.  The defaults find a pair at cosine 0.9 with probability 0.94, at 0.95 with 0.99.

    Null or zero vectors and those with null or non-finite components have no links and stand for
    themselves.  Vectors of different lengths are never linked.  Rows with equal ids are each one,
    and linked only by their own vectors.  A null id has no links and a null component.
    """
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("e"))
    ok = rows.where(usable(F.col("e")) & F.col("vec_id").isNotNull())
    distinct = ok.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    width_of = dict(tables=tables, projections=projections, width=width, seed=seed)

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for dim in pc.unique(pc.list_value_length(batch.column(0))).to_pylist():
                same = batch.filter(pc.equal(pc.list_value_length(batch.column(0)), dim))
                for lo in range(0, same.num_rows, 1000):
                    part = same.slice(lo, 1000)
                    unit = _unit(np, part.column(0))
                    keys = hashes(np, unit, **width_of).view(np.int32)
                    sig = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                    probe = pa.array([x.tobytes() for x in probes(np, unit, seed)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, sig, probe], ["e", "rep", "copies", "sig", "probe"])

    nodes = distinct.mapInArrow(sign, f"e {kind}, rep long, copies long, sig array<int>, probe binary")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # hashed and numbered once
    # A bucket's number: the vectors' length, 8 bits of the table, 32 of the hash.
    slot = nodes.select("node", "probe", F.size("e").cast("long").alias("dim"), F.posexplode("sig").alias("tab", "key"))
    keyed = slot.select("node", "probe", F.expr(f"(dim << {TABLE_BITS + 32}) | (cast(tab as bigint) << 32) | (cast(key as bigint) & 4294967295)").alias("bucket"))
    hot = keyed.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    placed = keyed.join(materialise(hot, "hot"), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    run = ["bucket", "lo", "hi"]
    placed = placed.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "probe")
    near = placed.repartition(*run).sortWithinPartitions(*run).mapInArrow(_runs(_near(threshold)), "bucket long, lo int, hi int, own int, node long")
    dealt = near.join(nodes.select("node", "copies", "sig", "e"), "node").repartition(*run).sortWithinPartitions(*run)
    found = dealt.select(*run, "own", "node", "copies", "sig", "e").mapInArrow(_runs(_compare(threshold)), LINK_SCHEMA)
    found = found.groupBy("node").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots"))  # one root a table at most, and part
    found = materialise(found, "links")
    component = connected_components(found.select(F.col("node").alias("a"), F.explode("roots").alias("b")))
    slim = nodes.select("node", "rep", "copies")
    smallest = component.join(slim, "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    told = slim.join(found.select("node", "links"), "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = told.join(smallest, "component", "left")
    told = told.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component_id"))
    key = F.when(usable(F.col("e")) & F.col("vec_id").isNotNull(), F.col("e"))
    out = rows.select("vec_id", key.alias("k")).join(nodes.select(F.col("e").alias("g"), "node"), F.col("k") == F.col("g"), "left").select("vec_id", "node")
    out = out.join(told, "node", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def probes(np, unit, seed: int):
    """(n, PROBES) of int8: further projections of each vector, in cells of PROBE_WIDTH."""
    directions = np.random.default_rng([seed, unit.shape[1], PROBES]).normal(size=(unit.shape[1], PROBES))
    return np.clip(np.rint(unit @ directions / PROBE_WIDTH), -127, 127).astype(np.int8)


def _runs(of):
    """of(table, starts) for the rows of whole runs of equal (bucket, lo, hi), in sorted batches."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            keys = np.column_stack([table.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            yield from of(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])  # may go on in the next batch
        if rest is not None:
            yield from of(rest, np.zeros(1, np.int64))

    return run


def _shared(np, pa, table, starts):
    """(table, sizes, starts) of the runs of more than one row."""
    sizes = np.diff(np.r_[starts, table.num_rows])
    table = table.filter(pa.array(np.repeat(sizes > 1, sizes))).combine_chunks()
    sizes = sizes[sizes > 1]
    return table, sizes, np.cumsum(sizes) - sizes


def _sides(np, rows, lo, hi, own):
    """The two sides of a run's pairs, and whether they are one."""
    one = lo[rows[0]] == hi[rows[0]]
    return (rows, rows, True) if one else (rows[own[rows] == lo[rows[0]]], rows[own[rows] == hi[rows[0]]], False)


def _near(threshold: float, small: int = 64):
    """The rows that have another in their run no farther, by their probes, than linked ones are.

    PROBES squared differences of projections add up to the squared distance times a chi-square
    number; PROBE_REACH is what that exceeds in one case of 100,000."""

    def near(table, starts):
        import numpy as np
        import pyarrow as pa

        table, sizes, starts = _shared(np, pa, table, starts)
        if not table.num_rows:
            return
        reach = (((2 - 2 * threshold) * PROBES * PROBE_REACH) ** 0.5 / PROBE_WIDTH + PROBES**0.5) ** 2  # cells are rounded
        lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
        x = np.frombuffer(b"".join(table.column("probe").to_pylist()), np.int8).reshape(table.num_rows, PROBES).astype(np.float32)
        square, keep = (x * x).sum(1), np.zeros(len(x), bool)
        plain = (sizes <= small) & (lo[starts] == hi[starts])
        for size in np.unique(sizes[plain]).tolist():
            at = starts[plain & (sizes == size)]
            for s in range(0, len(at), max(1, 400_000 // (size * size))):
                rows = at[s : s + max(1, 400_000 // (size * size)), None] + np.arange(size)
                v = x[rows]
                apart = square[rows][:, :, None] + square[rows][:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
                apart[:, np.arange(size), np.arange(size)] = np.inf
                keep[rows] = (apart <= reach).any(axis=2)
        for k in np.flatnonzero(~plain):
            left, right, one = _sides(np, np.arange(starts[k], starts[k] + sizes[k]), lo, hi, own)
            for s in range(0, len(left), 256):
                part = left[s : s + 256]
                close = square[part][:, None] + square[right][None, :] - 2 * (x[part] @ x[right].T) <= reach
                if one:
                    close[np.arange(len(part)), np.arange(s, s + len(part))] = False
                keep[part] |= close.any(axis=1)
                keep[right] |= close.any(axis=0)
        kept = table.filter(pa.array(keep)).select(["bucket", "lo", "hi", "own", "node"])
        yield from kept.combine_chunks().to_batches()

    return near


def _compare(threshold: float, small: int = 64):
    """Links and roots of the vectors of each run."""

    def links(table, starts):
        import numpy as np
        import pyarrow as pa

        table, sizes, starts = _shared(np, pa, table, starts)
        if not table.num_rows:
            return
        bucket, lo, hi, own, node, copies = (table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "own", "node", "copies"))
        tab = bucket >> 32 & (1 << TABLE_BITS) - 1
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        unit, e = {}, table.column("e").combine_chunks()
        lengths = np.diff(e.offsets.to_numpy())
        slot = np.zeros(len(node), np.int64)
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            unit[dim], slot[rows] = _unit(np, e.take(pa.array(rows))), np.arange(len(rows))
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        order = np.lexsort((node, np.repeat(starts, sizes)))  # within a run smaller nodes are roots
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))

        def found(i, j):
            """Pairs of row numbers at or above the threshold; those of earlier tables don't count."""
            if not len(i):
                return
            new = np.ones(len(i), bool)
            for s in range(0, len(i), 1 << 15):
                a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                new[s : s + (1 << 15)] = ~((sig[a] == sig[b]) & (np.arange(sig.shape[1]) < tab[a][:, None])).any(axis=1)
            i, j = i[new], j[new]
            links[:] += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
            join(np, parent, place[i], place[j])

        plain = (sizes <= small) & (lo[starts] == hi[starts])
        for size in np.unique(sizes[plain]).tolist():
            for dim, vectors in unit.items():  # a bucket has vectors of one length
                at = starts[plain & (sizes == size) & (lengths[starts] == dim)]
                step = max(1, 400_000 // (size * size))
                for s in range(0, len(at), step):
                    rows = at[s : s + step, None] + np.arange(size)
                    v = vectors[slot[rows]]
                    r, i, j = np.nonzero(v @ v.transpose(0, 2, 1) >= threshold)
                    once = i < j
                    found(rows[r[once], i[once]], rows[r[once], j[once]])
        for k in np.flatnonzero(~plain):
            left, right, one = _sides(np, np.arange(starts[k], starts[k] + sizes[k]), lo, hi, own)
            vectors = unit[lengths[starts[k]]]
            for s in range(0, len(left), 256):
                part = left[s : s + 256]
                i, j = np.nonzero(vectors[slot[part]] @ vectors[slot[right]].T >= threshold)
                i, j = part[i], right[j]
                keep = i < j if one else np.ones(len(i), bool)
                found(i[keep], j[keep])
        linked = np.flatnonzero(links)
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(links[linked]), pa.array(node[order[parent[place[linked]]]])], ["node", "links", "root"])

    return links


def join(np, parent, i, j) -> None:
    """Union of i[k] and j[k] for all k in a forest of smallest roots, flattened."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def oracle(threshold: float, table: str = "embeddings") -> str:
    """near_duplicates in DuckDB's SQL, by all pairs: what full recall gives."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {threshold}),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a),
found AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id
  FROM {table} LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found"""
