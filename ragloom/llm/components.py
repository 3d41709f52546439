"""Connected components of an edge table: in one task while the edges are few, else by alternating
large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

#: So many different edges at most are one task's (3 MB); each step of the others costs the driver a dozen
#: jobs, whose plans and tasks it keeps.  A matter of speed and of the driver's memory: results are the same.
ONE_TASK = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its smallest node.

    More than ONE_TASK edges go through rounds, until all are stars about their smallest nodes.
    Each round joins every node's edges to the smallest of its neighbours.  Those are written
    first, so that the join has two plain inputs and a hub's edges, which all meet one row, can be
    split over many tasks.  Edges per step are written too, and those of the step before removed; the driver
    sees one number a round.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs = materialise(pairs, "edges")
    if pairs.count() <= ONE_TASK:
        found = materialise(pairs.coalesce(1).mapInArrow(tidy(_forest), "node long, component long"), "components")
        discard(pairs)
        return found
    for _ in range(most_rounds):
        if _settled(pairs):
            break
        for large in (True, False):
            new, least = _star(pairs, large)
            new = materialise(new, "edges")
            discard(pairs)
            discard(least)
            pairs = new
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(pairs.select("v", "v").distinct())


def _forest(batches):
    """(node, component) of one task's edges: roots that an edge joins go below the smallest in reach."""
    import numpy as np
    import pyarrow as pa

    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[parent])], ["node", "component"])


def _settled(pairs: DataFrame) -> bool:
    """Whether each u has one edge, and none is a v: then v is the smallest node of its component."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.union(pairs.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return not ends.where("above + below > 1").count()


def _star(pairs: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, written minima).  Large: every neighbour above u gets the smallest of u and its neighbours.  Small: every
    neighbour below u, and u, get the smallest of those below u."""
    if large:
        sided = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = materialise(sided.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        out = sided.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = pairs.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return out.where("u > v").distinct(), least
