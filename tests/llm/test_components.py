import random

import pytest

from ragloom.llm import components


def plain(edges):
    """The smallest node in reach of each node with an edge to another."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    least = {}
    for first in sorted(near):
        todo = [] if first in least else [first]
        while todo:
            node = todo.pop()
            if node not in least:
                least[node] = first
                todo += near[node]
    return least


def graph(kind):
    rng = random.Random(5)
    if kind == "random":
        return [(rng.randrange(400) * 10**12 - 10**14, rng.randrange(400) * 10**12 - 10**14) for _ in range(350)]
    if kind == "chain":
        names = rng.sample(range(1000), 200)
        return list(zip(names, names[1:], strict=False))
    if kind == "hub above":  # the hub is the largest node
        return [(5000, k) for k in range(300)] + [(7000, 7001), (7001, 7001), (8000, 8000)]
    return []


@pytest.mark.parametrize("kind", ["random", "chain", "hub above", "empty"])
@pytest.mark.parametrize("most", [200_000, 0])
def test_smallest_node_in_reach(spark, monkeypatch, kind, most):
    """The same in one task and by rounds."""
    monkeypatch.setattr(components, "ONE_TASK", most, raising=False)
    edges = graph(kind)
    frame = spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(3)
    found = [tuple(r) for r in components.connected_components(frame).collect()]
    assert len(found) == len(dict(found)) and dict(found) == plain(edges)


@pytest.mark.parametrize(("kind", "most", "jobs"), [("chain", 200_000, 6), ("stars", 0, 8)])
def test_jobs_are_few(spark, monkeypatch, kind, most, jobs):
    """The driver keeps plans and tasks of all jobs: few edges take no rounds, and neither do stars."""
    monkeypatch.setattr(components, "ONE_TASK", most, raising=False)
    edges = graph(kind) if kind == "chain" else [(1000 * (k % 3), 1000 * (k % 3) + k) for k in range(1, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup(f"components {kind}", "")
    try:
        components.connected_components(frame)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {kind}")) <= jobs
