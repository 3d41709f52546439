import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import prompts
from ragloom.operators import communities, evaluation, graph, knn, retrieval, summaries
from ragloom.providers import HashedEmbedder, HttpEmbedder, OfflineChat, model_info, output_limit, retried

REPLIES = {
    'no json': ("failed", 0, 0), '{"a":1} {"b":2}': ("failed", 0, 0), '{"entities": [], "relationships": []}': ("empty", 0, 0),
    'Sure: {"entities": [{"entity_name": " A "}, "x", {"entity_name": "  "}], "relationships": [{"source_entity": "A", "target_entity": "B"}, {"source_entity": "", "target_entity": "B"}]} done': ("ok", 1, 1),
    '{"entities": null}': ("empty", 0, 0), '{"entities": 5}': ("empty", 0, 0), '[1]': ("failed", 0, 0),
}


@pytest.mark.parametrize("reply", REPLIES)
def test_parse_reply(reply):
    status, entities, relations = graph.parse_reply(reply)
    assert (status, len(entities), len(relations)) == REPLIES[reply]
    if relations:
        assert entities == [("A", "Unknown", "")] and relations == [("A", "B", "RELATED_TO", "")]


def test_merge_entities(spark):
    rows = [("Anna", "Person", "a painter", "c1", [0, 0]), (" anna\n", "Artist", "painter", "c2", [1, 0]), ("ANNA", "P", "born in Rome", "c1", [2, 0]), ("  ", "x", "", "c3", [3, 0]), ("Bo", "Person", "", None, [4, 0]), ("Anna", "Person", "a painter", "c1", [5, 0])]
    found = {r.key: r for r in graph.merge_entities(spark.createDataFrame(rows, "name string, entity_type string, description string, source_chunk_id string, ord array<long>").repartition(3)).collect()}
    assert set(found) == {"anna", "bo"}
    a = found["anna"]
    assert (a.name, a.entity_type, a.description, a.source_chunk_ids) == ("Anna", "Person", "a painter born in Rome", ["c1", "c2"])


def relations(spark, rows):
    return spark.createDataFrame([([k], s, t, r, "", f"c{k}") for k, (s, r, t) in enumerate(rows)], "ord array<long>, source string, target string, relation string, description string, source_chunk_id string")


def test_edges_and_nodes(spark):
    rel = relations(spark, [("A", "likes", "B"), ("b", "knows", " a "), ("A", "is", "A"), ("C", "x", "A")])
    edges = graph.merge_relations(rel)
    found = {(r.src_key, r.dst_key): [x.relation for x in r.relations] for r in edges.collect()}
    assert found == {("a", "b"): ["likes", "knows"], ("a", "a"): ["is"], ("a", "c"): ["x"]}
    nodes = graph.merge_entities(spark.createDataFrame([("A", "T", "", "c", [0])], "name string, entity_type string, description string, source_chunk_id string, ord array<long>"))
    every = graph.with_implicit_nodes(nodes, edges)
    assert sorted((r.key, r.entity_type, r.is_entity) for r in every.collect()) == [("a", "T", True), ("b", "Unknown", False), ("c", "Unknown", False)]
    assert tuple(graph.graph_stats(every, edges).first()) == (1, 3, 3)
    assert sorted(r.neighbour for r in graph.neighbours(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b", "c"]
    assert graph.edge_between(edges, "c", "a").count() == 1
    n, e = graph.graph_data(rel, 2)
    assert [r.id for r in n.orderBy("ord").collect()] == ["A", "B", "b", " a "] and e.count() == 2
    assert [r.relation for r in graph.triplets(rel, 3).collect()] == ["likes", "knows", "is"]


def test_merged_descriptions(spark):
    """A description that is part of what stands there adds nothing; equal ones count at their first place."""
    rows = [("A", "T", d, f"c{k % 3}", [k, 0]) for k, d in enumerate(["b", "", None, "abc", "b", "bc", "abc", "z", "c z"])]
    found = graph.merge_entities(spark.createDataFrame(rows, "name string, entity_type string, description string, source_chunk_id string, ord array<long>").repartition(4)).first()
    assert found.description == "b abc z" and found.source_chunk_ids == ["c0", "c1", "c2"]


def test_edge_counts(spark):
    rel = relations(spark, [("A", "likes", "B"), ("b", "knows", " a "), ("A", "is", "A"), ("C", "x", " ")])
    assert sorted((r.src_key, r.dst_key, r.n_relations, r.first) for r in graph.edge_counts(rel).collect()) == [("a", "a", 1, [2]), ("a", "b", 2, [0])]


def test_extract(spark):
    chunks = spark.createDataFrame([("c0", 0, "Anna met Bo in Rome"), ("c1", 1, None)], "chunk_id string, ord long, content string")
    found = graph.extract(chunks, OfflineChat())
    assert {r.chunk_id: (r.status, len(r.relations)) for r in found.collect()} == {"c0": ("ok", 2), "c1": ("empty", 0)}
    assert tuple(graph.extraction_counts(found).first()) == (2, 1, 0)


def test_leiden_finds_cliques():
    cliques = [[f"{c}{i}" for i in range(6)] for c in "abcd"]
    edges = [(x, y, 1.0) for c in cliques for i, x in enumerate(c) for y in c[:i]] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0)]
    of = communities.leiden(edges, sum(w for *_, w in edges))
    assert len({frozenset(n for n in of if of[n] == k) for k in of.values()} & {frozenset(c) for c in cliques}) == 4


def test_components_and_communities(spark):
    rng = random.Random(2)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((k, k + rng.choice([1, 1, 2])) for k in range(0, 60)) if a % 20 < 17] + [("z", "z")]
    edges = graph.merge_relations(relations(spark, [(a, "r", b) for a, b in pairs]))
    found = {r.node: r.component for r in communities.components(edges.where("src_key <> dst_key")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs[:-1]:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert found == {x: root(x) for x in parent}
    members = communities.detect(edges, max_cluster_size=5).collect()
    assert {m.node_key for m in members} == set(found)
    assert members and all(len({found[m.node_key] for m in members if m.community_id == c}) == 1 for c in {m.community_id for m in members})
    level0 = [m.node_key for m in members if m.level == 0]
    assert len(level0) == len(set(level0)) == len(found)


def test_large_components_are_made_coarser(spark, monkeypatch):
    """Cliques in a row: found as they are, by tasks alone and by joins first."""
    cliques = [[f"{c}{i}" for i in range(8)] for c in "abcd"]
    pairs = [(x, y) for c in cliques for i, x in enumerate(c) for y in c[:i]] + [(c[0], d[0]) for c, d in zip(cliques, cliques[1:])] + [("p", "q"), ("q", "r")]
    edges = graph.merge_relations(relations(spark, [(a, "r", b) for a, b in pairs]))
    found = []
    for most in (communities.TASK_EDGES, 25):
        monkeypatch.setattr(communities, "TASK_EDGES", most)
        rows = communities.detect(edges, max_cluster_size=5).collect()
        groups = {}
        for r in rows:
            groups.setdefault((r.level, r.community_id), set()).add(r.node_key)
        assert sorted({c for _, c in groups}) == list(range(len(groups)))
        found.append({frozenset(g) for (level, _), g in groups.items() if level == 0})
        assert {frozenset(c) for c in cliques} <= found[-1]
        members = [n for g in found[-1] for n in g]
        assert len(members) == len(set(members)) == 35
    assert communities.detect(edges.limit(0)).count() == 0


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"k{i * 37 % 100:03d}",) for i in range(100)], "k string").repartition(6)
    assert [(r.k, r.number) for r in communities.numbered(rows, "k").orderBy("number").collect()] == [(f"k{i:03d}", i) for i in range(100)]


def test_community_tables(spark):
    edges = graph.merge_relations(relations(spark, [("A", "likes", "B"), ("B", "x", "C")]))
    nodes = graph.with_implicit_nodes(graph.merge_entities(spark.createDataFrame([("A", "T", "", "c", [0])], "name string, entity_type string, description string, source_chunk_id string, ord array<long>")), edges)
    membership = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "b"), (2, "c")], "community_id int, node_key string")
    told = summaries.summarise(communities.community_tables(membership, edges, nodes), OfflineChat())
    found = {r.community_id: r for r in told.collect()}
    assert found[0].entity_names == ["A", "b"] and found[0].relation_lines == ["A->b->likes->"]
    assert found[1].summary == "This community contains the following entities: c."
    assert found[2].summary == "b->c->x->"


def test_nearest(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 0.0]), ("q3", None)], "query_id string, query_embedding array<float>")
    found = [tuple(r) for r in knn.nearest(v, q, 3).orderBy("query_id", "rank").collect()]
    assert found == [("q1", 0, "a", 1.0), ("q1", 1, "c", 1.0), ("q1", 2, "b", 0.0), ("q2", 0, "a", 0.0), ("q2", 1, "b", 0.0), ("q2", 2, "c", 0.0)]
    with pytest.raises(ValueError, match="k must"):
        knn.nearest(v, q, 0)
    assert knn.nearest(v, q.limit(0), 3).count() == 0 and knn.nearest(v.limit(0), q, 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        knn.nearest(v, spark.createDataFrame([("q", [1.0])], "query_id string, query_embedding array<float>"), 1).collect()


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(60)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = v.toDF("query_id", "query_embedding")
    whole = sorted(map(tuple, knn.nearest(v, q, 5).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, knn.nearest(v, q, 5).collect())) == whole and len(whole) == 300


def hits(spark, rows):
    return spark.createDataFrame([(q, r, c, s, {}) for q, r, c, s in rows], "query_id string, rank int, content string, score double, metadata map<string,string>")


def test_retrieve_and_pack(spark):
    v = hits(spark, [("q", 0, "Same text", 0.5), ("q", 1, "other", 0.9), ("p", 0, "long" * 10, 1.0), ("p", 1, "s", 0.9)])
    g = hits(spark, [("q", 0, " same TEXT", 0.99), ("q", 1, "graph", 0.9)])
    found = [(r.query_id, r.content, r.source) for r in retrieval.retrieve(v, g).orderBy("query_id", "final_rank").collect()]
    assert found[2:] == [("q", "other", "vector"), ("q", "graph", "graph"), ("q", "Same text", "vector")]
    packed = {r.query_id: (r.context, r.n_blocks) for r in retrieval.pack_context(retrieval.retrieve(v, g), 10).collect()}
    assert packed == {"q": ("other\n\n---\n\ngraph", 2), "p": ("", 0)}
    assert [r.content for r in retrieval.retrieve(v, g, "graph").orderBy("final_rank").collect()] == [" same TEXT", "graph"]
    with pytest.raises(ValueError, match="no method"):
        retrieval.retrieve(v, g, "x")


def test_evaluation(spark):
    empty = spark.createDataFrame([], "query_id int, query_type string, method_name string, is_correct boolean")
    assert tuple(evaluation.accuracy(empty).first()) == (0.0, 0)
    assert [tuple(r) for r in evaluation.complementarity(empty, ["a", "b"]).collect()] == []
    rows = spark.createDataFrame([(1, "overall", "a", True), (2, "x", "a", False), (1, "overall", "b", True), (2, "x", "b", True)], "query_id int, query_type string, method_name string, is_correct boolean")
    found = sorted(tuple(r) for r in evaluation.accuracy_by_type(rows.where("method_name = 'a'")).collect() if not r.is_overall)
    assert found == [("overall", False, 1, 1, 1.0), ("x", False, 0, 1, 0.0)]
    pair = evaluation.complementarity(rows, ["b", "a"]).first()
    assert (pair.method_1, pair.method_2, pair.only_1, pair.only_2, pair.both, pair.neither, pair.only_1_pct) == ("b", "a", 1, 0, 1, 0, 50.0)
    assert [m.name for m in (evaluation.exact_metric(), evaluation.fuzzy_metric(), evaluation.contains_metric())] == ["exact_match", "fuzzy_match_0.8", "contains_match"]


def test_prompts(spark):
    frame = spark.createDataFrame([("C", "Q")], "c string, q string")
    shown = frame.select(prompts.few_shot_prompt(F.col("c"), F.col("q")), prompts.extraction_prompt(F.col("c"), 7)).first()
    assert shown[0].count("Example:") == 3 and shown[0].endswith("Context:\nC\n\nQuestion: Q\n\nAnswer:")
    assert "7 relations" in shown[1] and shown[1].endswith("Text:\nC")


def test_providers():
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return "ok"

    assert retried(call, 3, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError("no")), 2, waits.append)
    assert output_limit(None) == 4096 and output_limit({"context_length": 100}) == 25 and output_limit({"top_provider": {"max_completion_tokens": 9}}) == 9
    pages = {"u/models": {"data": [{"id": "m", "context_length": 8}]}}
    assert model_info("m", "u", pages.__getitem__) == {"id": "m", "context_length": 8}
    assert model_info("n", "u", lambda p: (_ for _ in ()).throw(OSError())) is None
    assert HashedEmbedder(8).embed(["a a", ""]) == [[0.0] * k + [2.0] + [0.0] * (7 - k) for k in [next(i for i, x in enumerate(HashedEmbedder(8).embed(["a"])[0]) if x)]] + [[0.0] * 8]
    e = HttpEmbedder("http://x", "m", dimension=1, batch=2)
    object.__setattr__(e, "_post", lambda path, body: {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]})
    assert e.embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Joins of nodes, edges and memberships are dealt out by key: none collects a side in the driver."""
    plans, write = [], communities.written
    monkeypatch.setattr(communities, "written", lambda df: plans.append(df) or write(df))
    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(12) for j in range(i) if (i < 6) == (j < 6) or i == 6]
    rows = spark.createDataFrame([([k, 0], a, b, "r", "", "c") for k, (a, b) in enumerate(pairs)], "ord array<long>, source string, target string, relation string, description string, source_chunk_id string")
    edges = write(graph.merge_relations(rows))
    named = rows.select(F.col("source").alias("name"), F.lit("T").alias("entity_type"), F.col("target").alias("description"), "source_chunk_id", "ord")
    nodes = write(graph.with_implicit_nodes(graph.merge_entities(named), edges))
    membership = communities.detect(edges, 3)
    tables = communities.community_tables(membership, edges, nodes)
    plans += [graph.with_implicit_nodes(graph.merge_entities(named), edges), tables]
    joins = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in j for j in joins) > 8
    components_too_large = [j for j in joins if "BroadcastHashJoin" in j and "LeftAnti" in j]  # a name each
    assert len(components_too_large) == 1 == sum("Broadcast" in j for j in joins)
