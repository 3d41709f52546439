import random

import numpy as np
import pytest

from ragloom.llm import ngram_join


def brute(rows, size, percent):
    """(n, component) by comparing all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                low, high = (a, b) if rows[a][0] < rows[b][0] else (b, a)
                parent[high] = low
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.randrange(6))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 20, 60, 150]))]
            if kind > 0.8:
                words = words[:20] + passage
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    return list(zip(rng.sample(range(10 * n), n), texts, strict=True))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_all_pairs(spark, documents, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    monkeypatch.setattr(ngram_join, "PART_DOCS", 20)
    monkeypatch.setattr(ngram_join, "PART", 7)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = corpus(size, 250)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(documents(rows), size, percent).collect()}
    assert found == brute(rows, size, percent)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_without_heavy_shingles_runs_are_long(spark, documents, monkeypatch, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_long_runs(spark, documents, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_long_runs(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 0)
    monkeypatch.setattr(ngram_join, "RUN", 8)
    rng = random.Random(3)
    base = [f"a{k}" for k in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(100))) for i in range(30)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(documents(rows), 4, 85).collect()}
    assert found == brute(rows, 4, 85)


def test_odd_rows(spark, documents):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\ttwo"), (6, "one"), (7, long), (8, long + " end"), (None, "one two"), (9, "a b c d e"), (9, "a b c d e")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(documents(rows), 4, 85).collect()), key=str)
    expected = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29_997, 7), (8, 29_998, 7), (None, 1, None), (9, 2, 9), (9, 2, 9)]
    assert found == sorted(expected, key=str)


@pytest.mark.parametrize("chain", [False, True])
def test_large_clusters(spark, documents, monkeypatch, chain):
    """A large group about one hub, and a long chain in which few are linked with the hub; sizes
    differ, and single documents of the same words are linked with nothing."""
    monkeypatch.setattr(ngram_join, "PART_DOCS", 12)
    monkeypatch.setattr(ngram_join, "PART", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    monkeypatch.setattr(ngram_join, "ROUNDS", 2)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rng = random.Random(7)
    base = [f"a{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = base[3 * i % 60 :] if not chain else [f"c{k}" for k in range(4 * i, 4 * i + 100)]
        words = list(words)
        if not chain:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((rng.randrange(100) * 1000 + i, " ".join(words)))
    rows += [(200_000 + i, " ".join(rng.choice(base) for _ in range(100))) for i in range(20)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(documents(rows), 4, 85).collect()}
    expected = brute(rows, 4, 85)
    assert found == expected
    assert len({c for _, c in expected.values()}) >= 21


def test_common_passage_gathers_no_cluster(spark, documents, monkeypatch):
    """Unrelated documents with a passage in common, some of them with a copy, rows twice: the rows
    that are joined don't grow with the square of the passage's documents."""
    monkeypatch.setattr(ngram_join, "PART_DOCS", 12)
    monkeypatch.setattr(ngram_join, "PART", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    monkeypatch.setattr(ngram_join, "RUN", 8)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    joined, join = [], ngram_join._join_groups

    def counted(rows, *more, **named):
        joined.append(rows.count())
        return join(rows, *more, **named)

    monkeypatch.setattr(ngram_join, "_join_groups", counted)
    rng = random.Random(11)
    passage = [f"a{k}" for k in range(30)]
    rows = [(i, " ".join(passage + [f"d{i}x{k}" for k in range(30 + i % 7)])) for i in range(120)]
    rows += [(1000 + i, text + " end") for i, text in rng.sample(rows, 15)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(documents(rows + rows[-30:-10]), 4, 85).collect()}
    assert found == brute(rows, 4, 85)
    assert len({c for _, c in found.values()}) == 120
    assert sum(joined) < 2 * len(rows)


def test_empty_table(spark, documents):
    assert ngram_join.link_documents(documents([(1, "x")]).limit(0)).count() == 0


def test_keep_first_keeps_columns_and_one_of_each(spark, documents):
    words = " ".join(f"w{k}" for k in range(50))
    docs = documents([(3, words), (2, words + " more"), (5, "other text of its own kind here"), (5, "other text of its own kind here"), (7, None), (8, None)])
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 7, 8]


def test_rows_of_one_id(spark, documents):
    """Decided by id and text: no text that is unlike all others is lost."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (2, two), (2, two + " end"), (3, three), (3, "odd"), (None, one), (None, one), (4, None), (4, None), (4, ""), (5, "few words"), (6, "few words")]
    docs = documents(rows)
    linked = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()), key=str)
    n = 36
    assert linked == sorted([(1, n, 1), (2, n, 1), (2, n, 2), (2, n, 2), (2, n + 1, 2), (3, n, 3), (3, 1, 3), (None, n, None), (None, n, None), (4, 0, 4), (4, 0, 4), (4, 0, 4), (5, 1, 5), (6, 1, 5)], key=str)
    found = [sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(docs.repartition(p)).collect()), key=str) for p in (1, 5)]
    assert found[0] == found[1]
    assert [t for i, t in found[0] if i == 2] in ([two], [two + " end"])
    assert sorted(((i, t) for i, t in found[0] if i != 2), key=str) == sorted([(1, one), (3, three), (3, "odd"), (None, one), (None, one), (4, None), (4, ""), (5, "few words")], key=str)


def test_repeated_rows_leave_one(spark, documents):
    """That with the smallest columns, whatever the order of the rows."""
    docs = documents([(1, "a b c d e f", s) for s in "zyx"])
    assert [r.source for r in ngram_join.keep_first(docs).collect()] == ["x"]


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in rng.integers(5, 300, 150)]
    for k in range(60):
        sets.append(np.unique(np.concatenate([sets[k][rng.random(len(sets[k])) < 0.97], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])))
    parent = list(range(len(sets)))
    tree = ngram_join.SignatureTree(np, list(range(len(sets))), sets, 1024)
    ngram_join.tree_join(np, tree, tree, sets, parent, 85)
    top = lambda i: i if parent[i] == i else top(parent[i])
    plain = list(range(len(sets)))
    up = lambda i: i if plain[i] == i else up(plain[i])
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = up(i), up(j)
                plain[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(sets))] == [up(i) for i in range(len(sets))]


def test_front_and_overlap_are_whole_numbers():
    for percent in (50, 80, 85, 100):
        for n in range(1, 200):
            assert ngram_join.front(n, percent) == n - -(-percent * n // 100) + 1
            least = ngram_join.least_overlap(n, n, percent)
            assert 100 * least >= percent * (2 * n - least) and 100 * (least - 1) < percent * (2 * n - least + 1)
