import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, e string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", 3) for i, v in rows], SCHEMA).repartition(3)


def plain_links(rows, threshold=0.9):
    ok = {k: np.asarray(v, float) for k, (i, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float) != 0)}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ok:
        for b in ok:
            x, y = ok[a], ok[b]
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                p, q = root(a), root(b)
                if p != q:
                    low, high = (p, q) if rows[p][0] < rows[q][0] else (q, p)
                    parent[high] = low
    return sorted((rows[k][0], links[k], rows[root(k)][0]) for k in range(len(rows)))


def sample(seed=5, n=300, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        v = rng.normal(size=dim)
        if rows and rng.random() < 0.6:
            base = np.asarray(rows[rng.integers(len(rows))][1])
            v = base + rng.choice([0, 0.05, 0.2]) * np.linalg.norm(base) / dim**0.5 * v
        rows.append((int(rng.integers(1, 9)) + 10 * len(rows), [float(np.float32(x)) for x in v]))
    return rows


ODD = [(90_001, None), (90_002, [0.0] * 32), (90_003, [float("nan")] * 32), (90_004, [None] * 32), (90_005, [float("inf")] + [1.0] * 31), (90_006, [1.0, 2.0]), (90_007, [2.0, 4.0]), (90_008, [])]


@pytest.fixture(params=[10_000, 5])
def batches(spark, request):
    """Runs of rows go on over the ends of small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [4096, 16])
def test_near_duplicates(spark, block, batches):
    """With wide cells every pair meets in some table, and the rest is exact."""
    rows = sample() + ODD
    found = near_vectors.near_duplicates(frame(spark, rows), block=block, width=4.0, projections=4).collect()
    expected = plain_links(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_defaults_find_most_and_add_none(spark):
    rows = sample(9)
    found = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(frame(spark, rows)).collect()}
    expected = {i: n for i, n, _ in plain_links(rows)}
    assert all(found[i] <= expected[i] for i in expected)
    assert sum(found.values()) >= 0.97 * sum(expected.values())


def test_repeated_rows_link(spark):
    found = near_vectors.near_duplicates(frame(spark, [(4, [1, 2]), (4, [1, 2]), (9, [1, 2]), (None, [1, 2]), (5, [-1, 2])])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in found) == [(-1, 0, None), (4, 2, 4), (4, 2, 4), (5, 0, 5), (9, 2, 4)]
    assert near_vectors.near_duplicates(frame(spark, [(1, [1, 2])]).limit(0)).count() == 0


def test_double_precision(spark):
    """Components that no float holds, and a cosine that floats would round over the threshold."""
    near = 0.9 - 1e-12
    rows = [(1, [1e-60] * 4), (2, [1e-60] * 4), (3, [1e200, 1e200, 1.0, 1.0]), (4, [1e200, 1e200, 1.0, 1.0]), (5, [1.0, 0.0]), (6, [near, (1 - near**2) ** 0.5]), (7, [0.9 + 1e-12, (1 - (0.9 + 1e-12) ** 2) ** 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame, width=4.0, projections=2).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 2, 5)]


def test_one_id_with_two_vectors(spark):
    rows = [(3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [0.01, 1.0, 0.0]), (7, [0.0, 0.0, 1.0])]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame(spark, rows)).collect())
    assert found == [(3, 1, 3), (3, 1, 3), (5, 1, 3), (6, 1, 3), (7, 0, 7)]


def test_planted_copies_in_the_table(spark, small):
    """The fixture's vectors with near copies of a third of them, as the table has none by itself."""
    rng = np.random.default_rng(4)
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = table + [(10_000 + i, [float(np.float32(x + 0.02 * rng.normal())) for x in v]) for i, v in table[::3]] + [(20_000 + i, v) for i, v in table[::5]]
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame(spark, rows)).collect()}
    expected = {i: (n, c) for i, n, c in plain_links(rows)}
    assert sum(n for n, _ in expected.values()) > 400
    assert all(found[i][0] <= n for i, (n, _) in expected.items())
    assert sum(n for n, _ in found.values()) >= 0.97 * sum(n for n, _ in expected.values())
    assert np.mean([found[i] == expected[i] for i in expected]) > 0.97


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just above 0.9, the hardest to find."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.902 * a + (1 - 0.902**2) ** 0.5 * b).tolist())]
    found = near_vectors.near_duplicates(frame(spark, rows)).agg(F.sum("n_links")).first()[0]
    assert found / sum(x[1] for x in plain_links(rows)) >= 0.9


def plain_top(rows, k=5, every=3):
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(np.asarray(v, float)).all()]
    out = []
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(x) == len(y))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k(spark, block, batches):
    rows = sample(6, 200) + ODD + [(90_010, [1.0] * 32), (90_012, [1.0] * 32), (90_014, [0.0] * 32)]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 3 == 0, block=block, query_block=16).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == plain_top(rows)


def test_top_k_of_few_and_of_huge(spark):
    rows = [(0, [3e6, -2e6]), (1, [1e6, 5.0]), (2, [1e12, 1e12]), (3, [-1e7, 0.5])]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 3 == 0).collect()
    expected = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in plain_top(rows)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == expected
    assert topk.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_repeated_rows_search(spark):
    """A query row that is there twice is one query; a candidate that is there twice counts twice."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 3 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 1, 32768), (2, 1, 32768), (3, 2, 16384)]


def test_bounds_drop_no_candidate():
    rng = np.random.default_rng(3)
    for _ in range(20):
        d, n, q = 48, 500, 8
        queries = np.floor(rng.normal(size=(q, d)) * 60)
        columns = np.floor(rng.normal(size=(d, n)) * 60 * np.linspace(2, 0.1, d)[:, None])
        i, c, s = topk.search_block(np, queries, columns, 5, np.full(q, -np.inf), step=8)
        whole = queries @ columns
        for a in range(q):
            kept = set(c[i == a].tolist())
            assert set(np.flatnonzero(whole[a] >= np.sort(whole[a])[-5]).tolist()) <= kept
        assert np.array_equal(whole[i, c], s)
