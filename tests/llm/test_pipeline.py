from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ragloom.llm import common, labelled, mixing, ngram_join, quality, toxicity
from ragloom.llm import queries as llm


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's rows, written and read again."""
    docs = common.read(spark, small, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(common.materialise(stage(spark, out[-1], small), f"t{k}"))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


@pytest.mark.parametrize(("at", "module", "threshold", "good"), [(0, quality, 0.3, True), (1, toxicity, 0.5, False)])
def test_classifiers_drop_what_they_reject(spark, small, stages, at, module, threshold, good):
    scored = module.score(stages[at], module.fit(stages[at], common.read(spark, small, "labels"))).collect()
    assert ids(stages[at + 1]) == Counter(r.doc_id for r in scored if (r.score >= threshold) == good)


def test_labelled_documents_mostly_keep_their_sides(spark, small, stages):
    marks = {r.doc_id: r for r in common.read(spark, small, "labels").collect()}
    after = set(ids(stages[1]))
    right = sum((d in after) == (m.quality == 1) for d, m in marks.items())
    assert right > 0.9 * len(marks)
    clean = [d for d, m in marks.items() if m.toxic == 0 and d in after]
    assert len(set(clean) & set(ids(stages[2]))) > 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    sets = {}
    for d, t in rows.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    least = {d: d for d in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    assert linked and ids(stages[3]) == Counter(d for d in sets if least[d] == d)


def test_mix_takes_whole_documents(stages):
    report = {r.doc_id: r for r in mixing.mix_report(stages[3]).collect()}
    assert ids(stages[4]) == Counter({d: r.taken // r.size for d, r in report.items() if r.taken})


def test_packing_holds_every_copy(stages):
    packed = stages[5].collect()
    copies = ids(stages[4])
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_registered():
    assert [n for n in llm.QUERIES] == [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = con.execute(llm.ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    expected = sorted((tuple(r[[c[0] for c in expected.description].index(n)] for n in columns) for r in expected.fetchall()), key=str)
    found = sorted(map(tuple, llm.QUERIES[name](spark, small).select(*columns).collect()), key=str)
    assert found == expected


def test_sql_links(spark, documents):
    """The SQL of the join agrees on rows with links, empty and short texts."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (4, " ".join(words[:-1])), (2, " ".join(words).upper()), (3, ""), (5, None), (6, "A b"), (7, "a\tB"), (8, " ".join(words[10:]))]
    docs = documents(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    expected = sorted(con.execute(ngram_join.oracle(4, 85)).fetchall())
    assert sorted(map(tuple, ngram_join.link_documents(docs, 4, 85).collect())) == expected


def test_whole_table_is_read(spark, small):
    n = common.read(spark, small, "documents").count()
    docs = common.read(spark, small, "documents")
    assert labelled.report(toxicity.score(docs, toxicity.fit(docs, common.read(spark, small, "labels"))), 0.5).count() == n


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def test_run_is_all_stages(spark, small, stages):
    pieces = lambda frame: Counter(map(tuple, frame.select(*PIECE).collect()))
    assert pieces(corpus_pipeline.run(spark, small)) == pieces(stages[5])


def test_odd_rows_through_all_stages(spark, documents, labels, tmp_path):
    """Null and repeated ids, null, empty and very long texts: each row has its own fate."""
    from test_classifiers import corpus

    rows, marks = corpus(300, seed=3)
    good = next(t for (_, t), (_, q, x) in zip(rows, marks, strict=True) if q and not x)
    junk = next(t for (_, t), (_, q, x) in zip(rows, marks, strict=True) if not q)
    bad = next(t for (_, t), (_, q, x) in zip(rows, marks, strict=True) if q and x)
    other = " ".join(reversed(good.split()))
    odd = [(None, good), (None, junk), (None, bad), (7000, other), (7000, bad), (7000, good), (7000, other), (7001, None), (7002, ""), (7003, (good + " ") * 300)]
    documents(rows + odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels(marks).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), "odd")
        texts.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    assert texts[0][None, junk] == 0 and texts[0][None, good] == 1 and texts[0][7000, other] == 2
    assert texts[1][None, bad] == texts[1][7000, bad] == 0 and texts[1][7000, other] == 2
    assert texts[2][None, good] == 1  # linked with nothing
    assert texts[2][7000, other] == 1 and texts[2][7000, good] == 0  # a copy of an earlier one
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables_through_all_stages(spark, documents, labels, tmp_path):
    documents([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels([(1, 1, 0)]).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder(spark, monkeypatch):
    """Named by the session, or on a local master a temporary one; written tables can be removed."""
    import os
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn")))
    frame = common.materialise(spark.range(5).toDF("x"), "t")
    path = common.local_path(frame.materialised_at)
    assert frame.count() == 5 and os.path.isdir(path)
    common.discard(frame)
    assert not os.path.exists(path)
