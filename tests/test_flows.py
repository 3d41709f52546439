import dataclasses
import json

import pytest

from ragloom import api, cli, config, schemas
from ragloom.shared import written
from ragloom.plans import benchmark, indexing
from ragloom.plans.service import Service, ask
from ragloom.providers import HashedEmbedder, OfflineChat
from ragloom.sources import documents, index_store
from ragloom.streaming import indexer

DOCS = [("d1", "Anna met Bo in Rome. They talked about Milan.", "Travel", {"author": "X"}), ("d2", "Carl lives in Oslo. Oslo is in Norway.", "North", {}), ("d3", "Anna met Bo in Rome. They talked about Milan.", "Copy", {})]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, schemas.DOCUMENT)


def test_documents_from_dir(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "list.json").write_text(json.dumps([{"text": "a"}, {"id": "x", "content": "b", "title": "T", "metadata": {"k": "v"}}, "no"]))
    (tmp_path / "one.json").write_text(json.dumps({"content": None, "text": "c"}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "sub" / "note one.md").write_text("# H\nтекст")
    (tmp_path / "t.txt").write_text("")
    (tmp_path / "t.TXT").write_text("passed over")
    found = {r.doc_id: (r.content, r.title, r.metadata) for r in documents.documents_from_dir(spark, str(tmp_path)).collect()}
    assert found == {"list#0": ("a", "", {}), "x": ("b", "T", {"k": "v"}), "one": ("c", "", {}), "note one": ("# H\nтекст", "note one.md", {}), "t": ("", "t.txt", {})}


def test_samples_and_corpora(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text(json.dumps([{"query": "q0", "answer": "a0"}, {"id": "s", "query": "q1", "answer": "a1", "question_type": "temporal", "evidence_list": ["e"]}]))
    rows = [tuple(r)[:5] for r in documents.samples_from_json(spark, str(path)).collect()]
    assert rows == [("0", "q0", "a0", "unknown", []), ("s", "q1", "a1", "temporal", ["e"])]
    assert documents.samples_from_json(spark, str(path), 1).count() == 1
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"url": "http://a", "title": "T", "body": "B", "source": "S"}, {"id": 7, "text": "plain"}]))
    a, b = documents.news_corpus_from_json(spark, str(path)).collect()
    assert (len(a.doc_id), a.content, a.metadata["source"], a.metadata["author"]) == (12, "B", "S", "") and b.doc_id == "doc_1"
    assert [(r.doc_id, r.content) for r in documents.corpus_from_json(spark, str(path)).collect()] == [("", ""), ("7", "plain")]


def test_store(spark, tmp_path):
    store = index_store.IndexStore(spark, str(tmp_path / "ix"))
    with pytest.raises(FileNotFoundError):
        store.read("chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, content string")
    store.upsert("chunks", rows(("a", "1"), ("b", "1")), "chunk_id")
    store.upsert("chunks", rows(("b", "2"), ("c", "2")), "chunk_id")
    assert sorted(map(tuple, store.read("chunks").collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    store.write("mark", other=rows(("z", "9")))
    assert store.is_current("mark", "other") and not store.is_current("else", "other") and not store.is_current("mark", "chunks", "other")
    store.clear()
    assert not store.has("chunks")


def test_fingerprints(spark):
    a = spark.createDataFrame([("x", "1", 0), ("y", "2", 1)], "chunk_id string, content string, ord int")
    b = spark.createDataFrame([("y", "3", 1), ("x", "1", 0)], "chunk_id string, content string, ord int")
    ids = lambda d: index_store.first_ids_fingerprint(d).first()[0]
    content = lambda d, **s: index_store.content_fingerprint(d, s).first()[0]
    assert ids(a) == ids(b) and content(a) != content(b) and content(a) == content(a.orderBy("ord", ascending=False)) and content(a) != content(a, size=1)


@pytest.fixture(scope="module")
def service(spark, docs, tmp_path_factory):
    settings = dataclasses.replace(config.SERVICE, vector=config.VectorSettings(20, 0, 2))
    store = index_store.IndexStore(spark, str(tmp_path_factory.mktemp("ix")))
    chunks = written(indexing.chunked(docs, settings))
    indexing.index_vectors(store, chunks, HashedEmbedder(32))
    assert indexing.build_graph_cached(store, chunks, OfflineChat(), HashedEmbedder(32), settings)
    assert not indexing.build_graph_cached(store, chunks, OfflineChat(), HashedEmbedder(32), settings)
    return Service(store, HashedEmbedder(32), OfflineChat(), settings)


def test_service(spark, service):
    assert service.loaded() == {"vector": True, "graph": True}
    questions = spark.createDataFrame([("1", "Anna met Bo in Rome"), ("2", "Oslo Norway")], "query_id string, query string")
    for method in ("vector", "graph", "hybrid"):
        answers = service.answer(questions, method).collect()
        assert len(answers) == 2 and all(a.answer for a in answers)
    hybrid = service.retrieve(questions, "hybrid").where("query_id = '1'")
    keys = [r.content.lower() for r in hybrid.collect()]
    assert len(keys) == len(set(keys))
    assert ask(spark, service, "Where is Oslo?", max_context=5).startswith("Example:")
    stats = indexing.index_stats(service.store).first()
    assert stats.nodes >= stats.entities > 0 and stats.communities >= stats.communities_with_summaries > 0


def test_api(spark, service):
    reply = api.query(spark, service, {"query": "Anna", "method": "vector", "top_k": 1})
    assert len(reply["sources"]) == 1 and reply["sources"][0]["source"] == "vector"
    data = api.graph_data(service, 3)
    assert len(data["edges"]) == 3 and data["nodes"][0]["id"]
    for bad in ({}, {"query": "x", "method": "y"}, {"query": " "}):
        with pytest.raises(ValueError):
            api.checked(bad)


def test_benchmark(spark, docs, tmp_path):
    settings = config.Settings(vector=config.VectorSettings(20, 0, 2), output_dir=str(tmp_path / "out"))
    samples = spark.createDataFrame([("1", "Anna met whom and why?", "Bo", "inference", [], {}), ("2", "Oslo is in", "Norway", "temporal", [], {})], schemas.SAMPLE)
    store = index_store.IndexStore(spark, str(tmp_path / "ix"))
    found = benchmark.run(samples, docs, store, HashedEmbedder(32), OfflineChat(), settings)
    assert {(r.method_name, r.query_id) for r in found.collect()} == {(m, q) for m in config.METHODS for q in "12"}
    pairs = spark.read.json(f"{settings.output_dir}/comparison/pairs")
    assert pairs.count() == 10
    header = spark.read.option("header", True).csv(f"{settings.output_dir}/vector_rag/predictions.csv").columns
    assert header == ["query_id", "query_type", "is_correct", "query", "ground_truth", "prediction"]
    assert benchmark.needs(("vector_rag",)) == (True, False) and benchmark.needs(("graphrag_local",)) == (False, True)


def test_config(tmp_path, monkeypatch):
    path = str(tmp_path / "c.yaml")
    config.save(config.Settings(output_dir="here"), path)
    assert config.load(path) == config.Settings(output_dir="here")
    (tmp_path / "empty.yaml").write_text("")
    assert config.load(str(tmp_path / "empty.yaml")) == config.Settings()
    (tmp_path / "bad.yaml").write_text("vector: {nothing: 1}")
    with pytest.raises(TypeError):
        config.load(str(tmp_path / "bad.yaml"))
    monkeypatch.setenv("OPENAI_BASE_URL", "http://env")
    assert config.ChatSettings(base_url="http://file").endpoint() == "http://env"
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError):
        config.ChatSettings(model="m").key()


def test_cli(spark, tmp_path, capsys):
    source, out = tmp_path / "in", str(tmp_path / "ix")
    source.mkdir()
    assert cli.main(["index", "-i", str(source / "none"), "-o", out]) == 1
    assert cli.main(["index", "-i", str(source), "-o", out]) == 1
    (source / "a.txt").write_text("Anna met Bo in Rome.")
    assert cli.main(["index", "-i", str(source), "-o", out]) == 0
    assert json.loads((tmp_path / "ix" / "metadata.json").read_text())["document_count"] == 1
    capsys.readouterr()
    assert cli.main(["status", "-o", out]) == 0
    assert json.loads(capsys.readouterr().out)["vector_count"] == 1
    assert cli.main(["ask", "-o", out, "Who is in Rome?"]) == 0


def test_streaming(spark, docs, tmp_path):
    folder, store = str(tmp_path / "in"), index_store.IndexStore(spark, str(tmp_path / "ix"))
    for part in (docs, docs.limit(1)):
        part.write.mode("append").parquet(folder)
        indexer.start(indexer.document_stream(spark, folder), store, HashedEmbedder(8), str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.read("chunks").count() == 3


def test_shared_folder_is_never_one_machines(monkeypatch):
    from types import SimpleNamespace

    from ragloom import shared

    unset = SimpleNamespace(get=lambda key, default: None, set=lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda key, default: "hdfs://x/y/")
    assert shared.folder(SimpleNamespace(conf=named)) == "hdfs://x/y"
    assert shared.folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:///")


def test_written_tables_can_be_removed(spark):
    import os

    from ragloom import shared

    frame = shared.written(spark.range(3).toDF("x"))
    path = frame.written_at.removeprefix("file://")
    assert frame.count() == 3 and os.path.isdir(path)
    shared.discard(frame)
    assert not os.path.exists(path)


def test_cached_vectors(spark, docs, tmp_path):
    store, chunks = index_store.IndexStore(spark, str(tmp_path / "ix")), written(indexing.chunked(docs, config.Settings()))
    build = lambda **o: indexing.index_vectors_cached(store, chunks, HashedEmbedder(8), config.Settings(), **o)
    assert [build(), build(), build(rebuild=True)] == [True, False, True]


def test_serve_without_its_packages(spark, service, capsys, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "uvicorn", None)
    assert cli.serve(service, "127.0.0.1", 1) == 1 and "uvicorn" in capsys.readouterr().err


def test_page_calls():
    import io

    from ragloom import ui

    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, request.data, timeout))
        return io.BytesIO(b'{"answer": "x"}')

    assert ui.call("http://h/", "query", {"query": "q"}, opener) == {"answer": "x"} and asked == [("http://h/query", b'{"query": "q"}', 60)]
    assert ui.call("http://h", "graph/data?limit=5", None, opener) == {"answer": "x"} and asked[1][2] == 10

    def broken(request, timeout):
        raise OSError("down")

    assert ui.call("http://h", "status", None, broken) == {"error": "down"}
    assert ui.dot({"nodes": [{"id": 'a"b'}], "edges": []}) == 'digraph {\n  "a\\"b";\n}'


def test_spans(spark, caplog):
    from ragloom import tracing

    with caplog.at_level("INFO", logger="ragloom"), tracing.span("outer"):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "outer"
        with pytest.raises(KeyError), tracing.span("inner"):
            raise KeyError
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
    assert [r.getMessage().split(" in ")[0] for r in caplog.records] == ["inner failed", "outer done"]


def test_corpus_to_documents(spark):
    found = documents.corpus_to_documents(spark.createDataFrame([(1, "x"), (None, None)], "doc_id int, content string")).collect()
    assert [tuple(r) for r in found] == [("1", "x", "", {}), ("", "", "", {})]


def test_order_of_chunks(spark):
    rows = spark.createDataFrame([(f"d{k % 7}", k, "x") for k in range(60)], "doc_id string, chunk_index int, content string").repartition(5)
    found = written(indexing.ordered(rows)).orderBy("ord").collect()
    assert [(r.doc_id, r.chunk_index) for r in found] == sorted((r.doc_id, r.chunk_index) for r in found) and len({r.ord for r in found}) == 60
