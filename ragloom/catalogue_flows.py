"""Queries of files, stores, providers and whole flows: each writes and reads what it names in the
shared folder, over whole fixture tables, with its DuckDB counterpart."""

from __future__ import annotations

import contextlib
import dataclasses
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, catalogue, cli, config, shared, tracing, ui
from .catalogue import _GEOGRAPHY, _ITEM_HITS, _PAIRS_SQL, _documents, _geography, _knn_sql, _labels, _pairs, _people, _quoted, _summaries, query
from .functions import prompts
from .operators import chunking, communities, evaluation, graph, knn, retrieval, summaries
from .plans import benchmark, indexing
from .plans.service import Service
from .providers import HashedEmbedder, HttpChat, HttpEmbedder, OfflineChat, model_info, output_limit
from .sources import documents as sources
from .sources import index_store, reports
from .sources.index_store import Folder, IndexStore


def _store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, shared.fresh_path(spark, "index"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that a flow says of itself."""
    return spark.createDataFrame(rows, schema)


def _save_files(files: DataFrame, spark: SparkSession) -> str:
    """A folder with a file for each row (name, content)."""
    path = shared.fresh_path(spark, "files")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with shared.saving(f"{path}/{name}") as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    files.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    return path


def _json_lists(rows: DataFrame, order: list[str], item, name: str, *group) -> DataFrame:
    """name, content: one JSON list a group, its items in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.to_json(item).alias("item")))), lambda x: x["item"])
    return rows.groupBy(*group).agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("content")).withColumn("name", F.expr(name))


def _save_list(rows: DataFrame, order: list[str], item, path: str) -> str:
    """The path of a file with one JSON list of all items, in order.  Tasks write a range of them each,
    and the parts are put one after the other, so no row and no task's memory holds the list."""
    spark, parts = rows.sparkSession, shared.fresh_path(rows.sparkSession, "parts")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), next((b for b in batches if b.num_rows), None)
        if first is not None:
            with shared.saving(f"{parts}/{part}") as out:
                out.write(",".join(first.column(0).to_pylist()).encode())
                for b in batches:
                    for text in b.column(0).to_pylist():
                        out.write(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    texts = rows.select(*order, F.to_json(item).alias("item")).repartitionByRange(*order).sortWithinPartitions(*order, "item").select("item")
    found = sorted(r.part for r in texts.mapInArrow(run, "part int").collect())
    with shared.saving(path) as out:
        out.write(b"[")
        for k, part in enumerate(found):
            out.write(b"," if k else b"")
            shared.copy(f"{parts}/{part}", out)
        out.write(b"]")
    shared.remove(spark, parts)
    return path


# --- files ----------------------------------------------------------------------------------------


def _document_files(t) -> DataFrame:
    """Documents by hundreds of a source as JSON lists, those with odd ids without an id; pages as
    one JSON object each; benchmark items as text and Markdown files."""
    even = F.col("doc_id") % 2 == 0
    item = F.struct(
        F.when(even, F.col("doc_id").cast("string")).alias("id"), F.when(even, F.col("text")).alias("content"), F.when(~even, F.col("text")).alias("text"),
        F.when(even, F.col("lang")).alias("title"), F.when(even, F.create_map(F.lit("lang"), "lang")).alias("metadata"),
    )
    rows = t("documents").withColumns({"part": F.floor(F.col("doc_id") / 100), "of": F.substring(F.md5("source"), 1, 8)})
    lists = _json_lists(rows, ["doc_id"], item, "concat('s', of, '-', part, '.json')", "of", "part")
    page = F.to_json(F.struct(F.col("html").alias("text"), F.col("url").alias("title")))
    objects = t("pages").select(F.concat(F.lit("pages/page "), "page_id", F.lit(".json")).alias("name"), page.alias("content"))
    suffix = F.when(F.col("item_id") % 2 == 0, ".txt").otherwise(".md")
    texts = t("benchmark").select(F.concat(F.lit("item_"), "item_id", suffix).alias("name"), F.col("text").alias("content"))
    return lists.select("name", "content").union(objects).union(texts)


@query("""WITH d AS (SELECT *, 's' || substr(md5(source), 1, 8) || '-' || (doc_id // 100) AS stem FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY stem) AS items FROM d)
SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) WHEN items > 1 THEN stem || '#' || place ELSE stem END AS doc_id, text AS content, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM n
UNION ALL SELECT 'page ' || page_id, html, url, NULL FROM pages
UNION ALL SELECT 'item_' || item_id, text, 'item_' || item_id || CASE WHEN item_id % 2 = 0 THEN '.txt' ELSE '.md' END, NULL FROM benchmark""")
def documents_dir(t):
    """Files of all three kinds, written and read."""
    spark = t("documents").sparkSession
    found = sources.documents_from_dir(spark, _save_files(_document_files(t), spark))
    return found.select("doc_id", "content", "title", F.col("metadata")["lang"].alias("lang"))


def _samples_file(t) -> str:
    """Questions and answers as one JSON list, some without id and type."""
    third, half = (F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("conv_id") % 2 == 0
    item = F.struct(F.when(third, F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn")).alias("id"), F.col("truth").alias("query"), F.col("prediction").alias("answer"), F.when(half, F.lit("even")).alias("question_type"), F.when(half, F.array("truth")).alias("evidence_list"))
    pairs = _pairs(t)
    return _save_list(pairs, ["conv_id", "turn"], item, shared.fresh_path(pairs.sparkSession, "files") + "/samples.json")


_SAMPLES_SQL = f"""(SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM ({_PAIRS_SQL}))"""
_SAMPLE_COLUMNS = "CASE WHEN (conv_id + turn) % 3 = 0 THEN 'c' || conv_id || 't' || turn ELSE CAST(idx AS VARCHAR) END AS query_id, truth AS query, prediction AS answer, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'unknown' END AS query_type, CASE WHEN conv_id % 2 = 0 THEN truth ELSE '' END AS evidence"


def _sample_rows(samples: DataFrame) -> DataFrame:
    return samples.select("query_id", "query", "answer", "query_type", F.array_join("evidence_ids", "|").alias("evidence"))


@query(f"SELECT {_SAMPLE_COLUMNS} FROM {_SAMPLES_SQL}")
def qa_samples(t):
    path = _samples_file(t)
    return _sample_rows(sources.samples_from_json(t("conversations").sparkSession, path))


@query(f"SELECT {_SAMPLE_COLUMNS} FROM {_SAMPLES_SQL} WHERE idx < 50")
def qa_samples_first(t):
    path = _samples_file(t)
    return _sample_rows(sources.samples_from_json(t("conversations").sparkSession, path, 50))


def _corpus_file(t) -> str:
    item = F.struct(F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("url"), F.col("page_id").alias("id"), F.concat(F.lit("page "), "page_id").alias("title"), F.col("html").alias("body"), F.when(F.col("page_id") % 2 == 0, F.col("html")).alias("content"), F.col("url").alias("text"), F.lit("web").alias("source"))
    pages = t("pages")
    return _save_list(pages, ["page_id"], item, shared.fresh_path(pages.sparkSession, "files") + "/corpus.json")


@query("""SELECT CASE WHEN page_id % 5 <> 0 THEN substr(md5(url), 1, 12) ELSE 'doc_' || (row_number() OVER (ORDER BY page_id) - 1) END AS doc_id, html AS content, 'page ' || page_id AS title,
CASE WHEN page_id % 5 <> 0 THEN url ELSE '' END AS url, 'web' AS source, '' AS author FROM pages""")
def news_corpus_file(t):
    found = sources.news_corpus_from_json(t("pages").sparkSession, _corpus_file(t))
    return found.select("doc_id", "content", "title", *(F.col("metadata")[c].alias(c) for c in ("url", "source", "author")))


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN page_id % 2 = 0 THEN html ELSE url END AS content, 'page ' || page_id AS title, 'web' AS source FROM pages")
def plain_corpus_file(t):
    found = sources.corpus_from_json(t("pages").sparkSession, _corpus_file(t))
    return found.select("doc_id", "content", "title", F.col("metadata")["source"].alias("source"))


@query("""SELECT * FROM (VALUES ('vector', 'chunk_size', '128'), ('vector', 'chunk_overlap', '50'), ('vector', 'top_k', '10'), ('graph', 'paths_per_chunk', '10'), ('graph', 'max_cluster_size', '7'), ('graph', 'top_k', '10'), ('graph', 'seed', '1'),
('generation', 'max_context', '15000'), ('evaluation', 'max_samples', '25'), ('evaluation', 'dataset', ''), ('evaluation', 'fuzzy_threshold', '0.8')) AS t(section, key, value)""")
def settings_file(t):
    """Settings saved as YAML and loaded."""
    spark = t("region").sparkSession
    changed = config.Settings(vector=config.VectorSettings(chunk_size=128), graph=config.GraphSettings(max_cluster_size=7), evaluation=config.EvaluationSettings(max_samples=25))
    path = shared.fresh_path(spark, "settings") + "/settings.yaml"
    with shared.saving(path) as out:
        out.write(config.text(changed).encode())
    loaded = dataclasses.asdict(config.parsed(shared.load(path).decode()))
    return _rows(spark, [(s, k, str(v)) for s in ("vector", "graph", "generation", "evaluation") for k, v in loaded[s].items()], "section string, key string, value string")


# --- stores ---------------------------------------------------------------------------------------


@query(_knn_sql("q.vec_id % 100 = 0").replace("vec_id, score FROM (", "CAST(vec_id AS VARCHAR) AS chunk_id, score FROM (", 1))
def vector_store_search(t):
    """Chunks added in two parts, the second over some of the first; the index opened anew and searched."""
    e = t("embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    store = _store(e.sparkSession)
    store.upsert("chunks", e.where("vec_id % 3 <> 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "chunk_id")
    store.upsert("chunks", e, "chunk_id")
    opened = IndexStore(e.sparkSession, store.folder.path)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return knn.nearest(opened.read("chunks"), queries, 10, id_col="vec_id").select("query_id", "rank", F.col("vec_id").cast("string").alias("chunk_id"), "score")


@query(f"""WITH {_GEOGRAPHY}, ends AS (SELECT src_key AS key FROM edges UNION SELECT dst_key FROM edges UNION SELECT lower(c_name) FROM customer)
SELECT 'edge' AS kind, src_key || '|' || dst_key AS key, CAST(n AS VARCHAR) AS value FROM edges
UNION ALL SELECT 'node', key, coalesce(c_name, key) FROM ends LEFT JOIN customer ON lower(c_name) = key
UNION ALL SELECT 'community', CAST(label AS VARCHAR), CAST(count(*) AS VARCHAR) FROM embeddings GROUP BY label""")
def graph_store_tables(t):
    """The graph's tables saved, opened anew and read."""
    edges = graph.merge_relations(_geography(t))
    store = _store(edges.sparkSession)
    tables = _labels(t).groupBy("community_id").agg(F.array_sort(F.collect_list("node_key")).alias("entity_names"))
    store.write("mark", edges=edges, nodes=graph.with_implicit_nodes(graph.merge_entities(_people(t)), edges), communities=tables)
    opened = IndexStore(edges.sparkSession, store.folder.path)
    one = lambda kind, key, value, name: opened.read(name).select(F.lit(kind).alias("kind"), key.alias("key"), value.cast("string").alias("value"))
    found = one("edge", F.concat("src_key", F.lit("|"), "dst_key"), F.size("relations"), "edges").union(one("node", F.col("key"), F.col("name"), "nodes"))
    return found.union(one("community", F.col("community_id").cast("string"), F.size("entity_names"), "communities"))


@query("""SELECT * FROM (VALUES ('new: has', false), ('new: read is an error', true), ('written: has', true), ('written: current', true), ('written: other settings', false), ('empty: current', false), ('cleared: has', false), ('cleared: read is an error', true)) AS t(step, is_so)""")
def store_readiness(t):
    """What a store says of itself: new, written, with an empty table, and cleared."""
    e = t("embeddings").select("vec_id", "label")
    spark, store, said = e.sparkSession, _store(e.sparkSession), []

    def missing() -> bool:
        try:
            store.read("chunks")
        except FileNotFoundError:
            return True
        return False

    said += [("new: has", store.has("chunks")), ("new: read is an error", missing())]
    store.write("mark", chunks=e)
    said += [("written: has", store.has("chunks")), ("written: current", store.is_current("mark", "chunks")), ("written: other settings", store.is_current("else", "chunks"))]
    store.write("mark", chunks=e.limit(0))
    said.append(("empty: current", store.is_current("mark", "chunks")))
    store.clear()
    said += [("cleared: has", store.has("chunks")), ("cleared: read is an error", missing())]
    return _rows(spark, said, "step string, is_so boolean")


@query("SELECT * FROM (VALUES ('first', true), ('same', false), ('other settings', true), ('rebuild', true)) AS t(build, was_built)")
def cached_index(t):
    """The vector index is built for new content or settings only."""
    chunks = _documents(t).select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), "content", "metadata")
    store, embedder, other = _store(chunks.sparkSession), HashedEmbedder(16), config.Settings(vector=config.VectorSettings(chunk_size=99))
    built = [("first", config.Settings(), False), ("same", config.Settings(), False), ("other settings", other, False), ("rebuild", other, True)]
    return _rows(chunks.sparkSession, [(n, indexing.index_vectors_cached(store, chunks, embedder, s, rebuild)) for n, s, rebuild in built], "build string, was_built boolean")


@query("SELECT true AS vector, false AS graph, count(*) AS vector_count FROM embeddings")
def index_status(t):
    e = t("embeddings")
    store = _store(e.sparkSession)
    store.write(chunks=e)
    said = indexing.status(e.sparkSession, store.folder.path)
    return _rows(e.sparkSession, [(said["vector"], said["graph"], said["vector_count"])], "vector boolean, graph boolean, vector_count long")


@query("""WITH n AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '\\p{L}{2,}'), lambda x: regexp_matches(x, '^\\p{Lu}')), lambda x: lower(x)) AS names FROM documents),
c AS (SELECT *, CAST(least(greatest(len(names) - 1, 0), 10) AS INTEGER) AS r FROM n),
e AS (SELECT DISTINCT unnest(names[1:r + 1]) AS key FROM c),
p AS (SELECT names, unnest(range(1, r + 1)) AS i FROM c),
x AS (SELECT DISTINCT least(names[i], names[i + 1]) AS a, greatest(names[i], names[i + 1]) AS b FROM p)
SELECT true AS built, false AS again, (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM x) AS edges, (SELECT count(*) FROM e) AS embeddings""")
def graph_build(t):
    """The graph index of all documents, from extraction to entity vectors; the second build finds the first."""
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    store, settings = _store(chunks.sparkSession), config.Settings()
    build = lambda: indexing.build_graph_cached(store, chunks, OfflineChat(), HashedEmbedder(16), settings)
    built, again = build(), build()
    return indexing.index_stats(store).select(F.lit(built).alias("built"), F.lit(again).alias("again"), "entities", "nodes", "edges", "embeddings")


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark) AS document_count, 'vector' AS index_types, true AS vector, false AS graph")
def command_line_index(t):
    """index and status of the command line, over a folder of files."""
    spark = t("documents").sparkSession
    source, out, said = _save_files(_document_files(t), spark), shared.fresh_path(spark, "index"), io.StringIO()
    if cli.main(["index", "-i", source, "-o", out, "-t", "vector"]):
        raise RuntimeError("the index was not built")
    with contextlib.redirect_stdout(said):
        cli.main(["status", "-o", out])
    meta, status = Folder(spark, out).read_json("metadata.json"), json.loads(said.getvalue().splitlines()[-1])
    return _rows(spark, [(meta["document_count"], meta["index_types"], status["vector"] and status["vector_count"] > 0, status["graph"])], "document_count long, index_types string, vector boolean, graph boolean")


# --- reports --------------------------------------------------------------------------------------


def _told(t) -> DataFrame:
    d = t("labels").join(t("documents"), "doc_id")
    return d.select(F.col("doc_id").cast("string").alias("query_id"), F.col("lang").alias("query_type"), (F.col("quality") == 1).alias("is_correct"), F.col("source").alias("query"), F.col("lang").alias("ground_truth"), F.col("source").alias("prediction"), F.col("text").alias("context"))


@query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, lang, quality = 1 AS ok, source, substr(text, 1, 1000) AS context FROM labels JOIN documents USING (doc_id))
SELECT 'prediction' AS kind, query_id AS id, lang AS query_type, CASE WHEN ok THEN 1 ELSE 0 END::BIGINT AS n, context FROM p
UNION ALL SELECT 'accuracy', '', coalesce(lang, 'all'), count(*), '' FROM p GROUP BY GROUPING SETS ((lang), ())""")
def evaluation_files(t):
    """A method's predictions and the sizes of its types, saved and read."""
    rows = _told(t)
    path = shared.fresh_path(rows.sparkSession, "report")
    reports.save_result(rows, evaluation.accuracy_by_type(rows), path)
    read = rows.sparkSession.read
    found = read.schema("query_id string, query_type string, is_correct boolean, context string").json(f"{path}/predictions.json")
    counts = read.schema("query_type string, total long").json(f"{path}/accuracy.json")
    one = found.select(F.lit("prediction").alias("kind"), F.col("query_id").alias("id"), "query_type", F.col("is_correct").cast("long").alias("n"), "context")
    return one.union(counts.select(F.lit("accuracy"), F.lit(""), F.coalesce("query_type", F.lit("all")), "total", F.lit("")))


@query(f"""WITH p AS {catalogue._PREDICTIONS_SQL}
SELECT 'overall' AS kind, method_name AS name, count(*) FILTER (is_correct) AS n FROM p GROUP BY method_name
UNION ALL SELECT 'by_type', query_type, count(*) FILTER (is_correct AND method_name = 'm2') FROM p GROUP BY query_type
UNION ALL SELECT 'pairs', 'm1|m2', (SELECT count(*) FROM p x JOIN p y USING (query_id) WHERE x.method_name = 'm1' AND y.method_name = 'm2' AND x.is_correct AND y.is_correct)""")
def comparison_files(t):
    """The comparison of two methods, saved and read; accuracies as counts of right answers."""
    rows = catalogue._predictions(t)
    path, read = shared.fresh_path(rows.sparkSession, "report"), rows.sparkSession.read
    reports.save_comparison(evaluation.compare_overall(rows), evaluation.compare_by_type(rows, ["m1", "m2"]), evaluation.complementarity(rows, ["m1", "m2"]), path)
    overall = read.schema("method_name string, accuracy double, total long").json(f"{path}/comparison/overall")
    by_type = read.schema("query_type string, m1 double, m2 double").json(f"{path}/comparison/by_type")
    pairs = read.schema("method_1 string, method_2 string, both long").json(f"{path}/comparison/pairs")
    counts = rows.where("method_name = 'm2'").groupBy("query_type").agg(F.count("*").alias("total"))
    found = overall.select(F.lit("overall").alias("kind"), F.col("method_name").alias("name"), F.round(F.col("accuracy") * F.col("total")).cast("long").alias("n"))
    found = found.union(by_type.join(counts, "query_type").select(F.lit("by_type"), "query_type", F.round(F.col("m2") * F.col("total")).cast("long")))
    return found.union(pairs.select(F.lit("pairs"), F.concat_ws("|", "method_1", "method_2"), "both"))


# --- providers ------------------------------------------------------------------------------------


class _Unreachable(OSError):
    pass


@query("""SELECT n_name, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey * 10 + 1 WHEN n_nationkey % 3 = 0 AND n_nationkey > 0 THEN least(n_nationkey * 1000 // 4, 16384) ELSE 4096 END AS reply_limit FROM nation""")
def model_limits(t):
    """What a provider's pages say of models: half have a page of their own, the others are in the
    list, and a third is nowhere."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            limits = []
            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                info = {"id": name, "context_length": key * 1000} if key % 3 == 0 else {"id": name, "top_provider": {"max_completion_tokens": key * 10 + 1}}

                def fetch(page, key=key, name=name, info=info):
                    if page.endswith(name):
                        if key % 2 or key % 3 == 2:
                            raise _Unreachable(page)
                        return {"data": info}
                    return {"data": [{"id": "another"}] + [info] * (key % 3 != 2)}

                limits.append(output_limit(model_info(name, "http://provider", fetch)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(limits, pa.int32())], ["n_name", "reply_limit"])

    return t("nation").select("n_nationkey", "n_name").mapInArrow(run, "n_name string, reply_limit int")


@dataclasses.dataclass(frozen=True)
class _Backwards(HttpEmbedder):
    """A provider that answers in reverse order: the length of each text."""

    def _post(self, path: str, body: dict) -> dict:
        return {"data": [{"index": i, "embedding": [float(len(x))]} for i, x in reversed(list(enumerate(body["input"])))]}


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents")
def embedding_order(t):
    """Each text has its own embedding, though the provider's reply is in another order."""
    found = knn.embed(t("documents").select("doc_id", "text"), "text", _Backwards("http://provider", "m", dimension=1, batch=7))
    return found.select("doc_id", F.col("embedding")[0].cast("int").alias("length"))


@dataclasses.dataclass(frozen=True)
class _Mirror(HttpChat):
    """A provider that replies with the request."""

    def _post(self, path: str, body: dict) -> dict:
        return {"choices": [{"message": {"content": "  " + json.dumps(body) + "\n"}}]}


_SYSTEMS = {"answer": prompts.ANSWER_SYSTEM, "summary": prompts.SUMMARY_SYSTEM, "classify": prompts.CLASSIFY_SYSTEM, "extract": prompts.EXTRACT_SYSTEM}


@query("SELECT n_name AS prompt, kind, system, n_name AS asked, 64 AS max_tokens FROM nation, (VALUES " + ", ".join(f"('{k}', {_quoted(v)})" for k, v in _SYSTEMS.items()) + ") AS s(kind, system)")
def chat_messages(t):
    """The messages that reach a chat model, under each of the system prompts."""
    nations = t("nation").select(F.col("n_name").alias("prompt"))
    found = None
    for kind, system in _SYSTEMS.items():
        part = summaries.chat_column(nations.withColumn("kind", F.lit(kind)), "prompt", _Mirror("http://provider", "m"), "reply", system, 64)
        found = part if found is None else found.union(part)
    message = lambda k: F.get_json_object("reply", f"$.messages[{k}].content")
    return found.select("prompt", "kind", message(0).alias("system"), message(1).alias("asked"), F.get_json_object("reply", "$.max_tokens").cast("int").alias("max_tokens"))


@query(f"SELECT item_id, {_quoted(prompts.ENTITIES_TEMPLATE.partition('{query}')[0])} || text AS prompt FROM benchmark")
def query_entity_prompts(t):
    return t("benchmark").select("item_id", prompts.query_entities_prompt(F.col("text")).alias("prompt"))


# --- flows ----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT item_id, 'Intro ' || item_id AS a, 'One of ' || item_id AS b, 'Two' AS c, 'Three' AS d FROM benchmark)
SELECT item_id || '::chunk_0' AS chunk_id, a AS content, NULL AS header_1, NULL AS header_2 FROM p
UNION ALL SELECT item_id || '::chunk_1', '# Top' || chr(10) || b, 'Top', NULL FROM p
UNION ALL SELECT item_id || '::chunk_2', '## Sub ' || item_id || chr(10) || c || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```', 'Top', 'Sub ' || item_id FROM p
UNION ALL SELECT item_id || '::chunk_3', '# Next' || chr(10) || d, 'Next', NULL FROM p""")
def markdown_chunks(t):
    """Chunks of Markdown, cut at headings, not at those inside a fence."""
    k = F.col("item_id").cast("string")
    text = F.concat(F.lit("Intro "), k, F.lit("\n\n# Top\nOne of "), k, F.lit("\n\n## Sub "), k, F.lit("\nTwo\n```\n# no heading\n```\n# Next\nThree\n"))
    docs = t("benchmark").select(k.alias("doc_id"), text.alias("content"), F.lit("t").alias("title"), F.expr("cast(null as map<string,string>)").alias("metadata"))
    found = chunking.chunk_documents(docs, markdown=True)
    return found.select("chunk_id", "content", F.col("metadata")["header_1"].alias("header_1"), F.col("metadata")["header_2"].alias("header_2"))


def _first_words(prompt: str) -> str:
    return f"array_to_string(({catalogue._WORDS.format(prompt)})[1:30], ' ')"


@query(f"""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, 'Which language has ' || doc_id || '?' AS query, lang AS ground_truth, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'lang ' || lang || ' ' || source END AS context FROM documents),
p AS (SELECT *, CASE WHEN context = '' THEN {_quoted(retrieval.NO_ANSWER)} ELSE {_first_words("('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:')")} END AS prediction FROM a)
SELECT query_id, ground_truth, prediction, contains(lower(prediction), ground_truth) AS is_correct, 'vector_rag' AS method_name FROM p""")
def evaluated_answers(t):
    """Answers from given contexts, beside their truths: questions without a context have the fixed one."""
    d = t("documents")
    samples = d.select(F.col("doc_id").cast("string").alias("query_id"), F.concat(F.lit("Which language has "), "doc_id", F.lit("?")).alias("query"), F.col("lang").alias("answer"), F.lit("x").alias("query_type"))
    contexts = d.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("query_id"), F.concat_ws(" ", F.lit("lang"), "lang", "source").alias("context"), F.lit(1).alias("num_chunks"))
    found = benchmark.evaluate(samples, contexts, OfflineChat(), "vector_rag", evaluation.contains_metric())
    return found.select("query_id", "ground_truth", "prediction", "is_correct", "method_name")


def _document_service(t) -> Service:
    """A service over an index whose chunks are the documents."""
    d = t("documents")
    chunks = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), F.col("text").alias("content"), F.create_map(F.lit("title"), "source").alias("metadata"))
    store = _store(d.sparkSession)
    indexing.index_vectors(store, chunks, HashedEmbedder(catalogue.DIM), replace=True)
    return Service(store, HashedEmbedder(catalogue.DIM), OfflineChat(), dataclasses.replace(config.SERVICE, vector=config.VectorSettings(top_k=10)))


def _questions(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


_SHOWN = " ".join(f"{catalogue._SHOTS}\n\n".split()[:30])


@query(f"""WITH {_ITEM_HITS}, blocks AS (SELECT item_id, sum(length('[Источник: ' || source || ']' || chr(10) || text)) OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS upto FROM hits JOIN documents USING (doc_id))
SELECT CAST(item_id AS VARCHAR) AS query_id, {_quoted(_SHOWN)} AS answer, CAST(count(*) FILTER (upto <= 15000) AS INTEGER) AS n_blocks FROM blocks GROUP BY item_id""")
def service_answers(t):
    """The service's answers from the vector index: retrieval, packing, the prompt with examples, the model."""
    return _document_service(t).answer(_questions(t), "vector").select("query_id", "answer", "n_blocks")


@query(f"SELECT CAST(item_id AS VARCHAR) AS query_id, {_quoted(retrieval.NO_ANSWER)} AS answer, true AS silent FROM benchmark")
def service_without_hits(t):
    """Without a graph index no question has hits: the fixed answer, and no model is asked."""
    return _document_service(t).answer(_questions(t), "graph").select("query_id", "answer", F.col("n_blocks").isNull().alias("silent"))


@query("SELECT true AS vector, false AS graph, true AS vector_after, true AS graph_after")
def loaded_indexes(t):
    service = _document_service(t)
    before = service.loaded()
    edges = graph.merge_relations(_geography(t))
    service.store.write(edges=edges, entity_vectors=t("embeddings").select(F.col("vec_id").alias("node_key"), "embedding"))
    after = service.loaded()
    return _rows(edges.sparkSession, [(before["vector"], before["graph"], after["vector"], after["graph"])], "vector boolean, graph boolean, vector_after boolean, graph_after boolean")


_LOCAL = catalogue.ORACLES["local_search"].removeprefix("WITH ")
_LOCAL_CTES, _, _LOCAL_SELECT = _LOCAL.rpartition("\nSELECT query_id, coalesce(")


@query(f"""WITH v AS (SELECT query_id, string_agg('vector ' || vec_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n FROM ({_knn_sql("q.vec_id % 100 = 0")}) GROUP BY query_id),
{_LOCAL_CTES}, l AS (SELECT query_id, coalesce({_LOCAL_SELECT}),
w AS (SELECT coalesce(string_agg(summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY community_id), '') AS context, CAST(count(*) AS INTEGER) AS n FROM c WHERE summary <> ''),
q AS (SELECT vec_id AS query_id, vec_id % 200 = 0 AS reasons FROM embeddings WHERE vec_id % 100 = 0),
a AS (SELECT q.query_id, reasons, coalesce(v.context, '') AS vc, coalesce(v.n, 0) AS vn, coalesce(l.context, '') AS lc, coalesce(l.num_chunks, 0) AS ln FROM q LEFT JOIN v USING (query_id) LEFT JOIN l USING (query_id))
SELECT 'vector_rag' AS method_name, query_id, vc AS context, vn AS num_chunks FROM a UNION ALL SELECT 'graphrag_local', query_id, lc, ln FROM a
UNION ALL SELECT 'graphrag_global', query_id, w.context, w.n FROM q, w
UNION ALL SELECT 'hybrid_selection', query_id, CASE WHEN reasons THEN lc ELSE vc END, CASE WHEN reasons THEN ln ELSE vn END FROM a
UNION ALL SELECT 'hybrid_integration', query_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), CASE WHEN vc <> '' THEN {_quoted(retrieval.VECTOR_LABEL)} || vc END, CASE WHEN lc <> '' THEN {_quoted(retrieval.GRAPH_LABEL)} || lc END), vn + ln FROM a""")
def retriever_contexts(t):
    """All five methods by name, over one index."""
    e = t("embeddings")
    store = _store(e.sparkSession)
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("vector "), "vec_id").alias("content"), "embedding")
    store.write(chunks=chunks, entity_vectors=e.select(F.col("vec_id").alias("node_key"), "embedding"), membership=e.select(F.col("vec_id").alias("node_key"), F.col("label").alias("community_id")), communities=_summaries(t))
    asked = F.when(F.col("vec_id") % 200 == 0, F.lit("Why is that?")).otherwise(F.lit("Who is it?"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), asked.alias("query"), F.col("embedding").alias("query_embedding"))
    retrievers = benchmark.Retrievers(queries, store, OfflineChat(), config.Settings())
    found = None
    for method in config.METHODS:
        part = retrievers.of(method).select(F.lit(method).alias("method_name"), "query_id", "context", "num_chunks")
        found = part if found is None else found.union(part)
    return found


@query("SELECT * FROM (VALUES ('vector_rag', true, false), ('graphrag_local', false, true), ('graphrag_global', false, true), ('hybrid_selection', true, true), ('hybrid_integration', true, true)) AS t(method_name, vector, graph)")
def method_needs(t):
    return _rows(t("region").sparkSession, [(m, *benchmark.needs((m,))) for m in config.METHODS], "method_name string, vector boolean, graph boolean")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'query must be a text' WHEN turn % 4 = 2 THEN 'method must be one of vector, graph, hybrid' ELSE CASE WHEN turn % 4 = 3 THEN 'graph' ELSE 'hybrid' END END AS said FROM conversations""")
def request_checks(t):
    """Requests of the HTTP façade: good ones have their method, bad ones an error."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            said = []
            for turn, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = ({"query": text}, {"query": " "}, {"query": text, "method": "other"}, {"query": text, "method": "graph", "top_k": 3})[turn % 4]
                try:
                    said.append(api.checked(body)["method"])
                except ValueError as e:
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(said, pa.string())], ["conv_id", "turn", "said"])

    return t("conversations").select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, said string")


@query("""WITH b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
SELECT m.method_name, CAST(idx AS VARCHAR) AS query_id, text AS query FROM b, (VALUES ('vector_rag'), ('graphrag_local'), ('graphrag_global'), ('hybrid_selection'), ('hybrid_integration')) AS m(method_name) WHERE idx < 10""")
def command_line_benchmark(t):
    """The comparison of all methods from the command line; its reports read from their files."""
    b = t("benchmark")
    spark = b.sparkSession
    path, out = shared.fresh_path(spark, "files"), shared.fresh_path(spark, "results")
    samples = _save_list(b, ["item_id"], F.struct(F.col("text").alias("query"), F.lit("x").alias("answer")), f"{path}/samples.json")
    corpus = _save_list(b, ["item_id"], F.struct(F.concat(F.lit("http://item/"), "item_id").alias("url"), F.col("text").alias("body")), f"{path}/corpus.json")
    if cli.main(["benchmark", "--samples", samples, "--corpus", corpus, "--output-dir", out, "--max-samples", "10", "--no-cache"]):
        raise RuntimeError("the comparison was not made")
    found = None
    for method in config.METHODS:
        part = spark.read.csv(f"{out}/{method}/predictions.csv", header=True, quote='"', escape='"', multiLine=True).select(F.lit(method).alias("method_name"), "query_id", "query")
        found = part if found is None else found.union(part)
    return found


# --- graphs ---------------------------------------------------------------------------------------


@query(f"WITH {_GEOGRAPHY} SELECT source, relation, target FROM rel ORDER BY ord, source, target, relation LIMIT 100")
def graph_edges(t):
    return graph.graph_data(_geography(t), 100)[1]


@query(f"""WITH {_GEOGRAPHY}, f AS (SELECT * FROM rel ORDER BY ord, source, target, relation LIMIT 100), n AS (SELECT source AS id FROM f UNION SELECT target FROM f)
SELECT '  "' || id || '";' AS line FROM n UNION ALL SELECT '  "' || source || '" -> "' || target || '" [label="' || relation || '"];' FROM f""")
def graph_page(t):
    """The graph as the browser page draws it, line by line."""
    spark = t("region").sparkSession
    store = _store(spark)
    store.write(relations=_geography(t))
    drawn = ui.dot(api.graph_data(Service(store, HashedEmbedder(8), OfflineChat()), 100))
    return _rows(spark, [(x,) for x in drawn.split("\n")[1:-1]], "line string")


def _stars(t) -> DataFrame:
    """Each label's vectors about the label's hub, and the hubs in a row: ten stars in one component."""
    e = t("embeddings").select("vec_id", "label")
    hub = lambda c: F.concat(F.lit("hub "), c.cast("string"))
    one = lambda rows, ord_, source, target: rows.select(F.array(ord_).alias("ord"), source.alias("source"), target.alias("target"), F.lit("R").alias("relation"), F.lit("").alias("description"), F.lit("c").alias("source_chunk_id"))
    spokes = one(e, F.col("vec_id"), hub(F.col("label")), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    labels = e.select("label").distinct().where("label > 0")
    return spokes.union(one(labels, F.col("label").cast("long") - 100, hub(F.col("label") - 1), hub(F.col("label"))))


@query("""WITH s AS (SELECT 'hub ' || label AS node_key, label FROM embeddings UNION SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 9, '0'), label FROM embeddings),
f AS (SELECT label, min(node_key) AS least FROM s GROUP BY label), n AS (SELECT label, row_number() OVER (ORDER BY least) - 1 AS community_id FROM f)
SELECT CAST(community_id + level * (SELECT count(*) FROM f) AS INTEGER) AS community_id, level, node_key FROM s JOIN n USING (label), (VALUES (0), (1)) AS l(level)""")
def star_communities(t):
    """Communities of a graph whose best partition is known: its stars; as they are large, each is
    looked at again on the next level and stays whole."""
    return communities.detect(graph.merge_relations(_stars(t))).select(F.col("community_id").cast("int").alias("community_id"), "level", "node_key")


@query(f"""WITH {_GEOGRAPHY} SELECT src_key || '|' || dst_key AS pair, n AS n_relations, (SELECT count(*) FROM edges) AS edges FROM edges""")
def edge_totals(t):
    counted = graph.edge_counts(_geography(t))
    return counted.select(F.concat_ws("|", "src_key", "dst_key").alias("pair"), "n_relations").crossJoin(counted.agg(F.count("*").alias("edges")))  # one row


@query("SELECT * FROM (VALUES ('outer', true), ('inner', true), ('broken', false)) AS t(name, is_done)")
def spans(t):
    """Spans of work, one inside another and one that fails, as a listener hears of them."""
    heard: list[tuple[str, bool]] = []

    def listener(name, took, error):
        heard.append((name, error is None and took >= 0))

    tracing.listeners.append(listener)
    try:
        with tracing.span("outer"):
            tracing.observed("inner")(lambda: t("region").count())()
        with contextlib.suppress(ValueError), tracing.span("broken"):
            raise ValueError("broken")
    finally:
        tracing.listeners.remove(listener)
    return _rows(t("region").sparkSession, heard, "name string, is_done boolean")
