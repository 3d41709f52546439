"""The engine's queries with their DuckDB counterparts: each operator over whole fixture tables.

Names of columns and their types are the same on both sides; floating results are rounded there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import prompts, text, vectors
from .operators import chunking, communities, evaluation, graph, knn, retrieval, summaries
from . import shared
from .providers import HashedEmbedder, OfflineChat
from .sources import documents as sources
from .plans import indexing
from .sources import index_store, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIM = 64


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(oracle: str | None = None):
    """Registers a function of (table reader) under its name, with its SQL."""

    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: _read(spark, sf_dir, table))
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# SQL that several oracles share; fixed values come from where they are defined.
_SOURCE, _AUTHOR, _SEPARATOR = _quoted(f"[{text.SOURCE_LABEL}: "), _quoted(f", {text.AUTHOR_LABEL}: "), _quoted(prompts.SEPARATOR)
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SPLIT = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _normal(x: str) -> str:
    article = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)(?:$|([^\p{{L}}\p{{N}}_]))', '\1 \3', 'g')"
    bare = article.format(article.format(f"lower({x})"))
    return rf"trim(regexp_replace(regexp_replace({bare}, '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"


_PAIRS_SQL = """
SELECT u.conv_id AS conv_id, u.turn AS turn, u.text AS truth, a.text AS prediction
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def _pairs(t) -> DataFrame:
    """A user's turn as the truth, the assistant's next one as the prediction."""
    c = t("conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("truth"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"])


# --- documents and texts --------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, source AS title, lang FROM documents")
def doc_projection(t):
    rows = t("documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    return sources.corpus_to_documents(rows).select("doc_id", "content", "title", F.col("metadata")["lang"].alias("lang"))


@query("""SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN substr(md5(url), 1, 12) ELSE 'doc_' || page_id END AS doc_id, coalesce(html, '') AS content, url FROM pages""")
def url_doc_ids(t):
    p = t("pages")
    docs = p.select("page_id", text.url_id(F.col("url"), F.col("page_id")).alias("doc_id"), F.coalesce("html", F.lit("")).alias("content"), "url")
    return docs


@query("""SELECT substr(md5(url), 1, 12) AS doc_id, coalesce(html, '') AS content, '' AS title, coalesce(url, '') AS url, 'web' AS source, '' AS author FROM pages""")
def news_corpus(t):
    rows = t("pages").select(F.col("page_id").alias("idx"), "url", F.lit("").alias("title"), F.col("html").alias("body"), F.lit("web").alias("source"), F.lit(None).cast("string").alias("published_at"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("author"))
    return sources.news_corpus(rows).select("doc_id", "content", "title", F.col("metadata")["url"].alias("url"), F.col("metadata")["source"].alias("source"), F.col("metadata")["author"].alias("author"))


@query(f"SELECT doc_id, CAST(floor(len({_WORDS.format('text')}) / 0.75) AS INTEGER) AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, {_SPLIT.format('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def sentence_split(t):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query(r"""SELECT 'document' AS kind, doc_id AS id, len(list_filter(string_split(text, chr(10))[1:50], lambda x: regexp_matches(x, '^\s*#'))) > 0 AS markdown FROM documents
UNION ALL SELECT 'page', page_id, len(list_filter(string_split(html, chr(10))[1:50], lambda x: regexp_matches(x, '^\s*#'))) > 0 FROM pages""")
def markdown_detect(t):
    d = t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.is_markdown(F.col("text")).alias("markdown"))
    return d.union(t("pages").select(F.lit("page"), "page_id", text.is_markdown(F.col("html"))))


def _documents(t) -> DataFrame:
    d = t("documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.col("source").alias("title"), F.create_map(F.lit("lang"), "lang").alias("metadata"))


def _estimate(x: str) -> str:
    return f"CAST(floor(len({_WORDS.format(x)}) / 0.75) AS INTEGER)"


# One step a sentence for all documents at once: open parts and their tokens, place, chunks so far.
_CHUNKS = f"""
WITH RECURSIVE s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang, {_SPLIT.format('text')} AS s FROM documents),
r(doc_id, i, parts, tokens, pos, begins, done) AS (
  SELECT doc_id, 0, CAST([] AS VARCHAR[]), CAST([] AS INTEGER[]), 0, 0, CAST([] AS STRUCT(c VARCHAR, a INTEGER, b INTEGER)[]) FROM s
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN n > 256 THEN w[whole + 1:] WHEN held + n > 256 THEN list_append(parts[keep:], t) ELSE list_append(parts, t) END,
    CASE WHEN n > 256 THEN list_transform(w[whole + 1:], lambda x: 1) WHEN held + n > 256 THEN list_append(est[keep:], n) ELSE list_append(tokens, n) END,
    pos + CAST(length(t) AS INTEGER) + 1,
    CASE WHEN n > 256 THEN CASE WHEN whole > 0 THEN pos + CAST(length(runs[len(runs)]) AS INTEGER) + 1 WHEN len(parts) > 0 THEN pos ELSE begins END WHEN held + n > 256 THEN pos ELSE begins END,
    CASE WHEN n > 256 OR held + n > 256 THEN done || closed || list_transform(CASE WHEN n > 256 THEN range(1, len(runs) + 1) ELSE [] END,
        lambda k: struct_pack(c := runs[k], a := CASE WHEN k > 1 THEN pos + CAST(length(runs[k - 1]) AS INTEGER) + 1 WHEN len(parts) > 0 THEN pos ELSE begins END, b := pos + CAST(length(runs[k]) AS INTEGER))) ELSE done END
  FROM (SELECT *, CASE WHEN len(parts) > 0 THEN [struct_pack(c := array_to_string(parts, ' '), a := begins, b := pos)] ELSE [] END AS closed,
      list_transform(range(0, whole // 256), lambda k: array_to_string(w[k * 256 + 1:k * 256 + 256], ' ')) AS runs,
      len(parts) + 1 - len(list_filter(range(1, len(parts) + 1), lambda j: list_sum(est[j:]) <= 50)) AS keep
    FROM (SELECT r.*, s.s[i + 1] AS t, {_estimate('s.s[i + 1]')} AS n, {_WORDS.format('s.s[i + 1]')} AS w, len({_WORDS.format('s.s[i + 1]')}) // 256 * 256 AS whole, coalesce(list_sum(tokens), 0) AS held,
        list_transform(parts, lambda x: {_estimate('x')}) AS est
      FROM r JOIN s USING (doc_id) WHERE i < len(s.s)))),
ended AS (
  SELECT r.doc_id, source, lang, CASE WHEN len(parts) > 0 THEN list_append(done, struct_pack(c := array_to_string(parts, ' '), a := begins, b := pos)) ELSE done END AS done
  FROM r JOIN s USING (doc_id) WHERE i = len(s.s))
SELECT doc_id || '::chunk_' || (k - 1) AS chunk_id, doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, done[k].c AS content, done[k].a AS start_idx, done[k].b AS end_idx, source AS title, lang
FROM ended, LATERAL (SELECT unnest(range(1, len(done) + 1)) AS k)"""


@query(_CHUNKS)
def chunks(t):
    return chunking.chunk_documents(_documents(t)).select("chunk_id", "doc_id", "chunk_index", "content", "start_idx", "end_idx", F.col("metadata")["title"].alias("title"), F.col("metadata")["lang"].alias("lang"))


@query(f"SELECT doc_id, {_SOURCE} || source || {_AUTHOR} || lang || ']' || chr(10) || text AS block FROM documents")
def context_blocks(t):
    return t("documents").select("doc_id", text.context_block(F.col("text"), F.create_map(F.lit("title"), "source", F.lit("author"), "lang")).alias("block"))


@query(f"""SELECT 'document' AS kind, doc_id AS id, {_normal('text')} AS answer FROM documents
UNION ALL SELECT 'benchmark', item_id, {_normal('text')} FROM benchmark
UNION ALL SELECT 'turn', conv_id * 1000 + turn, {_normal('text')} FROM conversations""")
def answer_normalize(t):
    one = lambda kind, table, key: t(table).select(F.lit(kind).alias("kind"), key.alias("id"), text.normalize_answer(F.col("text")).alias("answer"))
    return one("document", "documents", F.col("doc_id")).union(one("benchmark", "benchmark", F.col("item_id"))).union(one("turn", "conversations", F.col("conv_id") * 1000 + F.col("turn")))


@query(f"SELECT conv_id, turn, {_normal('prediction')} = {_normal('truth')} AS is_correct FROM ({_PAIRS_SQL})")
def match_exact(t):
    return _pairs(t).select("conv_id", "turn", evaluation.exact_metric()(F.col("prediction"), F.col("truth")).alias("is_correct"))


@query(f"SELECT conv_id, turn, contains({_normal('prediction')}, {_normal('truth')}) AS is_correct FROM ({_PAIRS_SQL})")
def match_contains(t):
    return _pairs(t).select("conv_id", "turn", evaluation.contains_metric()(F.col("prediction"), F.col("truth")).alias("is_correct"))


@query(f"""WITH p AS (SELECT conv_id, turn, list_filter(list_distinct(string_split({_normal('prediction')}, ' ')), lambda x: x <> '') AS a,
  list_filter(list_distinct(string_split({_normal('truth')}, ' ')), lambda x: x <> '') AS b FROM ({_PAIRS_SQL}))
SELECT conv_id, turn, CASE WHEN len(b) = 0 THEN len(a) = 0 ELSE len(list_intersect(a, b)) / greatest(len(list_distinct(a || b)), 1) >= 0.8 END AS is_correct FROM p""")
def match_fuzzy(t):
    return _pairs(t).select("conv_id", "turn", evaluation.fuzzy_metric()(F.col("prediction"), F.col("truth")).alias("is_correct"))


@query("SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 6, '0') || substr(text, 1, 500) AS shown FROM documents")
def truncation(t):
    return t("documents").select("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), text.shortened(F.col("text"), 500)).alias("shown"))


@query("SELECT item_id, 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' AS prompt FROM benchmark")
def simple_prompts(t):
    return t("benchmark").select("item_id", prompts.simple_prompt(F.col("text"), F.col("text")).alias("prompt"))


# --- evaluation -----------------------------------------------------------------------------------


@query("SELECT 'lang' AS of, lang AS query_type, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY event_type")
def type_distribution(t):
    one = lambda of, table, col: evaluation.type_distribution(t(table), col).select(F.lit(of).alias("of"), "query_type", "n")
    return one("lang", "documents", "lang").union(one("event", "events", "event_type"))


def _predictions(t) -> DataFrame:
    """Two methods: one is right where the quality is 1, the other where the text is not toxic."""
    both = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    named = lambda m, c: F.struct(F.lit(m).alias("m"), c.alias("c"))
    methods = F.array(named("m1", F.col("quality") == 1), named("m2", F.col("toxic") == 0))
    return both.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query_type"), F.explode(methods).alias("x")).select("query_id", "query_type", F.col("x.m").alias("method_name"), F.col("x.c").alias("is_correct"))


_PREDICTIONS_SQL = """(SELECT doc_id AS query_id, lang AS query_type, 'm1' AS method_name, quality = 1 AS is_correct FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, lang, 'm2', toxic = 0 FROM labels JOIN documents USING (doc_id))"""


@query(f"SELECT round(coalesce(avg(CAST(is_correct AS INTEGER)), 0.0), 9) AS accuracy, count(*) AS total FROM {_PREDICTIONS_SQL} WHERE method_name = 'm1'")
def accuracy(t):
    return evaluation.accuracy(_predictions(t).where("method_name = 'm1'")).select(F.round("accuracy", 9).alias("accuracy"), "total")


@query(f"""SELECT query_type, grouping(query_type) = 1 AS is_overall, count(*) FILTER (is_correct) AS correct, count(*) AS total, round(avg(CAST(is_correct AS INTEGER)), 9) AS accuracy
FROM {_PREDICTIONS_SQL} WHERE method_name = 'm1' GROUP BY GROUPING SETS ((query_type), ())""")
def accuracy_by_type(t):
    return evaluation.accuracy_by_type(_predictions(t).where("method_name = 'm1'")).withColumn("accuracy", F.round("accuracy", 9))


@query(f"SELECT method_name, round(avg(CAST(is_correct AS INTEGER)), 9) AS accuracy, count(*) AS total FROM {_PREDICTIONS_SQL} GROUP BY method_name")
def compare_overall(t):
    return evaluation.compare_overall(_predictions(t)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"SELECT query_type, round(avg(CAST(is_correct AS INTEGER)) FILTER (method_name = 'm1'), 9) AS m1, round(avg(CAST(is_correct AS INTEGER)) FILTER (method_name = 'm2'), 9) AS m2 FROM {_PREDICTIONS_SQL} GROUP BY query_type")
def compare_by_type(t):
    return evaluation.compare_by_type(_predictions(t), ["m1", "m2"]).select("query_type", F.round("m1", 9).alias("m1"), F.round("m2", 9).alias("m2"))


@query(f"""WITH p AS {_PREDICTIONS_SQL}, c AS (SELECT count(*) FILTER (x.is_correct AND NOT y.is_correct) AS only_1, count(*) FILTER (y.is_correct AND NOT x.is_correct) AS only_2,
count(*) FILTER (x.is_correct AND y.is_correct) AS "both", count(*) FILTER (NOT x.is_correct AND NOT y.is_correct) AS neither, count(*) AS total
FROM p x JOIN p y USING (query_id) WHERE x.method_name = 'm1' AND y.method_name = 'm2')
SELECT 'm1' AS method_1, 'm2' AS method_2, *, round(only_1 * 100.0 / total, 6)::DOUBLE AS only_1_pct, round(only_2 * 100.0 / total, 6)::DOUBLE AS only_2_pct, round("both" * 100.0 / total, 6)::DOUBLE AS both_pct, round(neither * 100.0 / total, 6)::DOUBLE AS neither_pct FROM c""")
def complementarity(t):
    out = evaluation.complementarity(_predictions(t), ["m1", "m2"])
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in out.columns if c.endswith("_pct")})


# --- vectors --------------------------------------------------------------------------------------

_COSINE = "round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6)"
_VECTORS = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def _knn_sql(condition: str) -> str:
    return f"""SELECT query_id, CAST(rank - 1 AS INTEGER) AS rank, vec_id, score FROM (
SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, c.vec_id) AS rank
FROM {_VECTORS} q, {_VECTORS} c WHERE {condition}) WHERE rank <= 10"""


def _knn(t, condition: Column) -> DataFrame:
    e = t("embeddings")
    queries = e.where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return knn.nearest(e, queries, 10, id_col="vec_id")


@query(_knn_sql("q.vec_id = 0"))
def knn_single(t):
    return _knn(t, F.col("vec_id") == 0)


@query(_knn_sql("q.vec_id % 100 = 0"))
def knn_batch(t):
    return _knn(t, F.col("vec_id") % 100 == 0)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(e[i] / sqrt(list_dot_product(e, e)), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)")
def l2_normalize(t):
    return t("embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6) + 0.0)


_BUCKETS = f"""SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS w FROM documents) GROUP BY ALL"""


def _embedded(df: DataFrame) -> DataFrame:
    return knn.embed(df, "text", HashedEmbedder(DIM))


@query(_BUCKETS)
def hashed_embedding(t):
    e = _embedded(t("documents").select("doc_id", "text"))
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).where("w <> 0").select("doc_id", "bucket", F.col("w").cast("double").alias("weight"))


_ITEM_HITS = f"""
d AS (SELECT doc_id AS id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INTEGER) AS b, count(*)::DOUBLE AS x FROM (SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS w FROM documents) GROUP BY ALL),
q AS (SELECT item_id AS id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INTEGER) AS b, count(*)::DOUBLE AS x FROM (SELECT item_id, unnest({_WORDS.format('lower(text)')}) AS w FROM benchmark) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM d GROUP BY id), qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM q GROUP BY id),
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.x * d.x) / any_value(qn.n) / any_value(dn.n), 6) AS score FROM q JOIN d USING (b) JOIN qn ON qn.id = q.id JOIN dn ON dn.id = d.id GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)"""


def _item_hits(t) -> DataFrame:
    docs = _embedded(t("documents").select("doc_id", "text"))
    items = knn.embed(t("benchmark"), "text", HashedEmbedder(DIM), "query_embedding")
    return knn.nearest(docs, items.select("item_id", "query_embedding"), 10, id_col="doc_id", query_id="item_id")


@query(f"WITH {_ITEM_HITS} SELECT item_id, CAST(rank - 1 AS INTEGER) AS rank, doc_id, score FROM hits")
def nearest_documents(t):
    return _item_hits(t)


@query(f"""WITH {_ITEM_HITS},
first AS (SELECT item_id, doc_id, score, rank, source, text, row_number() OVER (PARTITION BY item_id, {_STRIP.format('lower(substr(text, 1, 200))')} ORDER BY rank) AS r
  FROM hits JOIN documents USING (doc_id)),
blocks AS (SELECT item_id, rank, score, {_SOURCE} || source || ']' || chr(10) || text AS block FROM first WHERE r = 1),
fits AS (SELECT *, sum(length(block)) OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS upto, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS f FROM blocks)
SELECT item_id, coalesce(string_agg(block, {_SEPARATOR} ORDER BY f) FILTER (upto <= 15000), '') AS context, CAST(count(*) FILTER (upto <= 15000) AS INTEGER) AS n_blocks FROM fits GROUP BY item_id""")
def context_for_items(t):
    """Flagship: items are embedded, the nearest documents found, near copies dropped, and what is
    left packed into a context of 15,000 characters."""
    docs = t("documents").select("doc_id", F.col("text"), F.create_map(F.lit("title"), "source").alias("metadata"))
    hits = _item_hits(t).join(docs, "doc_id").select(F.col("item_id").alias("query_id"), "rank", "score", F.col("text").alias("content"), "metadata")
    return retrieval.pack_context(retrieval.retrieve(hits, hits.limit(0), "hybrid")).select(F.col("query_id").alias("item_id"), "context", "n_blocks")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def retrieval_relevance(t):
    """Documents that hold an item's text.  An item of five words or more is sought only in the
    documents with its words two to four in sequence: these are whole words of any text that holds
    it, so no pair of rows is formed otherwise.  Shorter items, which need not hold three whole
    words of the document, are compared with every document, by broadcast if their counted size allows it."""
    lead = lambda w: F.array_join(w, " ")
    split = lambda x: F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = t("documents").select("doc_id", "text")
    items = t("benchmark").select("item_id", F.col("text").alias("item"), split(F.col("text")).alias("w"))
    short = items.where(F.size("w") < 5).select("item_id", "item")
    long = items.where(F.size("w") >= 5)
    words = docs.select("doc_id", split(F.col("text")).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: lead(F.slice("w", i, 3)))
    listed = words.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))  # ids and grams: texts are fetched for the pairs
    pairs = listed.join(long.select("item_id", lead(F.slice("w", 2, 3)).alias("gram")), "gram").select("item_id", "doc_id")
    found = pairs.join(docs, "doc_id").join(long.select("item_id", "item"), "item_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    size = short.agg(F.sum(F.octet_length("item") + 64)).first()[0]
    if size:
        short = F.broadcast(short) if size <= 32 << 20 else short
        found = found.union(docs.join(short, F.contains("text", "item")).select("item_id", "doc_id"))
    return found.distinct()


# --- retrieval ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY {_STRIP.format('lower(substr(text, 1, 200))')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_prefix(t):
    hits = t("documents").select(F.lit(0).alias("query_id"), F.lit(0).alias("source_ord"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return retrieval.first_of_prefix(hits).select(F.col("rank").alias("doc_id"), F.col("content").alias("text"))


_BLOCK = f"{_SOURCE} || source || ']' || chr(10) || text"


@query(f"""WITH b AS (SELECT source, doc_id, {_BLOCK} AS block, sum(length({_BLOCK})) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, coalesce(string_agg(block, {_SEPARATOR} ORDER BY doc_id) FILTER (upto <= 15000), '') AS context, CAST(count(*) FILTER (upto <= 15000) AS INTEGER) AS n_blocks FROM b GROUP BY source""")
def context_pack(t):
    hits = t("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("final_rank"), F.col("text").alias("content"), F.lit(1.0).alias("score"), F.create_map(F.lit("title"), "source").alias("metadata"))
    return retrieval.pack_context(hits).select(F.col("query_id").alias("source"), "context", "n_blocks")


def _sides(t) -> tuple[DataFrame, DataFrame]:
    """Vector hits: the nearest vectors of every hundredth; graph hits: the first five vectors of
    their label, at 0.5.  The content is the document of the same number."""
    docs = t("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    near = _knn(t, F.col("vec_id") % 100 == 0).join(docs, "vec_id").select("query_id", "rank", "vec_id", "content", "score")
    e = t("embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    top = e.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).where("rank < 5")
    mates = top.join(asked, "label").join(docs, "vec_id")
    return near, mates.select("query_id", "rank", "vec_id", "content", F.lit(0.5).alias("score"))


_SIDES = f"""near AS (SELECT query_id, rank, vec_id, text, score, 0 AS o FROM ({_knn_sql("q.vec_id % 100 = 0")}) n JOIN documents d ON d.doc_id = n.vec_id),
mates AS (SELECT q.vec_id AS query_id, CAST(m.r - 1 AS INTEGER) AS rank, m.vec_id, text, 0.5::DOUBLE AS score, 1 AS o FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q
  JOIN (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) m ON m.label = q.label AND m.r <= 5 JOIN documents d ON d.doc_id = m.vec_id)"""


@query(f"""WITH {_SIDES}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_STRIP.format('lower(substr(text, 1, 200))')} ORDER BY o, rank) AS k FROM (SELECT * FROM near UNION ALL SELECT * FROM mates))
SELECT query_id, vec_id, score, CASE o WHEN 0 THEN 'vector' ELSE 'graph' END AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, rank) - 1 AS INTEGER) AS final_rank FROM u WHERE k = 1""")
def hybrid_retrieve(t):
    return retrieval.retrieve(*_sides(t)).select("query_id", "vec_id", "score", "source", "final_rank")


_SIDE_CONTEXTS = _SIDES + f""",
v AS (SELECT query_id, string_agg(text, {_SEPARATOR} ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n FROM near GROUP BY query_id),
g AS (SELECT query_id, string_agg(text, {_SEPARATOR} ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n FROM mates GROUP BY query_id)"""


def _contexts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    near, mates = _sides(t)
    joined = lambda hits: retrieval.joined_context(hits.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "content", "score"))
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")), joined(near), joined(mates)


@query(f"WITH {_SIDE_CONTEXTS} SELECT query_id, context, n AS num_chunks FROM v")
def vector_context(t):
    queries, v, _ = _contexts(t)
    return retrieval.for_all(queries, v).where("num_chunks > 0").select("query_id", "context", "num_chunks")


@query(f"""WITH {_SIDE_CONTEXTS} SELECT q.vec_id AS query_id, concat_ws({_SEPARATOR}, {_quoted(retrieval.VECTOR_LABEL)} || v.context, {_quoted(retrieval.GRAPH_LABEL)} || g.context) AS context,
coalesce(v.n, 0) + coalesce(g.n, 0) AS num_chunks FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN v ON v.query_id = q.vec_id LEFT JOIN g ON g.query_id = q.vec_id""")
def integration(t):
    return retrieval.integrate(*_contexts(t))


@query(f"""WITH {_SIDE_CONTEXTS} SELECT q.vec_id AS query_id, CASE WHEN q.vec_id % 200 = 0 THEN coalesce(g.context, '') ELSE coalesce(v.context, '') END AS context,
coalesce(CASE WHEN q.vec_id % 200 = 0 THEN g.n ELSE v.n END, 0) AS num_chunks, CASE WHEN q.vec_id % 200 = 0 THEN 'reasoning-based' ELSE 'fact-based' END AS query_classification, CASE WHEN q.vec_id % 200 = 0 THEN 'graph' ELSE 'vector' END AS selected_retriever
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN v ON v.query_id = q.vec_id LEFT JOIN g ON g.query_id = q.vec_id""")
def selection(t):
    queries, v, g = _contexts(t)
    reply = F.when(F.col("query_id") % 200 == 0, F.lit("Reasoning.")).otherwise(F.lit("fact"))
    return retrieval.select_side(queries.withColumn("query_classification", retrieval.query_class(reply)), v, g)


# --- graphs ---------------------------------------------------------------------------------------


def _geography(t) -> DataFrame:
    """Relations: customer in nation, nation in region."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    living = c.select(F.array(F.col("c_custkey")).alias("ord"), F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("LIVES_IN").alias("relation"), F.col("c_mktsegment").alias("description"), F.concat(F.lit("c"), "c_custkey").alias("source_chunk_id"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return living.union(n.select(F.array(F.lit(1 << 40) + F.col("n_nationkey")), "n_name", "r_name", F.lit("PART_OF"), F.lit(""), F.concat(F.lit("n"), "n_nationkey")))


_GEOGRAPHY = """rel AS (SELECT c_custkey AS ord, c_name AS source, n_name AS target, 'LIVES_IN' AS relation, c_mktsegment AS description FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 1099511627776 + n_nationkey, n_name, r_name, 'PART_OF', '' FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (SELECT least(lower(source), lower(target)) AS src_key, greatest(lower(source), lower(target)) AS dst_key, count(*) AS n, string_agg(source || '->' || target || '->' || relation || '->' || description, chr(10) ORDER BY ord) AS told FROM rel GROUP BY 1, 2)"""


@query(f"WITH {_GEOGRAPHY} SELECT src_key, dst_key, CAST(n AS INTEGER) AS n_relations, told FROM edges")
def edge_merge(t):
    line = lambda r: F.concat_ws("->", r["source"], r["target"], r["relation"], r["description"])
    return graph.merge_relations(_geography(t)).select("src_key", "dst_key", F.size("relations").alias("n_relations"), summaries.edges_text(F.transform("relations", line)).alias("told"))


def _orders_graph(t) -> DataFrame:
    """Relations: supplier supplies part, one for each line item."""
    s = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return s.select(F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("ord"), F.col("s_name").alias("source"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("target"), F.lit("SUPPLIES").alias("relation"), F.col("l_shipdate").cast("string").alias("description"), F.col("l_orderkey").cast("string").alias("source_chunk_id"))


@query("""SELECT least(lower(s_name), 'part ' || p_partkey) AS src_key, greatest(lower(s_name), 'part ' || p_partkey) AS dst_key, CAST(count(*) AS INTEGER) AS n_relations, min(l_orderkey) AS first_order
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def supply_edges(t):
    return graph.edge_counts(_orders_graph(t)).select("src_key", "dst_key", F.col("n_relations").cast("int").alias("n_relations"), F.col("first")[0].alias("first_order"))


def _people(t) -> DataFrame:
    c = t("customer")
    return c.select(F.array("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.lit("Customer").alias("entity_type"), F.col("c_mktsegment").alias("description"), F.concat(F.lit("c"), "c_custkey").alias("source_chunk_id"))


@query(f"""WITH {_GEOGRAPHY}, ends AS (SELECT src_key AS key FROM edges UNION SELECT dst_key FROM edges), people AS (SELECT DISTINCT lower(c_name) AS key FROM customer)
SELECT key, key AS name, 'Unknown' AS entity_type FROM ends WHERE key NOT IN (SELECT key FROM people)""")
def implicit_nodes(t):
    nodes = graph.with_implicit_nodes(graph.merge_entities(_people(t)), graph.merge_relations(_geography(t)))
    return nodes.where("NOT is_entity").select("key", "name", "entity_type")


@query(f"""WITH {_GEOGRAPHY}, ends AS (SELECT src_key AS key FROM edges UNION SELECT dst_key FROM edges UNION SELECT lower(c_name) FROM customer)
SELECT (SELECT count(DISTINCT lower(c_name)) FROM customer) AS entities, (SELECT count(*) FROM ends) AS nodes, (SELECT count(*) FROM edges) AS edges""")
def graph_stats(t):
    edges = graph.merge_relations(_geography(t))
    return graph.graph_stats(graph.with_implicit_nodes(graph.merge_entities(_people(t)), edges), edges)


@query(f"""WITH {_GEOGRAPHY} SELECT DISTINCT node, neighbour FROM (SELECT src_key AS node, dst_key AS neighbour FROM edges UNION ALL SELECT dst_key, src_key FROM edges) WHERE node IN (SELECT lower(n_name) FROM nation)""")
def neighbors(t):
    wanted = t("nation").select(F.lower("n_name").alias("node"))
    return graph.neighbours(graph.merge_relations(_geography(t)), wanted)


@query(f"WITH {_GEOGRAPHY} SELECT source AS subject, relation, target AS object FROM rel ORDER BY ord, source, target, relation LIMIT 100")
def triplet_sample(t):
    return graph.triplets(_geography(t), 100)


@query(f"""WITH {_GEOGRAPHY}, f AS (SELECT * FROM rel ORDER BY ord, source, target, relation LIMIT 100), ends AS (SELECT source AS id, ord, 0 AS pos FROM f UNION ALL SELECT target, ord, 1 FROM f),
n AS (SELECT id, min(ord * 2 + pos) AS seen FROM ends GROUP BY id) SELECT id, CAST(row_number() OVER (ORDER BY seen) - 1 AS INTEGER) AS ord FROM n""")
def graph_nodes(t):
    return graph.graph_data(_geography(t), 100)[0]


_NAMES = r"(SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS name FROM documents)"


@query(rf"""SELECT lower(name) AS key, min_by(name, (doc_id, pos)) AS name, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM
(SELECT doc_id, names[i] AS name, i AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\p{{Lu}}\p{{L}}+') AS names FROM documents), LATERAL (SELECT unnest(range(1, len(names) + 1)) AS i)) GROUP BY 1""")
def entity_mentions(t):
    return graph.mentions(t("documents"), "doc_id", "text")


@query("""WITH e AS (SELECT lower(source) AS key, min(source) AS name, list(DISTINCT lang) AS langs, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1),
firsts AS (SELECT lower(source) AS key, lang, min(doc_id) AS d FROM documents GROUP BY ALL)
SELECT e.key, e.name, (SELECT string_agg(lang, ' ' ORDER BY d) FROM firsts f WHERE f.key = e.key) AS description, CAST(n AS INTEGER) AS n_chunks FROM e""")
def entity_merge(t):
    rows = t("documents").select(F.array("doc_id").alias("ord"), F.concat(F.lit(" "), "source", F.lit("\n")).alias("name"), F.lit("Source").alias("entity_type"), F.col("lang").alias("description"), F.col("doc_id").cast("string").alias("source_chunk_id"))
    return graph.merge_entities(rows).select("key", "name", "description", F.size("source_chunk_ids").alias("n_chunks"))


@query(r"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(text, '\p{L}{2,}'), lambda x: regexp_matches(x, '^\p{Lu}')) AS names FROM documents),
c AS (SELECT *, CAST(least(greatest(len(names) - 1, 0), 10) AS INTEGER) AS r FROM n)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN len(names) = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(len(list_distinct(names[1:r + 1])) AS INTEGER) AS n_entities, r AS n_relations FROM c""")
def entity_extract(t):
    rows = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    found = graph.extract(rows, OfflineChat())
    return found.select("chunk_id", "status", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


def _places(t) -> DataFrame:
    """node_key, nation, region: of customers and nations; regions have no nation."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda df, key, nation: df.select(F.lower(key).alias("node_key"), nation.alias("nation"), F.lower("r_name").alias("region"))
    return one(c, "c_name", F.col("n_nationkey")).union(one(n, "n_name", F.col("n_nationkey"))).union(one(t("region"), "r_name", F.lit(None).cast("int")))


_PLACES = """places AS (SELECT lower(c_name) AS node_key, n_nationkey AS nation, lower(r_name) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT lower(n_name), n_nationkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name), NULL, lower(r_name) FROM region)"""


@query(f"WITH {_PLACES} SELECT node_key AS node, min(node_key) OVER (PARTITION BY region) AS component FROM places WHERE region IN (SELECT region FROM places WHERE nation IS NOT NULL)")
def components(t):
    return communities.components(graph.merge_relations(_geography(t)))


@query()
def detected_communities(t):
    return communities.detect(graph.merge_relations(_geography(t)))


def _by_nation(t) -> DataFrame:
    return _places(t).where("nation IS NOT NULL").select(F.col("nation").alias("community_id"), "node_key")


@query(f"""WITH {_GEOGRAPHY}, {_PLACES} SELECT a.nation AS community_id, src_key, dst_key FROM edges JOIN places a ON a.node_key = src_key JOIN places b ON b.node_key = dst_key WHERE a.nation = b.nation AND src_key < dst_key""")
def community_edges(t):
    return communities.community_edges(_by_nation(t), graph.merge_relations(_geography(t))).select("community_id", "src_key", "dst_key")


@query(f"""WITH {_GEOGRAPHY}, {_PLACES}, shown AS (SELECT places.*, coalesce(c_name, node_key) AS name FROM places LEFT JOIN customer ON lower(c_name) = node_key),
m AS (SELECT nation AS community_id, string_agg(name, ', ' ORDER BY node_key) AS names FROM shown WHERE nation IS NOT NULL GROUP BY nation),
l AS (SELECT a.nation AS community_id, string_agg(a.name || '->' || b.name || '->LIVES_IN->' || split_part(told, '->', 4), chr(10) ORDER BY src_key, dst_key) AS lines
  FROM edges JOIN shown a ON a.node_key = src_key JOIN shown b ON b.node_key = dst_key WHERE a.nation = b.nation AND src_key < dst_key GROUP BY a.nation)
SELECT community_id, names, lines FROM m JOIN l USING (community_id)""")
def community_format(t):
    """Customers are entities and shown by their names; nations are known from edges only."""
    edges = graph.merge_relations(_geography(t))
    nodes = graph.with_implicit_nodes(graph.merge_entities(_people(t)), edges)
    told = communities.community_tables(_by_nation(t), edges, nodes)
    return told.select("community_id", F.array_join("entity_names", ", ").alias("names"), summaries.edges_text(F.col("relation_lines")).alias("lines"))


def _labels(t) -> DataFrame:
    return t("embeddings").select(F.col("label").alias("community_id"), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("node_key"))


@query(f"""SELECT label AS community_id, {_quoted(summaries.FALLBACK[0])} || string_agg('v' || lpad(CAST(vec_id AS VARCHAR), 9, '0'), ', ' ORDER BY vec_id) || {_quoted(summaries.FALLBACK[1])} AS summary FROM embeddings GROUP BY label""")
def summaries_fallback(t):
    tables = _labels(t).groupBy("community_id").agg(F.array_sort(F.collect_list("node_key")).alias("entity_names")).withColumn("relation_lines", F.expr("cast(array() as array<string>)"))
    return summaries.summarise(tables, OfflineChat()).select("community_id", "summary")


def _summaries(t) -> DataFrame:
    return t("embeddings").groupBy(F.col("label").alias("community_id")).agg(F.count("*").alias("n")).select("community_id", F.when(F.col("community_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("community "), F.col("community_id").cast("string"), F.lit(" of "), F.col("n").cast("string"))).alias("summary"))


_SUMMARIES = "c AS (SELECT label AS community_id, CASE WHEN label % 4 = 3 THEN '' ELSE 'community ' || label || ' of ' || count(*) END AS summary FROM embeddings GROUP BY label)"


@query(f"""WITH {_SUMMARIES}, h AS ({_knn_sql("q.vec_id % 100 = 0")}), m AS (SELECT DISTINCT query_id, label AS community_id FROM h JOIN embeddings e ON e.vec_id = h.vec_id)
SELECT query_id, coalesce(string_agg(summary, {_SEPARATOR} ORDER BY m.community_id) FILTER (summary <> ''), '') AS context, CAST(count(*) FILTER (summary <> '') AS INTEGER) AS num_chunks
FROM m JOIN c USING (community_id) GROUP BY query_id""")
def local_search(t):
    e = t("embeddings")
    entities = e.select(F.col("vec_id").alias("node_key"), "embedding")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return retrieval.local_search(queries, entities, e.select(F.col("vec_id").alias("node_key"), F.col("label").alias("community_id")), _summaries(t)).select("query_id", "context", "num_chunks")


@query(f"WITH {_SUMMARIES} SELECT coalesce(string_agg(summary, {_SEPARATOR} ORDER BY community_id), '') AS context, CAST(count(*) AS INTEGER) AS num_chunks FROM c WHERE summary <> ''")
def global_search(t):
    return retrieval.global_search(_summaries(t))


@query("""SELECT 'ids' AS kind, md5(count(*) || ':' || (SELECT string_agg(doc_id, '' ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100))) AS fingerprint FROM documents
UNION ALL SELECT 'marked ids', md5(count(*) || ':' || (SELECT string_agg(doc_id || '|', '' ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100))) FROM documents
UNION ALL SELECT 'content', md5(count(*) || ':' || coalesce(sum(('0x' || substr(md5(doc_id || chr(0) || text), 1, 15))::HUGEINT), 0) || ':' || '{"chunk": 256}') FROM documents""")
def fingerprints(t):
    d = t("documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "fingerprint")
    return one("ids", index_store.first_ids_fingerprint(d)).union(one("marked ids", index_store.first_ids_fingerprint(d, "|"))).union(one("content", index_store.content_fingerprint(d, {"chunk": 256})))


@dataclass(frozen=True)
class _Echo:
    """Replies with the text that it is asked about."""

    def reply(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str:
        return prompt.partition("Text:\n")[2]


@query("""WITH n AS (SELECT event_id, event_id % 7 AS k, json_valid(props) AND json_type(props) = 'OBJECT' AS ok FROM events)
SELECT CAST(event_id AS VARCHAR) AS chunk_id, CASE WHEN k = 0 OR k IN (2, 3, 5) AND NOT ok OR k = 4 THEN 'failed' WHEN k IN (1, 5) THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN k = 2 AND ok THEN 'E' || event_id || ':Unknown:' WHEN k = 3 AND ok THEN 'A' || event_id || ':T:d|B:Unknown:' WHEN k = 6 THEN 'C:Unknown:' ELSE '' END AS entities,
  CASE WHEN k = 3 AND ok THEN 'A' || event_id || '->B->KNOWS->|A' || event_id || '->B->RELATED_TO->x' ELSE '' END AS relations FROM n""")
def llm_json_parse(t):
    """Replies of all kinds, each read by parse_reply: no JSON, empty lists, objects with other
    members, elements of wrong kinds and without names, two objects, and text around the object."""
    e = t("events").withColumns({"k": F.col("event_id") % 7, "id": F.col("event_id").cast("string")})
    told = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    entity, props = told('{"entity_name": " E', F.col("id"), ' "}'), F.col("props")
    pair = told('{"source_entity": "A', F.col("id"), '", "target_entity": "B"')
    replies = [
        F.lit("I can't."), F.lit('{"entities": [], "relationships": null}'), told('Sure:\n{"entities": [', entity, ', "x", {"entity_name": "  "}, 5], "more": ', props, "}\nDone."),
        told('{"entities": [{"entity_name": "A', F.col("id"), '", "entity_type": "T", "entity_description": " d "}, {"entity_name": "B", "entity_type": null}], "relationships": [', pair, ', "relation": "KNOWS"}, {"source_entity": "", "target_entity": "B"}, ', pair, ', "relationship_description": "x"}], "more": ', props, "}"),
        F.lit('{"entities": []} {"relationships": []}'), told('{"entities": {"entity_name": "no list"}, "more": ', props, "}"), F.lit('```json\n{"entities": [{"entity_name": "C"}]}\n```'),
    ]
    rows = e.select(F.col("id").alias("chunk_id"), F.col("event_id").alias("ord"), F.coalesce(*(F.when(F.col("k") == k, r) for k, r in enumerate(replies))).alias("content"))
    found = graph.extract(rows, _Echo())
    line = lambda col, sep, *names: F.array_join(F.transform(col, lambda x: F.concat_ws(sep, *(x[n] for n in names))), "|")
    return found.select("chunk_id", "status", line("entities", ":", "name", "entity_type", "description").alias("entities"), line("relations", "->", "source", "target", "relation", "description").alias("relations"))


# --- the rest: samples, stores, reports, look-ups -------------------------------------------------


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 100")
def sample_cap(t):
    rows = t("conversations").withColumn("idx", F.struct("conv_id", "turn"))
    return sources.capped(rows, 100).select("conv_id", "turn", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN lang = 'en' THEN source ELSE text END AS content FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages")
def index_upsert(t):
    """All documents are stored; then the English ones come again with other content, and pages."""
    d = t("documents")
    store = index_store.IndexStore(d.sparkSession, shared.fresh_path(d.sparkSession, "index"))
    store.upsert("chunks", d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    new = d.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("content"))
    store.upsert("chunks", new.union(t("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "url")), "chunk_id")
    return store.read("chunks").select("chunk_id", "content")


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, lang AS query_type, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS is_correct, source AS query, lang AS ground_truth, source AS prediction FROM labels JOIN documents USING (doc_id)")
def predictions_csv(t):
    """Predictions written as CSV and read again."""
    rows = t("labels").join(t("documents"), "doc_id").select(F.col("doc_id").cast("string").alias("query_id"), F.col("lang").alias("query_type"), (F.col("quality") == 1).alias("is_correct"), F.col("source").alias("query"), F.col("lang").alias("ground_truth"), F.col("source").alias("prediction"))
    path = shared.fresh_path(rows.sparkSession, "report")
    reports.save_predictions_csv(rows, path)
    return rows.sparkSession.read.csv(path, header=True, quote='"', escape='"')


@query(f"WITH h AS ({_knn_sql('q.vec_id % 100 = 0')}) SELECT query_id, rank, h.vec_id AS vec_id, score, text AS content FROM h LEFT JOIN documents ON doc_id = h.vec_id")
def hits_with_content(t):
    hits = _knn(t, F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "chunk_id")
    return knn.with_content(hits, t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))).withColumnRenamed("chunk_id", "vec_id").select("query_id", "rank", "vec_id", "score", "content")


def _chain(t) -> DataFrame:
    """Relations of each vector's number with the next; the document of that number tells of it."""
    d = t("documents")
    name = lambda k: k.cast("string")
    return d.select(F.array("doc_id").alias("ord"), name(F.col("doc_id")).alias("source"), name(F.col("doc_id") + 1).alias("target"), F.lit("NEXT").alias("relation"), F.lit("").alias("description"), name(F.col("doc_id")).alias("source_chunk_id"))


@query(f"""WITH h AS ({_knn_sql('q.vec_id % 100 = 0')}), c AS (SELECT query_id, d.doc_id, max(score) AS score FROM h JOIN documents d ON h.vec_id = d.doc_id OR h.vec_id = d.doc_id + 1 GROUP BY ALL)
SELECT query_id, CAST(rank - 1 AS INTEGER) AS rank, chunk_id, score FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM c) WHERE rank <= 10""")
def graph_chunk_hits(t):
    e = t("embeddings")
    # Ties of the nearest follow numbers; keys are texts, padded so that their order is the same.
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    rel = _chain(t).withColumns({"source": pad(F.col("source")), "target": pad(F.col("target"))})
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return retrieval.graph_hits(queries, e.select(pad(F.col("vec_id")).alias("node_key"), "embedding"), graph.merge_relations(rel), chunks, 10).select("query_id", "rank", "chunk_id", "score")


@query("SELECT lower(c_name) AS key, CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE c_name END AS shown FROM customer")
def entity_text(t):
    return indexing.entity_text(graph.merge_entities(_people(t))).select(F.col("node_key").alias("key"), "shown")


@query(f"WITH {_PLACES} SELECT node_key, [nation] AS community_ids FROM places WHERE nation IS NOT NULL".replace("[nation]", "CAST(nation AS VARCHAR)"))
def entity_communities(t):
    return indexing.entity_to_communities(_by_nation(t)).select("node_key", F.array_join(F.transform("community_ids", lambda c: c.cast("string")), ",").alias("community_ids"))


@query(r"SELECT count(*) AS chunks, count(*) FILTER (NOT regexp_matches(text, '(^|[^\p{L}])\p{Lu}\p{L}+')) AS empty, 0::BIGINT AS failed FROM documents")
def extraction_counts(t):
    rows = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return graph.extraction_counts(graph.extract(rows, OfflineChat()))


_EXTRACT_HEAD = prompts.EXTRACT_TEMPLATE.replace("{limit}", "10").partition("{text}")[0]


@query(f"SELECT item_id, {_quoted(_EXTRACT_HEAD)} || text AS prompt FROM benchmark")
def extraction_prompts(t):
    return t("benchmark").select("item_id", prompts.extraction_prompt(F.col("text")).alias("prompt"))


_SHOTS = "\n\n".join(f"Example:\nContext:\n{c}\n\nQuestion: {q}\n\nAnswer: {a}\n\n---" for c, q, a in prompts.EXAMPLES)


@query(f"SELECT item_id, {_quoted(_SHOTS + chr(10) + chr(10) + 'Now answer the question:' + chr(10) + 'Context:' + chr(10))} || text || {_quoted(chr(10) + chr(10) + 'Question: ')} || item_id || {_quoted(chr(10) + chr(10) + 'Answer:')} AS prompt FROM benchmark")
def few_shot_prompts(t):
    return t("benchmark").select("item_id", prompts.few_shot_prompt(F.col("text"), F.col("item_id").cast("string")).alias("prompt"))


@query(f"SELECT q.vec_id AS vec_id, {_COSINE} AS cosine FROM {_VECTORS} q JOIN {_VECTORS} c ON c.vec_id = q.vec_id + 1")
def cosine_pairs(t):
    e = t("embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", (F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6) + 0.0).alias("cosine"))


@query(f"WITH {_GEOGRAPHY} SELECT src_key, dst_key, CAST(n AS INTEGER) AS n_relations FROM edges WHERE src_key = (SELECT min(src_key) FROM edges) AND dst_key = (SELECT min(dst_key) FROM edges WHERE src_key = (SELECT min(src_key) FROM edges))")
def edge_lookup(t):
    edges = graph.merge_relations(_geography(t))
    first = edges.agg(F.min(F.struct("src_key", "dst_key")).alias("f")).first().f
    return graph.edge_between(edges, first.dst_key, first.src_key).select("src_key", "dst_key", F.size("relations").alias("n_relations"))
