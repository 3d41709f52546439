"""Documents and question samples from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import url_id
from . import json_lists

_EMPTY_MAP = "cast(map() as map<string,string>)"
_TEXTS = "{.txt,.md}"


def _field(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


#: Bytes of a JSON file that is parsed as one value; larger lists are cut into their items first.
LARGE = 8_000_000


def _name(file: Column) -> Column:
    return F.url_decode(F.element_at(F.split(file, "/"), -1))


def _stem(file: Column) -> Column:
    return F.regexp_replace(_name(file), r"\.[^.]*$", "")


def _files(spark: SparkSession, suffix: str) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")


def _json_items(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """stem, idx, n, v: one row an item, of a list or a single object; files that are no JSON give
    none."""
    small = _files(spark, suffix).text(path, wholetext=True).where(F.col("_metadata.file_size") <= LARGE)
    parsed = small.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
    one = F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.array("doc"))
    listed = parsed.select("file", F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), one).alias("items"))
    found = listed.select("file", F.size("items").alias("n"), F.posexplode("items").alias("idx", "v"))
    pieces = _files(spark, suffix).text(path, lineSep=json_lists.SEPARATOR).where(F.col("_metadata.file_size") > LARGE)
    large = json_lists.items(pieces.select("value", F.input_file_name().alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block")))
    if large is not None:
        found = found.unionByName(large.select("file", "n", "idx", F.explode("v").alias("v")))
    return found.where(F.schema_of_variant("v").startswith("OBJECT")).select(_stem(F.col("file")).alias("stem"), "n", "idx", "v")


def _metadata() -> Column:
    return F.coalesce(F.try_variant_get("v", "$.metadata", "map<string,string>"), F.expr(_EMPTY_MAP))


def documents_from_dir(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, content, title, metadata of all .json, .txt and .md files below a folder.

    Suffixes are lower-case; others are passed over.  An item's id is its own, or the file's stem,
    with the place in the list where that has more than one item; its content is `content`, else
    `text`, else empty.  A text file is one document, titled by its name."""
    items = _json_items(spark, path, ".json")
    own = F.when(F.col("n") > 1, F.concat("stem", F.lit("#"), "idx")).otherwise(F.col("stem"))
    found = items.select(F.coalesce(_field("id"), own).alias("doc_id"), F.coalesce(_field("content"), _field("text"), F.lit("")).alias("content"), F.coalesce(_field("title"), F.lit("")).alias("title"), _metadata().alias("metadata"))
    texts = _files(spark, _TEXTS).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    if empty := _empty_texts(spark, path):
        texts = texts.unionByName(spark.createDataFrame([("", f) for f in empty], "value string, file string"))
    name = _name(F.col("file"))
    return found.unionByName(texts.select(_stem(F.col("file")).alias("doc_id"), F.col("value").alias("content"), name.alias("title"), F.expr(_EMPTY_MAP).alias("metadata")))


def _empty_texts(spark: SparkSession, path: str) -> list[str]:
    """Text files of no bytes, which Spark's readers list but pass over.  Asking the file system for
    each file's length takes a process a file where that is local."""
    files = _files(spark, _TEXTS).format("binaryFile").load(path)
    listed = files.inputFiles()
    return sorted({*listed} - {r.file for r in files.select(F.input_file_name().alias("file")).collect()}) if listed else []


def capped(samples: DataFrame, most: int | None, order: str = "idx") -> DataFrame:
    """The first `most` samples; all if that is 0 or None."""
    return samples.orderBy(order).limit(most) if most else samples


def samples_from_json(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Question samples of one JSON list: id (else the place), query, answer, question_type (else
    unknown), evidence_list (else empty)."""
    items = _json_items(spark, path, "")
    evidence = F.coalesce(F.try_variant_get("v", "$.evidence_list", "array<string>"), F.expr("cast(array() as array<string>)"))
    rows = items.select("idx", F.coalesce(_field("id"), F.col("idx").cast("string")).alias("query_id"), F.coalesce(_field("query"), F.lit("")).alias("query"), F.coalesce(_field("answer"), F.lit("")).alias("answer"), F.coalesce(_field("question_type"), F.lit("unknown")).alias("query_type"), evidence.alias("evidence_ids"), F.create_map(F.lit("source"), F.coalesce(_field("source"), F.lit(""))).alias("metadata"))
    return capped(rows, most).drop("idx")


def news_corpus(items: DataFrame) -> DataFrame:
    """Documents of corpus rows (idx, url, title, body, source, published_at, category, author)."""
    kept = ("source", "published_at", "url", "category", "author")
    metadata = F.create_map(*(x for c in kept for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))))
    return items.select(url_id(F.col("url"), F.col("idx")).alias("doc_id"), F.coalesce("body", F.lit("")).alias("content"), F.coalesce("title", F.lit("")).alias("title"), metadata.alias("metadata"))


def news_corpus_from_json(spark: SparkSession, path: str) -> DataFrame:
    items = _json_items(spark, path, "")
    return news_corpus(items.select("idx", *(_field(c).alias(c) for c in ("url", "title", "body", "source", "published_at", "category", "author"))))


def corpus_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The plain variant: id (else empty), title, content or text; the whole item is metadata."""
    items = _json_items(spark, path, "")
    return items.select(F.coalesce(_field("id"), F.lit("")).alias("doc_id"), F.coalesce(_field("content"), _field("text"), F.lit("")).alias("content"), F.coalesce(_field("title"), F.lit("")).alias("title"), F.coalesce(F.try_variant_get("v", "$", "map<string,string>"), F.expr(_EMPTY_MAP)).alias("metadata"))


def corpus_to_documents(corpus: DataFrame) -> DataFrame:
    """doc_id, content, title, metadata of corpus rows that may lack all but the content: ids as
    text, absent titles and ids empty, absent metadata an empty map."""
    own = lambda name, kind, absent: F.coalesce(F.col(name).cast(kind), absent) if name in corpus.columns else absent
    empty = F.lit("")
    return corpus.select(own("doc_id", "string", empty).alias("doc_id"), own("content", "string", empty).alias("content"), own("title", "string", empty).alias("title"), own("metadata", "map<string,string>", F.expr(_EMPTY_MAP)).alias("metadata"))


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.DOCUMENT)
