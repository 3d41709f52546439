"""An extension, not part of the reference's scope: documents that arrive are chunked, embedded and
upserted, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..config import Settings
from ..plans import indexing
from ..providers import Embedder
from ..sources.index_store import IndexStore


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents (doc_id, content, title, metadata) as they appear in a folder."""
    return spark.readStream.schema(schemas.DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(documents: DataFrame, store: IndexStore, embedder: Embedder, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """An upsert by chunk_id a batch: a batch that is run again changes nothing.  Of one document's
    versions in a batch any may be last; order them by batches if that matters."""

    def upsert(batch: DataFrame, _: int) -> None:
        chunks = indexing.chunked(batch.dropDuplicates(["doc_id"]), settings)
        indexing.index_vectors(store, chunks, embedder)

    writer = documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
