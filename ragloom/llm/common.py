"""Helpers that the operators of this package share: the shared folder, files in it, inputs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    """The words of a text; none for null or an empty text."""
    return [w for w in text.translate(_SPACES).split(" ") if w] if text else []


def lower_ascii(text: str) -> str:
    """Only A-Z change."""
    return text.translate(_UPPER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent one temporary folder is made and set, but only for a local master:
    on a cluster no folder of one machine will do, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Folders made by this driver and not yet removed.
_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/ragloom/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it from there: cuts the lineage, and
    survives the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialise wrote, once nothing will be computed from it any more."""
    _remove(df.sparkSession, df.materialised_at)


def release(spark: SparkSession) -> None:
    """Remove all that the operators of this package have written to the shared folder; to be called
    when the results are written elsewhere, as frames not yet computed read these folders."""
    for path in list(_made):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _made.remove(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows of df: no fewer than its scan has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of(key: object) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode())


def each_text(batches: Iterable, column: int = 0, rows: int = 500) -> Iterator[str | None]:
    """The texts of Arrow batches, few of them at a time as Python's."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield from batch.column(column).slice(lo, rows).to_pylist()


def tidy(run):
    """A function of Arrow batches that gives its memory back when a task is done: workers wait for
    their next task beside a JVM that may need the room."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Give unused memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


# --- files in the shared folder, from Python on any machine -------------------------------------


def local_path(uri: str) -> str | None:
    """The path of a file: URI or of a plain path; None for another store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dirs(uri: str) -> None:
    if path := local_path(uri):
        os.makedirs(path, exist_ok=True)
    else:
        store, path = _remote(uri)
        store.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str) -> Iterator:
    """A binary file that appears under its name only when it is complete, so that a retried or a
    speculative task replaces whole files by equal ones."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    if path := local_path(uri):
        with open(local_path(part), "wb") as out:
            yield out
        os.replace(local_path(part), path)
    else:
        store, path = _remote(part)
        with store.open_output_stream(path) as out:
            yield out
        store.move(path, _remote(uri)[1])


def reading(uri: str):
    """A seekable binary file."""
    if path := local_path(uri):
        return open(path, "rb")  # noqa: SIM115
    store, path = _remote(uri)
    return store.open_input_file(path)


def file_size(uri: str) -> int:
    if path := local_path(uri):
        return os.path.getsize(path)
    store, path = _remote(uri)
    return store.get_file_info(path).size


def mapped(uri: str, dtype: str):
    """A flat array over a file: memory-mapped where the store is a file system, else read whole."""
    import numpy as np

    if not file_size(uri):
        return np.zeros(0, dtype)
    if path := local_path(uri):
        return np.memmap(path, dtype=dtype, mode="r")
    with reading(uri) as f:
        return np.frombuffer(f.read(), dtype)


def one_task_each(spark: SparkSession, items: Iterable[int]) -> DataFrame:
    """A frame `item`, one partition for each item."""
    items = sorted(items)
    n = len(items)
    if items == list(range(n)):
        return spark.range(0, n, 1, max(n, 1)).withColumnRenamed("id", "item")
    return spark.range(0, n, 1, max(n, 1)).select(F.element_at(F.lit(items), (F.col("id") + 1).cast("int")).alias("item"))
