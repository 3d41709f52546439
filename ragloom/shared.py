"""Intermediate tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without the setting a temporary one is made, for a local master only: on a cluster executors
    would not find each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{folder(spark)}/ragloom/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: cuts its lineage."""
    path = fresh_path(df.sparkSession, "core")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what `written` wrote, once nothing will be computed from it any more."""
    remove(df.sparkSession, df.written_at)


def apart(df: DataFrame) -> DataFrame:
    """df for a join where both sides are dealt out by key.  Without this Spark collects a side that is
    small on disk in the driver, and does so again in each round of a loop."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Removes every folder of this session; to be called when results are written elsewhere."""
    for path in list(_made):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _made:
        _made.remove(path)


# --- files of workers, on any machine and in any store -------------------------------------------


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def saving(uri: str) -> Iterator:
    """A binary file that has its name only when it is whole, so tasks may run again."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    if path := _local(part):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            yield out
        os.replace(path, _local(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(part)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        yield out
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def load(uri: str) -> bytes:
    """A whole file."""
    if path := _local(uri):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def copy(uri: str, out) -> None:
    """A file's bytes to an open one, some at a time."""
    import shutil

    if path := _local(uri):
        with open(path, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 23)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        shutil.copyfileobj(f, out, 1 << 23)
