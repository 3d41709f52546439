"""Indexes as folders of Parquet tables, with a small JSON file beside them.

A table is written under a new name and the JSON file then points to it, so a reader never sees half
of one, and an update may read what it replaces."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "index.json"


class Folder:
    """Small files and deletion in any store that Spark reads, by its own file system classes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read_json(self, name: str) -> dict | None:
        if not self.has(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def write_json(self, name: str, data: dict) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=1).encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class IndexStore:
    """Named tables of one index, its settings' fingerprint and its counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @property
    def manifest(self) -> dict:
        return self.folder.read_json(MANIFEST) or {"tables": {}}

    def has(self, *names: str) -> bool:
        tables = self.manifest["tables"]
        return all(n in tables for n in names)

    def read(self, name: str) -> DataFrame:
        tables = self.manifest["tables"]
        if name not in tables:
            raise FileNotFoundError(f"no table {name} in {self.folder.path}; build the index first")
        return self.spark.read.parquet(f"{self.folder.path}/{tables[name]}")

    def write(self, fingerprint: str | None = None, **tables: DataFrame) -> None:
        """Replaces these tables; the others stay.  The fingerprint, if any, is theirs."""
        written = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.folder.path}/{written[name]}")
        manifest = self.manifest
        old = [p for n, p in manifest["tables"].items() if n in written]
        manifest["tables"] |= written
        marks = manifest.setdefault("fingerprints", {})
        for name in written:
            marks.pop(name, None)
            if fingerprint is not None:
                marks[name] = fingerprint
        self.folder.write_json(MANIFEST, manifest)
        for p in old:
            self.folder.delete(p)

    def upsert(self, name: str, new: DataFrame, key: str) -> None:
        """Rows of `new` replace those with their keys; the rest stays, also chunks that a document
        no longer has."""
        if not self.has(name):
            return self.write(**{name: new})
        kept = self.read(name).join(new.select(key).distinct(), key, "left_anti")
        self.write(**{name: kept.unionByName(new, allowMissingColumns=True)})

    def is_current(self, fingerprint: str, *names: str) -> bool:
        """The same content and settings, and every table has rows."""
        marks = self.manifest.get("fingerprints", {})
        return self.has(*names) and all(marks.get(n) == fingerprint and not self.read(n).isEmpty() for n in names)

    def clear(self) -> None:
        manifest = self.manifest
        self.folder.delete(MANIFEST)
        for p in manifest["tables"].values():
            self.folder.delete(p)


def first_ids_fingerprint(chunks: DataFrame, suffix: str = "", first: int = 100, order: str = "ord", id_col: str = "chunk_id") -> DataFrame:
    """One row: md5 of the number of chunks, a colon and the first ids, each with a suffix.  It tells
    neither texts nor settings apart; content_fingerprint does."""
    top = chunks.orderBy(order, id_col).limit(first)
    ids = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, id_col))), lambda x: F.concat(x[id_col], F.lit(suffix))), "").alias("ids"))
    return ids.crossJoin(chunks.agg(F.count("*").alias("n"))).select(F.md5(F.concat(F.col("n").cast("string"), F.lit(":"), "ids").cast("binary")).alias("fingerprint"))


def content_fingerprint(chunks: DataFrame, settings: dict, columns: tuple[str, ...] = ("chunk_id", "content")) -> DataFrame:
    """One row: changes with any id, text or setting, not with the order of rows.  The first 15 digits
    of each row's md5 are added up."""
    row: Column = F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))
    total = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return total.select(F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.lit(json.dumps(settings, sort_keys=True))).cast("binary")).alias("fingerprint"))
