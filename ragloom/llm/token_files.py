"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A set of token files is a folder of shards.  Shard k has
  k.ids   the ids of its documents, one after the other (u2 if the vocabulary fits, else u4)
  k.off   n + 1 little-endian u8 offsets into the shard, in ids
  k.doc   n little-endian i8 document ids; k.nul the positions (u8) whose document id is null
and `manifest.json` lists documents, tokens and the base (ids in all shards before it, a prefix
sum) of each.  Shards follow one another in ascending document id, null first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

SHARD_SCHEMA = "shard int, documents long, tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


@dataclass(frozen=True)
class TokenFiles:
    """folder: URI; dtype: of the ids; shards: (number, documents, tokens, base)."""

    folder: str
    dtype: str
    shards: tuple[tuple[int, int, int, int], ...]

    @property
    def tokens(self) -> int:
        return sum(s[2] for s in self.shards)

    @classmethod
    def open(cls, folder: str) -> TokenFiles:
        with common.reading(f"{folder}/manifest.json") as f:
            x = json.loads(bytes(f.read()))
        return cls(folder, x["dtype"], tuple(tuple(s) for s in x["shards"]))

    def shard(self, k: int):
        """(ids, offsets, document ids, positions of null ids) as mapped arrays."""
        at = f"{self.folder}/{k:06d}"
        return common.mapped(f"{at}.ids", self.dtype), common.mapped(f"{at}.off", "<u8"), common.mapped(f"{at}.doc", "<i8"), common.mapped(f"{at}.nul", "<u8")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text (null: empty), append end_id, write shards in ascending id order.

    The one shuffle is a range partitioning by id, then by the text's hash, then by the row's
    number, so that neither a null nor a repeated id nor a repeated row is one task's; each task
    streams its rows to its shard, a few at a time.  Rows with equal ids stand together, in order of
    their texts' xxhash64; equal rows have equal ids in the files, so their order is no matter.  An
    empty table gives a manifest with empty shards.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or common.fresh_path(spark, "tokens")
    common.make_dirs(folder)
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"of_text": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(common.tasks(docs), "doc_id", "of_text", "number").sortWithinPartitions("doc_id", "of_text", "number").select("doc_id", "text")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        k, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode_all
        at, end = f"{folder}/{k:06d}", np.asarray([end_id], "<u4").tobytes()
        lengths, ids = [np.zeros(1, "<u8")], []
        with common.writing(f"{at}.ids") as out:
            for batch in batches:
                ids.append(batch.column(0))
                for lo in range(0, batch.num_rows, 500):
                    codes = [c + end for c in encode(batch.column(1).slice(lo, 500).to_pylist())]
                    lengths.append(np.fromiter((len(c) // 4 for c in codes), "<u8", len(codes)))
                    out.write(np.frombuffer(b"".join(codes), "<u4").astype(dtype).tobytes())
        offsets = np.cumsum(np.concatenate(lengths), dtype="<u8")
        column = pa.chunked_array(ids, pa.int64())
        for suffix, data in (("off", offsets), ("doc", column.fill_null(0).to_numpy().astype("<i8")), ("nul", np.flatnonzero(column.is_null().to_numpy()).astype("<u8"))):
            with common.writing(f"{at}.{suffix}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "documents": pa.array([len(column)], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})

    # One row a shard: as many as there are tasks, whatever the rows.
    done = sorted({tuple(r) for r in dealt.mapInArrow(common.tidy(write), SHARD_SCHEMA).collect()})
    shards, base = [], 0
    for k, documents, tokens in done:
        shards.append((k, documents, tokens, base))
        base += tokens
    with common.writing(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "shards": shards}).encode())
    return TokenFiles(folder, dtype, tuple(shards))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (as stored), from the files."""
    return _scan(spark, files, READ_SCHEMA, lambda np, raw: (raw,))


def token_file_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    import zlib

    return _scan(spark, files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda np, raw: (zlib.crc32(np.ascontiguousarray(raw, "<u4").tobytes()),))


def _scan(spark: SparkSession, files: TokenFiles, schema: str, of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    bases = {k: base for k, _, _, base in files.shards}

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, off, doc, nul = files.shard(k)
                for lo in range(0, len(doc), 2000):
                    hi = min(lo + 2000, len(doc))
                    o = off[lo : hi + 1].astype(np.int64)
                    values = [of(np, ids[a:b])[0] for a, b in zip(o[:-1], o[1:], strict=True)]
                    null = np.isin(np.arange(lo, hi), nul)
                    last = pa.array([v.tobytes() for v in values], pa.binary()) if names[-1] == "ids" else pa.array(values, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi].astype(np.int64), mask=null), pa.array(o[:-1] + bases[k]), pa.array(np.diff(o)), last], names)

    return common.one_task_each(spark, bases).mapInArrow(common.tidy(scan), schema)
