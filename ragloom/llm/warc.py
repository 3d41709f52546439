"""WARC archives of pages, read back, with a two-level capture index.

Archives are gzip members, one record each, in files of the shared folder.  The index sorts the
captures by reversed-host URL key into compressed blocks; a sparse directory holds each block's
first key and its place.  A look-up is a binary search in the directory and one range read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WRITTEN_SCHEMA = "surt string, page_id long, archive int, at long, length long, record_type string"
RECORD_SCHEMA = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
#: Captures are dated by a parameter: a rerun writes equal bytes.
DATE = "2020-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The sort key of a URL: host parts reversed, then path and query; scheme, port, user, a
    leading www and the fragment are dropped.  Null and URLs that can't be split sort as text.
    Tabs and line ends, which part the index's lines, are escaped."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){(url or '').lower()}".translate({9: "%09", 10: "%0a"})
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One uncompressed WARC/1.1 record: a response with its payload, or a revisit without."""
    name = "null" if page_id is None else str(page_id)
    target = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, the block's payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def members(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    rest = b""
    while True:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            rest = rest or f.read(chunk)
            if not rest:
                if out:
                    raise EOFError("a record is cut off")
                return
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def first_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id_key, digest, refers_to, shared) of the pages whose payload of at least min_bytes bytes
    occurs more than once, each pair of id and digest once; refers_to is the smallest page_id with
    it, null if all are null.

    Only ids and digests travel.  Counts and minima are combined before they are shuffled, and
    only digests seen twice are joined.  Pairs are made one before that join, and its result is
    dealt anew by both, so the side that a common payload makes large can be split.
    """
    keyed = pages.where(F.length("payload") >= min_bytes).select("page_id", "id_key", "digest")
    shared = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return keyed.select("id_key", "digest").distinct().join(shared, "digest").select("id_key", "digest", "refers_to", F.lit(True).alias("shared"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3) -> tuple[str, DataFrame]:
    """(folder, captures written): a record for each row, payload the html in UTF-8 (null: empty).

    Rows meet their first capture by page_id and digest, so that payloads are dealt evenly.
    Repeated page_ids are each a record.  Of the records with one payload that with the smallest
    page_id is the response, of equal page_ids the first by url, null first; the others revisit it.
    A null page_id comes after all others; where all are null, the revisits refer to null.  An
    empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or common.fresh_path(spark, "warc")
    common.make_dirs(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("id_key", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).withColumn("digest", F.sha1("payload"))
    dealt = rows.repartition(common.tasks(pages), "id_key", "digest")
    joined = dealt.join(first_captures(rows, min_bytes), ["id_key", "digest"], "left")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        k, at, answered, out = TaskContext.get().partitionId(), 0, set(), []
        with common.writing(f"{folder}/{k:06d}.warc.gz") as f:
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    for page_id, url, payload, first_id, shared in zip(*(c.slice(lo, 500).to_pylist() for c in batch.columns), strict=True):
                        own = (page_id, digest(payload)) if shared and first_id == page_id else None
                        revisit = bool(shared) and (own is None or own in answered)
                        if own:
                            answered.add(own)
                        raw = gzip.compress(record(page_id, url, payload, first_id, revisit), level, mtime=0)
                        f.write(raw)
                        out.append((surt(url), page_id, k, at, len(raw), "revisit" if revisit else "response"))
                        at += len(raw)
                names = [x.split()[0] for x in WRITTEN_SCHEMA.split(", ")]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                out = []

    # In order, so that a task that runs again writes the same bytes.
    joined = joined.sortWithinPartitions("page_id", "digest", "url")
    return folder, common.materialise(joined.select("page_id", "url", "payload", "refers_to", "shared").mapInArrow(common.tidy(write), WRITTEN_SCHEMA), "captures")


def _rows(records: Iterator[tuple[dict[str, str], bytes]], payloads: bool) -> Iterator:
    """Batches of RECORD_SCHEMA, checked against the digests and sizes recorded."""
    import pyarrow as pa

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = []
    for h, payload in records:
        kind, named, size = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
        if kind == "response" and (digest(payload), len(payload)) != (named, size):
            raise ValueError(f"damaged record {h['warc-record-id']}")
        rows.append((_number(h["warc-record-id"]), kind, _number(h["warc-refers-to"]) if kind == "revisit" else None, h["warc-target-uri"], size, named, payload if payloads and kind == "response" else None))
        if len(rows) == 500:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def _number(record_id: str) -> int | None:
    return None if "null" in record_id else int(record_id.strip("<>").rpartition(":")[2])


def read_archives(spark: SparkSession, folder: str, archives: list[int], payloads: bool = True) -> DataFrame:
    """One row a record, from the archives alone.  A response's size and digest are of the payload
    that was read, and it is an error if they differ from those recorded; a revisit has them from
    its headers, and a null payload."""

    def scan(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                with common.reading(f"{folder}/{k:06d}.warc.gz") as f:
                    yield from _rows(map(parse, members(f)), payloads)

    return common.one_task_each(spark, archives).mapInArrow(scan, RECORD_SCHEMA)


def read_captures(folder: str, captures: DataFrame, tasks: int, payloads: bool = True) -> DataFrame:
    """The rows of read_archives for the captures (page_id, archive, at, length, record_type): a
    range read each, those of an archive in one task and in its order.  It is an error if a record
    is not the one that the capture names."""

    def fetched(batches):
        now, f = None, None
        try:
            for batch in batches:
                for page_id, archive, at, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive != now:
                        if f:
                            f.close()
                        now, f = archive, common.reading(f"{folder}/{archive:06d}.warc.gz")
                    f.seek(at)
                    h, payload = parse(gzip.decompress(f.read(length)))
                    if (h["warc-type"], _number(h["warc-record-id"])) != (kind, page_id):
                        raise ValueError(f"the index names another record than {h['warc-record-id']}")
                    yield h, payload
        finally:
            if f:
                f.close()

    dealt = captures.select("page_id", "archive", "at", "length", "record_type").repartitionById(tasks, F.col("archive")).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(lambda batches: _rows(fetched(batches), payloads), RECORD_SCHEMA)


def archives_of(captures: DataFrame) -> list[int]:
    """The numbers of the archives that hold a record: one small row an archive."""
    return [r.archive for r in captures.select("archive").distinct().collect()]


# --- the two-level index --------------------------------------------------------------------------


def write_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> None:
    """Captures sorted by SURT key into gzip blocks of block_lines lines, and the directory: the
    first key, shard, offset and length of each block.  A key that very many captures share fills
    consecutive blocks; shards are dealt by (key, archive, offset), so it may also fill shards."""
    common.make_dirs(folder)
    dealt = captures.repartitionByRange(common.tasks(captures), "surt", "archive", "at").sortWithinPartitions("surt", "archive", "at")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        k, at, lines, first, blocks = TaskContext.get().partitionId(), 0, [], None, []
        with common.writing(f"{folder}/{k:06d}.cdx.gz") as f:

            def flush():
                nonlocal at, lines
                raw = gzip.compress("".join(lines).encode(), 6, mtime=0)
                f.write(raw)
                blocks.append((first, k, at, len(raw)))
                at += len(raw)
                lines = []

            for batch in batches:
                for row in batch.to_pylist():
                    if not lines:
                        first = row["surt"]
                    lines.append(row["surt"] + "\t" + json.dumps({x: row[x] for x in ("page_id", "archive", "at", "length", "record_type")}) + "\n")
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
        names, kinds = ["surt", "shard", "at", "length"], [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*blocks, strict=True)) or [()] * 4, kinds, strict=True)], names)

    dealt.mapInArrow(write, "surt string, shard int, at long, length long").write.mode("overwrite").parquet(f"{folder}/directory")


class CaptureIndex:
    """Look-ups by URL.  The directory (a row for each block_lines captures) is held sorted."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.parquet(f"{folder}/directory").orderBy("shard", "at").collect()
        self.folder, self.keys, self.blocks = folder, [r.surt for r in rows], [(r.shard, r.at, r.length) for r in rows]

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL, in the order of the index."""
        key = surt(url)
        return [x for i in _blocks_of(self.keys, key) for x in _captures_of(_block(self.folder, self.blocks[i]), key)]

    def lookup_all(self, pages: DataFrame, url_col: str = "url") -> DataFrame:
        """The captures of all URLs of a table, each once: keys are sought in the directory by
        binary search, then meet at their blocks, each of which is read once."""
        folder, keys, blocks, tasks = self.folder, self.keys, self.blocks, common.tasks(pages)

        def place(batches):
            import pyarrow as pa

            for batch in batches:
                of = [(i, key) for key in {surt(u) for u in batch.column(0).to_pylist()} for i in _blocks_of(keys, key)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in of], pa.int32()), pa.array([k for _, k in of], pa.string())], ["block", "surt"])

        def find(batches):
            import pyarrow as pa

            kinds = {"page_id": pa.int64(), "archive": pa.int32(), "at": pa.int64(), "length": pa.int64(), "record_type": pa.string()}
            table = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in kinds.items()], list(kinds))
            now, lines, found = None, [], []
            for batch in batches:
                for i, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if i != now:
                        now, lines = i, _block(folder, blocks[i])
                    found += _captures_of(lines, key)
                    if len(found) >= 10_000:
                        yield table(found)
                        found = []
            if found:
                yield table(found)

        placed = pages.select(F.col(url_col).cast("string")).mapInArrow(place, "block int, surt string").distinct()
        dealt = placed.repartitionById(tasks, F.col("block")).sortWithinPartitions("block", "surt")
        return dealt.mapInArrow(find, "page_id long, archive int, at long, length long, record_type string")


def _blocks_of(keys: list[str], key: str) -> range:
    """The blocks that may hold a key, by the first keys of all; the one before may end with it."""
    return range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key))


def _block(folder: str, block: tuple[int, int, int]) -> list[str]:
    """The lines of a block, by one range read."""
    shard, at, length = block
    with common.reading(f"{folder}/{shard:06d}.cdx.gz") as f:
        f.seek(at)
        return gzip.decompress(f.read(length)).decode().split("\n")[:-1]


def _captures_of(lines: list[str], key: str) -> Iterator[dict]:
    name = lambda line: line.partition("\t")[0]
    for k in range(bisect.bisect_left(lines, key, key=name), len(lines)):
        if name(lines[k]) != key:
            return
        yield json.loads(lines[k].partition("\t")[2])


def fetch(folder: str, capture: dict) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one capture, by a range read of its archive."""
    with common.reading(f"{folder}/{capture['archive']:06d}.warc.gz") as f:
        f.seek(capture["at"])
        return parse(gzip.decompress(f.read(capture["length"])))


def oracle(min_bytes: int = 0, table: str = "pages") -> str:
    """What the archives hold, in DuckDB's SQL; base32 takes five hexadecimal digits at a time."""
    letters = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in range(4))
    return f"""
WITH hashed AS (
  SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {table}),
firsts AS (
  SELECT *, payload_bytes >= {min_bytes} AND row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) > 1 AS again, min(page_id) OVER (PARTITION BY h) AS first FROM hashed)
SELECT page_id, payload_bytes, ''{letters} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM firsts"""
