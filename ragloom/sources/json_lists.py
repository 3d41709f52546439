"""Large JSON lists, cut into their items by many tasks.

Spark's text reader cuts a file at each closing brace, in blocks that any store gives it.  Whether a
block begins inside a string, and how deep, follows from the blocks before it: a first pass counts
quotes and brackets of each block for both cases, a second one cuts with what is then known."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

SEPARATOR = "}"
#: Bytes that are looked at together.
STRETCH = 4_000_000
_NEVER = 1 << 40


def structure(data: bytes):
    """(places, steps, inside, quotes): brackets (steps 1 and -1) and commas (step 0), whether each is
    inside a string if the data begins outside one, and how many quotes there are."""
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    quotes, slashes = np.flatnonzero(a == 34), np.flatnonzero(a == 92)
    if len(quotes) and len(slashes):
        k = np.arange(len(slashes))
        begins = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, k, 0))
        odd = slashes[(k - begins) % 2 == 0]  # what follows an odd number of backslashes is escaped
        quotes = quotes[~np.isin(quotes - 1, odd, assume_unique=True)]
    step = np.zeros(256, np.int8)
    step[[91, 123]], step[[93, 125]] = 1, -1
    wanted = step != 0
    wanted[44] = True
    places = np.flatnonzero(wanted[a])
    return places, step[a[places]], np.searchsorted(quotes, places) % 2 == 1, len(quotes)


def _stretches(batches):
    """(file, size, block, data) of a task's pieces, put together again in order; the brace that a
    piece was cut off by stands before the next one."""
    last = None
    for batch in batches:
        for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: r[:3]):
            data, held = [], 0
            for *_, piece in rows:
                if last == key or key[2] > 0:
                    data.append(b"}")
                data.append(piece)
                last, held = key, held + len(piece) + 1
                if held > STRETCH:
                    yield *key, b"".join(data)
                    data, held = [], 0
            if data:
                yield *key, b"".join(data)


def _count(batches):
    """A row a block: bytes, quotes, its first character but blanks, and for both cases the change of
    depth, the least depth, and the commas of each depth, all as seen from its beginning."""
    import numpy as np
    import pyarrow as pa

    out = []
    for key, stretches in groupby(_stretches(batches), lambda s: s[:3]):
        n, quotes, head, depth, low, commas = 0, 0, b"", [0, 0], [_NEVER, _NEVER], [{}, {}]
        for *_, data in stretches:
            places, steps, inside, found = structure(data)
            head = head or data.lstrip(b" \t\r\n")[:1]
            for case in (0, 1):
                seen = steps[inside == bool((case + quotes) % 2)]
                if not len(seen):
                    continue
                at = depth[case] + np.cumsum(seen, dtype=np.int64)
                low[case] = min(low[case], int(at.min()))
                for d, m in zip(*(x.tolist() for x in np.unique(at[seen == 0], return_counts=True)), strict=True):
                    commas[case][d] = commas[case].get(d, 0) + m
                depth[case] = int(at[-1])
            n, quotes = n + len(data), quotes + found
        out.append({"file": key[0], "size": key[1], "block": key[2], "bytes": n, "quotes": quotes, "head": head, "depth": depth, "low": low, "commas": [list(c.items()) for c in commas]})
    kinds = [("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.int64()), ("head", pa.binary()), ("depth", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64())))]
    yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


_COUNTED = "file string, size long, block long, bytes long, quotes long, head binary, depth array<long>, low array<long>, commas array<map<long,long>>"


def _begins(blocks: list) -> dict[tuple[str, int], tuple[int, int, int, int, bool]]:
    """(inside a string, depth, items before, depth of the items, a brace follows) of each block of files
    that hold a list or an object to its end."""
    out = {}
    for file, rows in groupby(sorted(blocks, key=lambda r: (r.file, r.block)), lambda r: r.file):
        rows = list(rows)
        lost = rows[0].size - sum(r.bytes for r in rows)  # a last brace has no piece after it
        if lost not in (0, 1):
            raise ValueError(f"{file} has {rows[0].size} bytes, of which {-lost} too many were read")
        base = {b"[": 1, b"{": 0}.get(next((h for r in rows if (h := bytes(r.head))), b""))
        if base is None:
            continue
        inside, depth, before, found = 0, 0, 0, {}
        for k, r in enumerate(rows):
            low, change, brace = r.low[inside], r.depth[inside], lost == 1 and k == len(rows) - 1
            found[file, r.block] = (inside, depth, before, base, brace)
            inside_then = (inside + r.quotes) % 2
            if brace and not inside_then:
                low = min(low, change - 1)
            if depth + low <= 0:  # what follows the end is passed over, as for smaller files
                out |= found
                break
            before += r.commas[inside].get(1 - depth, 0) if base else 0
            inside, depth = inside_then, depth + change
    return out


def _cut(begins):
    def run(batches):
        """file, idx, block, whole, text: items, or those parts of an item that are in this block."""
        import numpy as np
        import pyarrow as pa

        names = ["file", "idx", "block", "whole", "text"]
        for (file, _, block), stretches in groupby(_stretches(batches), lambda s: s[:3]):
            if (file, block) not in begins:
                continue
            inside, depth, idx, base, brace = begins[file, block]
            whole, held, started, ended = False, [], depth > 0, False
            for last, data in _with_last(s[3] for s in stretches):
                if ended:
                    continue
                data, out, lo = data + b"}" if last and brace else data, [], 0
                places, steps, swapped, quotes = structure(data)
                outside = swapped == bool(inside)
                places, steps = places[outside], steps[outside]
                at = depth + np.cumsum(steps, dtype=np.int64)
                for j in np.flatnonzero((at == 0) | ((steps == 0) & (at == base)) | ((steps == 1) & (at == 1))).tolist():
                    place, step = int(places[j]), int(steps[j])
                    if step == 1:
                        lo, started, whole = place + base, True, True  # the list or object begins
                        continue
                    if step == 0 and not base:
                        continue
                    ended = step == -1
                    held.append(data[lo : place + (1 - base if ended else 0)])
                    out.append((idx, whole, b"".join(held)))
                    lo, held, whole, idx = place + 1, [], True, idx + 1
                    if ended:
                        break
                if started and not ended:
                    held.append(data[lo:])
                depth, inside = int(at[-1]) if len(at) else depth, (inside + quotes) % 2
                if last and not ended and held:
                    out.append((idx, False, b"".join(held)))
                if out:
                    n = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([o[0] for o in out], pa.int64()), pa.array([block] * n, pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.binary())], names)

    return run


def _with_last(values):
    """(whether it is the last, value) of each."""
    values = iter(values)
    held = next(values)
    for value in values:
        yield False, held
        held = value
    yield True, held


def items(pieces: DataFrame) -> DataFrame | None:
    """file, idx, n, v (a list of one variant) of each item, from a text reader's rows (file, size,
    block, value) cut at SEPARATOR; None if there are no rows.  Files that are no JSON give none."""
    pieces = pieces.select("file", "size", "block", F.col("value").cast("binary"))
    begins = _begins(pieces.mapInArrow(_count, _COUNTED).collect())  # a row a block
    if not begins:
        return None
    cut = written(pieces.mapInArrow(_cut(begins), "file string, idx long, block long, whole boolean, text binary").withColumn("text", F.col("text").cast("string")))
    parted = cut.where("NOT whole").groupBy("file", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    texts = cut.where("whole").select("file", "idx", "text").unionByName(parted)
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))), "$", "array<variant>")
    sizes = texts.groupBy("file").agg((F.max("idx") + 1).cast("int").alias("n"), F.bool_and(F.coalesce(F.size(one) == 1, F.lit(False))).alias("valid")).collect()  # a row a large file
    n = [F.lit(x) for r in sizes if r.valid for x in (r.file, r.n)]
    if not n:
        return None
    return texts.withColumn("n", F.create_map(*n)[F.col("file")]).where("n IS NOT NULL").select("file", F.col("idx").cast("int"), "n", one.alias("v"))
