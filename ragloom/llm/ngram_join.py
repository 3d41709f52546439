"""N-gram Jaccard join: exact links between documents by signature trees.

Documents with equal shingle sets are one from the start.  An exact filter (shared rare shingles)
then gathers all documents that could be linked, directly or by way of others, into clusters; each
cluster's sets travel once and are joined by a signature tree: nodes hold the OR of their
documents' bitmaps and the range of their set sizes, and a dual traversal drops pairs of nodes whose
largest possible overlap is too small.  Leaves are checked on the sets themselves.

The filter.  Shingles have one global order: those whose hash lies below SAMPLED first, less the
HEAVY ones among them (the commonest, counted over all documents), by hash; then the heavy ones;
then the rest.  Two sets that reach the similarity share a shingle among the first
p = n - ceil(similarity * n) + 1 of each.  Where the shared ones are not heavy, the documents even
share p - (n - least overlap) of them, for the smaller of these two numbers, or they aren't linked.
Counted shingles of one document only can't be shared, so they take a place in front but don't travel.

Common passages gather unrelated documents by the heavy shingles into clusters that grow with the
table.  Within the largest clusters all shingles are therefore counted, and the filter is applied once
more with the rarest first, which parts them again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Share of the hashes whose shingles are counted, and come first; above p / n with room to spare.
SAMPLED = 0.26
#: A counted shingle of more documents than COMMON is heavy; at most HEAVY of them, the commonest
#: first.  Which shingles these are is a matter of speed: any set gives the same links.
COMMON, HEAVY = 24, 200_000
#: Documents with a shingle in front in common: all pairs up to RUN, beyond it edges to the first.
RUN = 64
#: A cluster beyond these documents or shingles is joined part by part, at first of PART documents,
#: dealt anew so many times at most, then in blocks of two times BLOCK.  All this is a matter of speed.
PART_DOCS, PART_SHINGLES, PART, ROUNDS, BLOCK = 500, 2_000_000, 100, 4, 400
#: A cluster so many times as large is parted by all its shingles first.
WIDE = 8
LEAF, FANOUT = 8, 8

SETS_SCHEMA = "doc_id long, of_text long, n long, fp binary, free array<long>, heavy array<long>"


class _Words(dict):
    """64-bit hash of each word; bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > self.limit:
                self.clear()
            self[word] = h
        return h


def shingles(np, table: _Words, text: str | None, size: int):
    """The sorted distinct 64-bit hashes of a text's shingles of `size` words; of the whole
    sequence if it is shorter; none without words.  A-Z are lower-cased."""
    words = text.encode().lower().split() if text else ()  # of bytes: A-Z and ASCII white space only
    k = min(size, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(n, m, percent: int):
    """The smallest whole overlap of sets of n and m that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def front(n, percent: int):
    """How many of n shingles, in the global order, stand in front."""
    return n + percent * n // -100 + 1


def _bound(np):
    return np.uint64(int(SAMPLED * (1 << 64)))


def repeated_shingles(texts: DataFrame, size: int):
    """(heavy, filter): the heavy shingles, sorted, and a Bloom filter of those counted at least
    twice.  Counts are over all documents; at most HEAVY shingles come to the driver."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        table, held, n = _Words(), [], 0

        def counted(parts):
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["shingle", "n"])

        for text in common.each_text(batches):
            s = shingles(np, table, text, size)
            held.append(s[: np.searchsorted(s, _bound(np))].copy())
            n += len(held[-1])
            if n > 2_000_000:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    counts = texts.select("text").mapInArrow(common.tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = common.materialise(counts.where("n > 1"), "shingles")
    top = counts.where(F.col("n") > COMMON).orderBy(F.col("n").desc(), "shingle").limit(HEAVY).select("shingle").toArrow()
    return np.sort(top["shingle"].to_numpy().astype(np.int64).view(np.uint64)), _members(counts.select("shingle"), counts.count())


def document_sets(texts: DataFrame, heavy, repeated, size: int, percent: int) -> DataFrame:
    """doc_id, of_text (hash of the text), n (set size), fp (of the set), and the shingles in front:
    free and heavy ones.

    Counted shingles that no other document has are left out: nothing can be shared by them."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table, names = _Words(), ["doc_id", "of_text", "n", "fp", "free", "heavy"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sizes, prints, free, common_ones = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(np, table, text, size)
                    n = len(s)
                    p = front(n, percent) if n else 0
                    cut = int(np.searchsorted(s, _bound(np)))
                    known = s[:cut]
                    at = np.searchsorted(heavy, known)
                    hot = heavy[np.minimum(at, len(heavy) - 1)] == known if len(heavy) else np.zeros(cut, bool)
                    a = known[~hot][:p]
                    c = known[hot][: p - len(a)] if len(a) < p else known[:0]
                    b = s[cut : cut + p - len(a) - len(c)]
                    slot, bit = _slot(np, a.view(np.int64), 8 * len(repeated))
                    a = a[(repeated[slot] & bit) != 0]
                    sizes.append(n), free.append(np.concatenate([a, b]).view(np.int64)), common_ones.append(c.view(np.int64))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (free, common_ones)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *lists], names)

    return texts.select("doc_id", F.xxhash64("text").alias("of_text"), "text").mapInArrow(common.tidy(run), SETS_SCHEMA)


def _candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked documents are connected by these edges."""
    few = _pairs_in_runs(reps.select("node", "n", F.explode("free").alias("key")), percent)
    heavy = reps.select("node", F.explode("heavy").alias("key"))
    # A row for each heavy shingle: at most HEAVY, so it can go to every task.
    hubs = heavy.groupBy("key").agg(F.min("node").alias("hub"))
    return few.union(heavy.join(F.broadcast(hubs), "key").where("node > hub").select("hub", "node").distinct())


def _pairs_in_runs(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): of (node, n, key), the pairs that share as many keys as linked documents must."""
    dealt = keys.repartition("key").sortWithinPartitions("key", "node")

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        rest = None  # the last run of a batch may go on in the next; only its first RUN + 1 rows are kept
        first = None  # (key, its first document), once a run is longer than RUN

        def out(a, b, need):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need)], ["a", "b", "need"])

        def emit(key, rep, n):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for size in np.unique(sizes[(sizes > 1) & (sizes <= RUN)]).tolist():
                at = starts[sizes == size]
                i, j = np.triu_indices(size, 1)
                for lo in range(0, len(at), max(1, 300_000 // len(i))):
                    some = at[lo : lo + max(1, 300_000 // len(i))]
                    x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    nx, ny = n[x], n[y]
                    near = (np.minimum(nx, ny) * 100 >= percent * np.maximum(nx, ny)) & (rep[x] != rep[y])
                    x, y, nx, ny = x[near], y[near], nx[near], ny[near]
                    over = least_overlap(nx, ny, percent)
                    need = np.minimum(front(nx, percent) - (nx - over), front(ny, percent) - (ny - over))
                    yield out(rep[x], rep[y], np.maximum(need, 1))
            for at, size in zip(starts[sizes > RUN].tolist(), sizes[sizes > RUN].tolist(), strict=True):
                yield out(np.full(size - 1, rep[at]), rep[at + 1 : at + size], np.zeros(size - 1, np.int64))

        for batch in batches:
            rep, n, key = (batch.column(c).to_numpy() for c in ("node", "n", "key"))
            if first is not None:
                same = int(np.searchsorted(key, first[0], "right")) if len(key) and key[0] == first[0] else 0
                if same:
                    yield out(np.full(same, first[1]), rep[:same], np.zeros(same, np.int64))
                    rep, n, key = rep[same:], n[same:], key[same:]
                if not len(key):
                    continue
                first = None
            if rest is not None:
                key, rep, n = (np.concatenate(x) for x in zip(rest, (key, rep, n), strict=True))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield from emit(key[:last], rep[:last], n[:last])
            rest = key[last:], rep[last:], n[last:]
            if len(rest[0]) > RUN:
                yield from emit(*rest)
                first, rest = (rest[0][0], rest[1][0]), None
        if rest is not None:
            yield from emit(*rest)

    found = dealt.mapInArrow(common.tidy(pairs), "a long, b long, need long")
    return found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")


def _parted(held: DataFrame, percent: int) -> DataFrame:
    """The documents of large clusters (node, fp, n, cluster, items) in clusters of their own; those
    that can be linked with no other are left out.

    Here all shingles are counted within their cluster, and the rarest come first; runs of more than
    RUN documents give edges to their first.  A task gets a number for each document of a key."""
    held = common.materialise(held.dropDuplicates(["node"]), "large")  # rows that repeat id and text are there twice

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for node, n, cluster, items in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "cluster", "items")), strict=True):
                keys = np.frombuffer(items, np.uint64) ^ np.uint64(cluster * 0x9E3779B97F4A7C15 % (1 << 64))
                for lo in range(0, len(keys), 100_000):
                    part = keys[lo : lo + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), n)), pa.array(part)], ["node", "n", "key"])

    keys = held.select("node", "n", "cluster", "items").mapInArrow(common.tidy(spread), "node long, n long, key long")
    of_key, of = Window.partitionBy("key"), Window.partitionBy("node")
    counted = keys.withColumn("docs", F.count("*").over(of_key)).where("docs > 1")
    placed = counted.select("node", "n", "key", F.row_number().over(of.orderBy("docs", "key")).alias("place"), F.count("*").over(of).alias("shared"))
    fronts = placed.where(F.expr(f"n - shared + place <= n - ({percent} * n + 99) div 100 + 1")).select("node", "n", "key")  # those of one document stand before
    fronts = fronts.withColumn("docs", F.count("*").over(of_key)).withColumn("hub", F.min("node").over(of_key)).where("docs > 1")
    fronts = common.materialise(fronts, "fronts")
    few = _pairs_in_runs(fronts.where(F.col("docs") <= RUN).select("node", "n", "key"), percent)
    many = fronts.where((F.col("docs") > RUN) & (F.col("node") > F.col("hub"))).select("hub", "node").distinct()
    clusters = connected_components(few.union(many)).withColumnRenamed("component", "cluster")
    parted = common.materialise(held.drop("cluster").join(clusters, "node").select("node", "fp", "n", "cluster", "items"), "parted")
    for frame in (held, fronts):
        common.discard(frame)
    return parted


def _members(wanted: DataFrame, n: int):
    """A Bloom filter of n longs: one hash, 16 bits for each, at most 64 MB; where it is too small it
    lets more through."""
    import numpy as np

    bits = 1 << min(29, max(16, (16 * n).bit_length()))

    def mark(batches):
        import pyarrow as pa

        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            np.bitwise_or.at(found, *_slot(np, batch.column(0).to_numpy(), bits))
        for at in np.flatnonzero(found.reshape(-1, 1024).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([found[at * 1024 : (at + 1) * 1024].tobytes()], pa.binary())], ["at", "bytes"])

    def merge(part):
        import pyarrow as pa

        whole = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("bytes")], axis=0)
        return pa.table({"at": part.column("at").slice(0, 1), "bytes": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in wanted.mapInArrow(common.tidy(mark), "at int, bytes binary").groupBy("at").applyInArrow(merge, "at int, bytes binary").collect():
        out[row.at * 1024 : (row.at + 1) * 1024] = np.frombuffer(bytes(row.bytes), np.uint8)
    return out


def _slot(np, ids, bits: int):
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) & np.uint64(bits - 1)
    return (h >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (h & np.uint64(7)).astype(np.uint8))


def _fetch_sets(texts: DataFrame, wanted, size: int) -> DataFrame:
    """(doc_id, fp, items) of the documents that the filter lets through."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table = _Words()
        for batch in batches:
            at, bit = _slot(np, batch.column(0).fill_null(0).to_numpy(), 8 * len(wanted))
            part = batch.take(pa.array(np.flatnonzero(wanted[at] & bit)))
            for lo in range(0, part.num_rows, 500):
                some = part.slice(lo, 500)
                sets = [shingles(np, table, t, size).tobytes() for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "fp", "items"])

    return texts.mapInArrow(common.tidy(run), "doc_id long, fp binary, items binary")


# --- the signature tree ---------------------------------------------------------------------------


class SignatureTree:
    """Documents in order of their smallest shingle, LEAF to a leaf, FANOUT nodes to a parent.

    levels[k] has, for each node: the OR of its documents' bitmaps, the least and the greatest set
    size, and the most shingles of a document beyond its set bits (those that share a bit)."""

    def __init__(self, np, members, sets, bits: int):
        self.np = np
        smallest = np.asarray([sets[m][0] for m in members], np.uint64)
        self.members = np.asarray(members)[np.lexsort(([len(sets[m]) for m in members], smallest))]
        self.sizes = np.asarray([len(sets[m]) for m in self.members], np.int64)
        self.maps = np.zeros((len(members), bits // 64), np.uint64)
        for row, m in enumerate(self.members):
            at = sets[m] & np.uint64(bits - 1)
            np.bitwise_or.at(self.maps[row], (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63)))
        self.spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        cuts = np.arange(0, len(members), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.maps, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.spare, cuts))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))

    def below(self, level: int, node: int) -> range:
        width, count = (FANOUT, len(self.levels[level - 1][0])) if level else (LEAF, len(self.members))
        return range(node * width, min((node + 1) * width, count))


def possible(np, a, b, percent: int):
    """Which pairs of the rows of a and b (maps, least size, greatest size, spare) can hold a link.

    A document x shares at most n(x) - bits(x) + |bits(x) & bits(y)| shingles with y."""
    common_bits = np.bitwise_count(a[0][:, None, :] & b[0][None, :, :]).sum(axis=2, dtype=np.int64)
    most = common_bits + np.minimum(a[3][:, None], b[3][None, :])
    least = least_overlap(a[1][:, None] + 0, b[1][None, :], percent)
    return (most >= least) & (a[2][:, None] * 100 >= percent * b[1][None, :]) & (b[2][None, :] * 100 >= percent * a[1][:, None])


def tree_join(np, left: SignatureTree, right: SignatureTree, sets, parent, percent: int) -> None:
    """Unite the linked documents of two trees (or of one with itself) in the forest `parent`.

    Pairs of leaves whose documents are all united already are passed over."""

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    same, top = left is right, (len(left.levels) - 1, len(right.levels) - 1)
    stack = [(top[0], 0, top[1], 0)]
    while stack:
        i, a, j, b = stack.pop()
        if i or j:
            rows = left.below(i, a) if i >= j else range(a, a + 1)
            cols = right.below(j, b) if j >= i else range(b, b + 1)
            i2, j2 = (i - 1 if i >= j else i), (j - 1 if j >= i else j)
            ok = possible(np, [x[rows.start : rows.stop] for x in left.levels[i2]], [x[cols.start : cols.stop] for x in right.levels[j2]], percent)
            for r, c in zip(*np.nonzero(ok), strict=True):
                if not same or rows.start + r <= cols.start + c:
                    stack.append((i2, rows.start + int(r), j2, cols.start + int(c)))
            continue
        rows, cols = left.below(0, a), right.below(0, b)
        roots = {root(int(m)) for m in left.members[rows.start : rows.stop]} | {root(int(m)) for m in right.members[cols.start : cols.stop]}
        if len(roots) == 1:
            continue
        one = lambda t, s: (t.maps[s.start : s.stop], t.sizes[s.start : s.stop], t.sizes[s.start : s.stop], t.spare[s.start : s.stop])
        for r, c in zip(*np.nonzero(possible(np, one(left, rows), one(right, cols), percent)), strict=True):
            x, y = int(left.members[rows.start + r]), int(right.members[cols.start + c])
            if same and rows.start + r >= cols.start + c:
                continue
            p, q = root(x), root(y)
            if p != q and linked(np, sets[x], sets[y], percent):
                parent[max(p, q)] = min(p, q)


def linked(np, x, y, percent: int) -> bool:
    """Of two sorted sets, exactly."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _join_clusters(members: DataFrame, fetched: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning edges of the linked documents of each cluster.

    A cluster of up to PART_DOCS documents and PART_SHINGLES shingles is one task's.  Those
    WIDE times as large are parted by all their shingles first.  What is still larger is dealt by size, as sets of sizes
    too far apart can't be linked, and then by hash to parts of PART documents; each part is joined
    by itself and with the cluster's hub, its first document.
    Where that leaves a component of a tenth of the cluster or more, it is dealt by other hashes
    and joined again, up to ROUNDS times, which mostly makes near copies one component.  What is
    left outside a cluster's largest component is then joined with the documents of all sizes in
    reach, block by block.  So a large group of near copies costs some rows a document, and only
    documents that may yet be linked anew are compared again.
    """
    held = common.materialise(members.join(fetched.withColumnRenamed("doc_id", "rep"), ["rep", "fp"]).select("node", "fp", "n", "cluster", "items"), "members")
    wide = _large(held, WIDE)
    if not wide.isEmpty():
        parted = _parted(held.join(wide, "cluster", "left_semi"), percent)
        held = held.join(wide, "cluster", "left_anti").unionByName(parted)
    large = _large(held)
    if large.isEmpty():
        rows = held.select("cluster", F.lit(0).cast("long").alias("band"), F.lit(0).alias("part"), "node", F.col("node").alias("component"), "items")
        return common.materialise(_join_groups(rows, percent, both=False), "spans")
    band = F.floor(F.log("n") / math.log(100 / percent * 1.000001)).cast("long")  # linked sets are in one band or in neighbours
    tagged = held.join(large, "cluster", "left").withColumn("band", F.when(F.col("large"), band).otherwise(0))
    most = held.join(large, "cluster", "left_semi").withColumn("band", band)  # only their sets travel again
    items = most.select("node", "items")
    bands = common.materialise(_parts(most, PART), "bands")
    hubs = most.groupBy("cluster").agg(F.min(F.struct("node", "band")).alias("hub")).join(bands, "cluster").where(F.abs(F.col("hub.band") - F.col("band")) <= 1)
    hubs = hubs.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hub.node", F.col("hub.node").alias("component")).join(items, "node")
    rows = _dealt(tagged.withColumn("component", F.col("node")), bands, 0, "component", "items").unionByName(hubs)
    spans = [common.materialise(_join_groups(rows, percent, both=False), "spans")]
    everyone = common.materialise(most.select("cluster", "band", "fp", "n", "node"), "large")
    for k in range(1, ROUNDS + 1):
        again, shares = _components_within(everyone, spans)
        dense = shares.where("main_docs < docs AND 10 * main_docs >= docs").select("cluster")
        if k == ROUNDS or dense.isEmpty():
            break
        rows = again.join(dense, "cluster", "left_semi")
        rows = _dealt(rows, _parts(rows, PART), k, "component").join(items, "node")
        spans.append(common.materialise(_join_groups(rows, percent, both=False), "spans"))
    found = reduce(DataFrame.union, spans)
    rest = common.materialise(again.join(shares.select("cluster", "main"), "cluster").where("component <> main").drop("main"), "rest")
    if rest.isEmpty():
        return found
    lefts, rights = _parts(rest, BLOCK), _parts(again.join(rest.select("cluster").distinct(), "cluster", "left_semi"), BLOCK)
    left = rest.join(lefts, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).drop("parts")
    left = left.join(rights.withColumnRenamed("band", "other_band"), "cluster").where("abs(band - other_band) <= 1")
    left = left.select("cluster", "band", "part", "node", "component", "other_band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), F.lit(0).alias("side"))
    right = again.join(rights, ["cluster", "band"]).withColumn("other", F.pmod(F.xxhash64("fp"), "parts").cast("int")).drop("parts").withColumnRenamed("band", "other_band")
    right = right.join(lefts, "cluster").where("abs(band - other_band) <= 1")
    right = right.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "component", "other_band", "other", F.lit(1).alias("side"))
    return found.union(_join_groups(left.union(right).join(items, "node"), percent, both=True))


def _large(held: DataFrame, times: int = 1) -> DataFrame:
    """cluster, large (true) of the clusters that aren't one task's; or so many times as large."""
    sizes = held.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    return common.materialise(sizes.where((F.col("docs") > times * PART_DOCS) | (F.col("shingles") > times * PART_SHINGLES)).select("cluster", F.lit(True).alias("large")), "large")


def _dealt(rows: DataFrame, bands: DataFrame, seed: int, *more: str) -> DataFrame:
    """cluster, band, part, node and more, by a hash that differs with the seed."""
    placed = rows.join(bands, ["cluster", "band"], "left")
    return placed.select("cluster", "band", F.pmod(F.xxhash64("fp", F.lit(seed)), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "node", *more)


def _components_within(everyone: DataFrame, spans: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The documents of large clusters with their components so far; and each cluster's number of
    documents, its largest component and that one's."""
    edges = reduce(DataFrame.union, spans).join(everyone.select(F.col("node").alias("a")), "a", "left_semi")
    again = everyone.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    again = common.materialise(again.select("cluster", "band", "fp", "n", "node", "component"), "again")
    counted = again.groupBy("cluster", "component").agg(F.count("*").alias("docs"))
    shares = counted.groupBy("cluster").agg(F.sum("docs").alias("docs"), F.max(F.struct("docs", "component")).alias("most"))
    return again, common.materialise(shares.select("cluster", "docs", F.col("most.component").alias("main"), F.col("most.docs").alias("main_docs")), "shares")


def _parts(rows: DataFrame, docs: int) -> DataFrame:
    """cluster, band, parts: of so many documents, and of PART_SHINGLES."""
    return rows.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))


def _join_groups(rows: DataFrame, percent: int, both: bool) -> DataFrame:
    """(a, b): spanning edges of the documents of each group (cluster, band, part, and if there are
    both sides other_band, other): of one side, all with all; of two, each of one with each of the
    other.  Documents that share a component are linked already; the edges join components."""
    if not both:
        rows = rows.select("*", F.lit(0).alias("other_band"), F.lit(0).alias("other"), F.lit(0).alias("side"))
    group = ["cluster", "band", "part", "other_band", "other"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "side", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, now = [], None

        def join():
            sides = [[k for k, h in enumerate(held) if h[0] == side] for side in (0, 1)]
            if both and not (sides[0] and sides[1]):
                return
            ids, of = np.asarray([h[1] for h in held], np.int64), np.asarray([h[2] for h in held], np.int64)
            sets = [np.frombuffer(h[3], np.uint64) for h in held]
            first: dict[int, int] = {}
            parent = [first.setdefault(c, k) for k, c in enumerate(of.tolist())]
            bits = 1 << min(16, max(8, (2 * max(map(len, sets))).bit_length()))
            trees = [SignatureTree(np, part, sets, bits) for part in sides if part]
            tree_join(np, trees[0], trees[-1], sets, parent, percent)
            for k in range(len(parent)):
                while parent[k] != parent[parent[k]]:
                    parent[k] = parent[parent[k]]
            parent = np.asarray(parent)
            apart = np.flatnonzero(of != of[parent])
            yield pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[parent[apart]])], ["a", "b"])

        for batch in batches:
            for *key, side, node, component, its in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield from join()
                    held, now = [], key
                if not held or held[-1][:2] != (side, node):  # a hub is in its own part already
                    held.append((side, node, component, its))
        if len(held) > 1:
            yield from join()

    return dealt.select(*group, "side", "node", "component", "items").mapInArrow(common.tidy(run), "a long, b long")


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, of_text, n, component (a number), least (its smallest doc_id) of each row of docs; the
    last two are null for a null id or a text without words.

    Equal sets are one node with a number of its own, so that different texts under one id stay
    apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heavy, repeated = repeated_shingles(texts, size)
    sets = common.materialise(document_sets(texts, heavy, repeated, size, percent), "sets")
    groups = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("free").alias("free"), F.first("heavy").alias("heavy"))
    nodes = common.materialise(groups.withColumn("node", F.monotonically_increasing_id()), "reps")  # numbered once, then read
    clusters = connected_components(_candidate_edges(nodes, percent)).withColumnRenamed("component", "cluster")
    members = common.materialise(clusters.join(nodes.select("node", "rep", "fp", "n"), "node"), "clusters")
    fetched = _fetch_sets(texts, _members(members.select("rep"), members.count()), size)
    component = connected_components(_join_clusters(members, fetched, percent))
    of = nodes.select("fp", "rep", "node").join(component, "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("component"))
    of = common.materialise(of, "components")
    joined = of.join(component.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("smallest"))
    of = of.join(joined, "component", "left").select("fp", "component", F.coalesce("smallest", "rep").alias("least"))
    slim = sets.select("doc_id", "of_text", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    return slim.join(of, "fp", "left").select("doc_id", "of_text", "n", "component", "least")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Documents whose sets of shingles of `size` words have a Jaccard similarity of percent / 100 or
    more are linked; component_id is the smallest doc_id reachable by links, itself included.  The
    result is exact: no link is lost, none is added (hashes have 64 bits).

    Texts that are null or without words have no shingles and no links.  Shorter texts have their
    whole sequence as one shingle.  Equal rows have equal results.  Rows with one id and different
    texts each have the links of their text, and no others.  A null id has no links and a null
    component.  Other columns are not read.
    """
    found = _components(docs, size, percent, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all columns unchanged.

    Rows are decided by id and text: of rows that repeat both one stays, the first in order of its
    columns as JSON; of one id's texts each that is linked with none before it stays.  Rows with a
    null id all stay, and texts without words are linked with nothing."""
    found = common.materialise(_components(docs, size, percent, id_col, text_col).where("doc_id IS NOT NULL"), "found")
    key = ["doc_id", "of_text"]
    copies = common.materialise(found.groupBy(*key).agg(F.count("*").alias("rows"), F.first("component").alias("component")), "copies")
    firsts = copies.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = common.materialise(firsts, "firsts")  # so that the join below may split a large component
    stays = F.col("first").isNull() | (F.struct(*key) == F.col("first"))
    decided = copies.join(firsts, "component", "left").select(*key, "rows", stays.alias("stays"))
    gone = decided.where("NOT stays OR rows > 1").select(*key)
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("of_text"))
    kept = keyed.join(gone, key, "left_anti").select("row.*")  # null ids meet nothing
    repeated = decided.where("stays AND rows > 1").select(*key)
    if repeated.isEmpty():
        return kept
    once = keyed.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(once.select("row.*"))


def oracle(size: int, percent: int, table: str = "documents") -> str:
    """link_documents in DuckDB's SQL, by all shared shingles."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) END AS s FROM w),
e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least.b, s.doc_id)) AS component_id FROM s LEFT JOIN least ON least.a = s.doc_id"""
