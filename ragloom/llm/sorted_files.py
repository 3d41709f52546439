"""Tables of 64-bit columns in sorted shards of the shared folder, looked up by key."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import common

#: Rows of a block, and blocks that a worker keeps, of a shard that can't be mapped.
STEP, KEPT = 1 << 16, 64


@dataclass(frozen=True)
class SortedTable:
    """shards: (file, rows, first key), in order of their keys; each file has column after column,
    the key first, and then the first key of every STEP rows."""

    folder: str
    columns: int
    shards: tuple[tuple[str, int, int], ...]

    @classmethod
    def write(cls, df: DataFrame, folder: str, name: str) -> SortedTable:
        """The rows of df, whose columns are longs, the first one the key; keys are not repeated."""
        common.make_dirs(folder)
        columns, key = len(df.columns), df.columns[0]
        dealt = df.repartitionByRange(common.tasks(df), key).sortWithinPartitions(key)

        def save(batches):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            file = f"{name}-{TaskContext.get().partitionId():06d}.u8"
            held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
            if held:
                table = [np.concatenate(c) for c in zip(*held, strict=True)]
                with common.writing(f"{folder}/{file}") as f:
                    for c in [*table, table[0][::STEP]]:
                        f.write(c.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(table[0])], pa.int64()), pa.array([int(table[0][0])], pa.int64())], ["file", "n", "first"])

        found = dealt.mapInArrow(save, "file string, n long, first long").collect()  # a row for each task
        return cls(folder, columns, tuple(sorted(((r.file, r.n, r.first) for r in found), key=lambda s: s[2])))

    def opened(self):
        return _Opened(self)


class _Mapped:
    """A memory-mapped shard: a look-up reads the pages that its binary searches touch."""

    def __init__(self, path: str, columns: int, n: int):
        import numpy as np

        self.np, self.table = np, np.memmap(path, dtype="<i8", mode="r", shape=(columns, n))

    def look_up(self, keys):
        """(positions of the sorted keys that are there, their values)."""
        np = self.np
        at = np.minimum(np.searchsorted(self.table[0], keys), self.table.shape[1] - 1)
        hit = np.flatnonzero(self.table[0][at] == keys)
        return hit, self.table[1:, at[hit]]


class _Ranged:
    """A shard in a store that can't be mapped: a look-up reads the blocks that its keys fall in, by
    range; the last ones of all shards are kept."""

    def __init__(self, uri: str, columns: int, n: int, kept: OrderedDict):
        import numpy as np

        self.np, self.uri, self.columns, self.n, self.kept = np, uri, columns, n, kept
        with common.reading(uri) as f:
            f.seek(8 * columns * n)
            self.first = np.frombuffer(f.read(8 * -(-n // STEP)), "<i8")

    def _block(self, f, b: int):
        key = self.uri, b
        if key not in self.kept:
            lo, hi = b * STEP, min((b + 1) * STEP, self.n)
            rows = []
            for c in range(self.columns):
                f.seek(8 * (c * self.n + lo))
                rows.append(self.np.frombuffer(f.read(8 * (hi - lo)), "<i8"))
            self.kept[key] = self.np.stack(rows)
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def look_up(self, keys):
        np = self.np
        of = np.maximum(np.searchsorted(self.first, keys, "right") - 1, 0)
        hits, values = [np.zeros(0, np.int64)], [np.zeros((self.columns - 1, 0), np.int64)]
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        with common.reading(self.uri) as f:
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
                block, part = self._block(f, int(of[lo])), keys[lo:hi]
                at = np.minimum(np.searchsorted(block[0], part), block.shape[1] - 1)
                hit = np.flatnonzero(block[0][at] == part)
                hits.append(lo + hit)
                values.append(block[1:, at[hit]])
        return np.concatenate(hits), np.concatenate(values, axis=1)


class _Opened:
    """All shards of a table; none is read whole."""

    def __init__(self, table: SortedTable):
        import numpy as np

        self.np, kept = np, OrderedDict()
        self.shards = [self._open(f"{table.folder}/{f}", table.columns, n, kept) for f, n, _ in table.shards]
        self.first = np.asarray([s[2] for s in table.shards], np.int64)
        self.columns = table.columns

    @staticmethod
    def _open(uri: str, columns: int, n: int, kept: OrderedDict):
        path = common.local_path(uri)
        return _Mapped(path, columns, n) if path else _Ranged(uri, columns, n, kept)

    def find(self, keys):
        """(columns - 1, len(keys)): the values of each key, 0 where it is absent."""
        np = self.np
        out = np.zeros((self.columns - 1, len(keys)), np.int64)
        if not self.shards:
            return out
        order = np.argsort(keys)
        ranked = keys[order]
        cuts = np.searchsorted(ranked, self.first)
        for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(ranked)], strict=True)):
            if lo < hi:
                hit, values = self.shards[k].look_up(ranked[lo:hi])
                out[:, order[lo:hi][hit]] = values
        return out
