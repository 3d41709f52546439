"""Best-fit packing of token pieces into sequences of bounded length, improved by local search."""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The token pieces of every whole text (null: empty), end_id appended; only documents longer
    than the capacity are cut, into pieces of that length and a last one that may be shorter.

    with_ids adds the ids themselves (little-endian unsigned 32-bit integers)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = 4 * capacity

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode, end = encoder(tokenizer_path).encode_all, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, code in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    code += end
                    for k, at in enumerate(range(0, len(code), width)):
                        raw = code[at : at + width]
                        doc.append(d), piece.append(k), start.append(at // 4), length.append(len(raw) // 4), crc.append(zlib.crc32(raw))
                        if with_ids:
                            ids.append(raw)
                out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return rows.mapInArrow(common.tidy(cut), PIECE_SCHEMA + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = 2048, group_rows: int = 32_768) -> DataFrame:
    """The rows of `cut` (with a column length, 1 to capacity) and sequence_id, offset.

    The rows are dealt evenly, whatever their keys, to groups of about group_rows; each group packs
    its own bins, so at most one bin a group is left with room that other groups could have used.
    Rows are only counted and numbered: texts and ids need not travel.  sequence_id is the group's
    number times 2**32 plus the bin's.
    """
    n = cut.count()
    groups = max(1, -(-n // group_rows))
    at, schema = cut.columns.index("length"), cut.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets = fill(table.column(at).to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from table.to_batches(10_000)

    return cut.repartition(groups).mapInArrow(common.tidy(place), schema)


def fill(lengths, capacity: int = 2048):
    """(bin of each length, its offset there): best fit as the lengths come, then local search.

    If that leaves more bins than the total length asks for, best fit in descending order and the
    search from there are tried too, and the fewer bins count.  From the unsorted start the search
    has short documents in all bins to exchange and mostly ends nearer the bound."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    plain, least, bins = lengths.tolist(), -(-int(lengths.sum()) // capacity), None
    for order in (range(len(plain)), np.argsort(-lengths, kind="stable").tolist()):
        found = [b for b in improve(best_fit(plain, order, capacity), plain, capacity) if b]
        if bins is None or len(found) < len(bins):
            bins = found
        if len(bins) <= least:
            break
    of, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        of[b] = k
        offsets[b] = np.cumsum(lengths[b]) - lengths[b]
    return of, offsets


def best_fit(lengths: list[int], order, capacity: int) -> list[list[int]]:
    """Each length in the tightest open bin that takes it.

    For each room left the bins that have it are kept, and one bit for each room that any bin has,
    so that the tightest bin for a length is one shift and one lowest bit away."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in order:
        n = lengths[i]
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search over all underfull bins.

    A step moves one document, exchanges one for one, or one for two between two bins, if that
    raises the sum of squared fills (the fuller bin gets fuller).  Bins give in turn, the emptiest
    first, each the step with the largest rise among all takers until it has none.  The sum rises
    with each step, so this ends: when no pair of bins has a step left, or when the bins are as few
    as the total length allows.
    """
    total, used = sum(lengths[i] for b in bins for i in b), sum(map(bool, bins))
    least = -(-total // capacity)
    if used <= least:
        return bins
    takers = _Takers(bins, lengths, capacity)
    rooms, idle = takers.rooms, set()  # idle: bins without a step since the last one made
    while used > least:
        todo = sorted((b for b in takers.options if b not in idle), key=lambda b: (-rooms[b], b))
        if not todo:
            break
        for giver in todo:
            if giver not in takers.options:
                continue  # filled up meanwhile
            takers.remove(giver)
            moved = False
            while bins[giver] and (taker := takers.best(giver)) is not None:
                takers.remove(taker)
                out, back, rise = _best_step(bins[giver], bins[taker], lengths, capacity - rooms[giver], capacity - rooms[taker], rooms[taker])
                bins[giver] = [i for i in bins[giver] if i not in out] + back
                bins[taker] = [i for i in bins[taker] if i not in back] + out
                rooms[giver] += rise
                rooms[taker] -= rise
                takers.add(taker)
                moved = True
            takers.add(giver)
            if moved:
                idle.clear()
            idle.add(giver)
            used -= not bins[giver]
            if used <= least:
                break
    return bins


class _Takers:
    """Underfull bins by what they can give back and their room.

    Back is nothing or one document (table 0), or two (table 1).  first[table][s, q] is the least
    room, s - q or more, of the bins that can give back the length q: the tightest bin that takes
    s for q.  Two tables of (capacity + 1)**2 numbers.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        import numpy as np

        self.np, self.bins, self.lengths, self.capacity = np, bins, lengths, capacity
        self.rooms = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.none, self.width = 4 * capacity, capacity + 1
        self.first = [np.full((self.width, self.width), self.none, np.int16 if self.none < 2**15 else np.int32) for _ in range(2)]
        self.flat = [x.reshape(-1) for x in self.first]
        self.gain = np.arange(self.width, dtype=np.int32 if self.none < 2**15 else np.int64)
        self.options: dict[int, tuple[array, array]] = {}
        self.held: tuple[dict, dict] = ({}, {})  # q and room as one number: the bin, or a set of several
        for b in range(len(bins)):
            self.add(b)

    def sums(self, b: int) -> tuple[list[int], list[int]]:
        """Lengths of one document of the bin, and of two."""
        one, two = _by_length(self.bins[b], self.lengths)
        return list(one), list(two)

    def column(self, table: int, q: int, room: int):
        """first[table][q + d, q] for d = 0 to room (as far as the table goes)."""
        at = q * self.width + q
        return self.flat[table][at : at + room * self.width + 1 : self.width]

    def add(self, b: int) -> None:
        room = self.rooms[b]
        if not self.bins[b] or not room:
            return
        one, two = self.sums(b)
        self.options[b] = array("i", one), array("i", two)
        for table, backs in enumerate(([0, *one], two)):
            held = self.held[table]
            for q in backs:
                key = q * self.width + room
                holder = held.get(key)
                if holder is None:
                    column = self.column(table, q, room)
                    self.np.minimum(column, room, out=column)
                    held[key] = b
                elif isinstance(holder, int):
                    held[key] = {holder, b}
                else:
                    holder.add(b)

    def remove(self, b: int) -> None:
        room = self.rooms[b]
        one, two = self.options.pop(b)
        for table, backs in enumerate(([0, *one], two)):
            held = self.held[table]
            for q in backs:
                key = q * self.width + room
                holder = held[key]
                if isinstance(holder, int):
                    del held[key]
                    column = self.column(table, q, room + 1)
                    after = column[room + 1] if room + 1 < len(column) else self.none
                    column = column[: room + 1]
                    column[column.searchsorted(room) :] = after
                else:
                    holder.discard(b)
                    if len(holder) == 1:
                        held[key] = next(iter(holder))

    def best(self, giver: int) -> int | None:
        """The bin that takes part in the giver's step with the largest rise; None if there is none.

        With s going and q coming back, d = s - q, the sum of squares rises by
        2 * d * (giver's room - taker's room + d)."""
        np, room = self.np, self.rooms[giver]
        one, two = self.sums(giver)
        found, most = None, 0
        for table, outs in ((0, one + two), (1, one)):
            if not outs:
                continue
            s = np.asarray(outs)
            upto = int(s.max())
            d = s[:, None].astype(self.gain.dtype) - self.gain[:upto]
            least = self.first[table][s, :upto].astype(self.gain.dtype)
            rise = np.where(d > 0, d * (room + d - least), 0)
            if table == 0:
                rise[len(one) :, 0] = 0  # two for nothing is no step
            k = int(rise.argmax())
            if rise.flat[k] > most:
                most, q = int(rise.flat[k]), k % upto
                found = table, q, int(least.flat[k])
        if found is None:
            return None
        table, q, room = found
        holder = self.held[table][q * self.width + room]
        return holder if isinstance(holder, int) else min(holder)


def _best_step(giver: list[int], taker: list[int], lengths: list[int], low: int, high: int, room: int):
    """(documents that leave the giver, that come back, by how much the taker grows) of the step
    with the largest growth within the room; None if no step raises the sum of squares.

    With growth d the sum of squares changes by 2 * d * (high - low + d).
    """
    best, least = None, max(0, low - high)  # a growth d counts only if d > low - high

    def offer(out: list[int], back: list[int], d: int) -> None:
        nonlocal best, least
        if least < d <= room:
            best, least = (out, back, d), d

    one, two = _by_length(giver, lengths)
    one_back, two_back = _by_length(taker, lengths)
    for outs, backs in ((one, {0: []}), (one, one_back), (two, one_back), (one, two_back)):
        if least < room:
            for s, out in outs.items():
                for q, back in backs.items():
                    offer(out, back, s - q)
    return best


def _by_length(docs: list[int], lengths: list[int]) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """One document of each length among docs, and two of each sum of lengths."""
    one: dict[int, list[int]] = {}
    two: dict[int, list[int]] = {}
    for i in docs:
        if lengths[i] in one:
            two.setdefault(2 * lengths[i], [one[lengths[i]][0], i])
        else:
            for x, (k,) in one.items():
                two.setdefault(x + lengths[i], [k, i])
            one[lengths[i]] = [i]
    return one, two


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, group_rows: int = 32_768, with_ids: bool = False, **columns) -> DataFrame:
    """One row a piece with its sequence and its place there; pieces are written once to the shared
    folder, so that texts are encoded once.  An empty table gives no rows."""
    cut = pieces(docs, tokenizer_path, end_id, capacity, with_ids=with_ids, **columns)
    return pack(common.materialise(cut, "pieces"), capacity, group_rows)
