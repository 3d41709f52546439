"""Language-model scores by prediction by partial matching over byte contexts.

A text is its lower-cased words, parted by one space, and an end symbol.  The trie holds, for each
context of up to ORDER symbols, how often each symbol followed it in the training documents.  A
symbol's probability is sought in the longest known context; if it never followed, the model
escapes to the next shorter one, where the symbols of the longer context are excluded, and below
the empty context to all symbols not seen there, evenly.  The escape estimate is method D: with
D symbols in T occurrences a symbol seen n times has (2n - 1) / 2T, the escape D / 2T.

The trie is two sorted tables in the shared folder, memory-mapped by the workers, or read block by
block where the store is no file system, so its size is not bounded by any one memory: nodes (context and symbol) with their counts, and contexts with T,
D and the occurrences that their symbols have in the next shorter context.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .sorted_files import SortedTable

ORDER, SYMBOL_BITS, END, PAD = 5, 9, 256, 257
#: Symbols that a text can have: bytes and the end.
ALPHABET = 257
#: A node's key: its order above LEVEL_SHIFT, its symbols below, the last one lowest.
LEVEL_SHIFT = 55
#: Words whose counts every task holds; the others' are joined.
HEAD = 200_000
_BLOCK = 3_000_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; only A-Z change, only ASCII white space parts."""
    return text.encode().lower().split() if text else []


def _codes(np, texts: list[bytes]):
    """(codes, starts): for each symbol of each text its code of ORDER + 1 symbols, and where
    each text begins."""
    lead = np.full(ORDER, PAD, np.uint16)
    end = np.asarray([END], np.uint16)
    flat = np.concatenate([x for t in texts for x in (lead, np.frombuffer(t, np.uint8).astype(np.uint16), end)])
    code = np.zeros(len(flat) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        code |= flat[ORDER - j : len(flat) - j].astype(np.uint64) << np.uint64(SYMBOL_BITS * j)
    code = code[flat[ORDER:] != PAD].view(np.int64)
    sizes = np.asarray([len(t) + 1 for t in texts])
    return code, np.cumsum(sizes) - sizes


def _blocks(np, texts):
    """Texts in lists of about _BLOCK symbols."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) + 1
        if n >= _BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def _node(np, code, order: int):
    return (code & np.int64((1 << SYMBOL_BITS * (order + 1)) - 1)) | np.int64(order << LEVEL_SHIFT)


@dataclass(frozen=True)
class Model:
    nodes: SortedTable
    contexts: SortedTable

    def opened(self):
        return _opened(self)


_models: dict[str, object] = {}


def _opened(model: Model):
    """One in each worker process."""
    key = model.nodes.folder
    if key not in _models:
        _models.clear()
        _models[key] = _Trie(model)
    return _models[key]


def train(texts: DataFrame) -> Model:
    """The trie of a column `text`: each task counts its symbols' codes and sends partial counts
    of all orders; they are added up and joined by key."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        def merged(parts):
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([p[1] for p in parts])[order]
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[cuts], np.add.reduceat(n, cuts)

        def out(code, n):
            for order in range(ORDER, -1, -1):
                keys, n = merged([(_node(np, code, order), n)])
                code = keys & np.int64((1 << LEVEL_SHIFT) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        held = []
        texts = (b" ".join(tokens(t)) for t in common.each_text(batches))
        for block in _blocks(np, texts):
            held.append(np.unique(_codes(np, block)[0], return_counts=True))
            if sum(len(h[0]) for h in held) > 3_000_000:
                held = [merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield from out(*held.pop())
        if held:
            yield from out(*merged(held))

    counted = texts.select("text").mapInArrow(common.tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    nodes = common.materialise(counted, "nodes")
    level, code = F.shiftright("key", LEVEL_SHIFT), F.col("key").bitwiseAND(F.lit((1 << LEVEL_SHIFT) - 1))
    shorter = F.expr(f"key & ((1L << cast({SYMBOL_BITS} * (key >> {LEVEL_SHIFT}) as int)) - 1L) | (((key >> {LEVEL_SHIFT}) - 1L) << {LEVEL_SHIFT})")
    context = F.shiftleft(level, LEVEL_SHIFT).bitwiseOR(F.shiftright(code, SYMBOL_BITS))
    lower = nodes.select(F.col("key").alias("low_key"), F.col("n").alias("low_n"))
    upper = nodes.withColumn("low_key", F.when(level > 0, shorter))
    contexts = upper.join(lower, "low_key", "left").groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("symbols"), F.coalesce(F.sum("low_n"), F.lit(0)).alias("covered"))
    folder = common.fresh_path(texts.sparkSession, "trie")
    return Model(SortedTable.write(nodes.select("key", "n"), folder, "nodes"), SortedTable.write(contexts, folder, "contexts"))


class _Trie:
    """Log probabilities of codes, with a direct-mapped table of those worked out before."""

    SLOTS = 1 << 21

    def __init__(self, model: Model):
        import numpy as np

        self.np, self.nodes, self.contexts = np, model.nodes.opened(), model.contexts.opened()
        self.known, self.logs = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS)

    def work_out(self, code):
        """log10 probability of each code's last symbol after its others."""
        np = self.np
        out, todo = np.zeros(len(code)), np.arange(len(code))
        covered = symbols = np.zeros(len(code), np.int64)  # of the longer context: excluded below
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            c = code[todo]
            key = _node(np, c, order)
            n = self.nodes.find(key)[0]
            context = (np.int64(order) << np.int64(LEVEL_SHIFT)) | ((key & np.int64((1 << LEVEL_SHIFT) - 1)) >> np.int64(SYMBOL_BITS))
            total, kinds, below = self.contexts.find(context)
            left, new = total - covered, kinds - symbols  # occurrences and symbols not excluded
            open_ = left > 0
            hit = open_ & (n > 0)
            out[todo[hit]] += np.log10((2 * n[hit] - 1) / (2 * left[hit]))
            escape = open_ & ~hit
            out[todo[escape]] += np.log10(new[escape] / (2 * left[escape]))
            stay = ~hit
            known = total[stay] > 0
            # An unknown context has excluded nothing; a known one excludes all of its symbols below.
            covered, symbols = np.where(known, below[stay], 0), np.where(known, kinds[stay], 0)
            todo = todo[stay]
        if len(todo):
            out[todo] += -np.log10(np.maximum(ALPHABET - symbols, 1))
        return out

    def logs_of(self, code):
        """The same for many codes with repeats."""
        np = self.np
        distinct = np.unique(code)
        slot = self._slot(distinct, self.SLOTS)
        found, logs = self.known[slot] == distinct, self.logs[slot]
        logs[~found] = self.work_out(distinct[~found])
        self.known[slot], self.logs[slot] = distinct, logs  # of two in one slot the last has both
        size = 1 << (8 * len(distinct)).bit_length()
        place = np.zeros(size, np.int32)
        place[self._slot(distinct, size)] = np.arange(len(distinct), dtype=np.int32)
        at = place[self._slot(code, size)]
        wrong = np.flatnonzero(distinct[at] != code)
        at[wrong] = np.searchsorted(distinct, code[wrong])
        return logs[at]

    def _slot(self, code, size: int):
        np = self.np
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)

    def scores(self, texts: list[bytes]):
        """log10 probability of each text, with its end."""
        np = self.np
        out = []
        for block in _blocks(np, texts):
            code, starts = _codes(np, block)
            out.append(np.add.reduceat(self.logs_of(code), starts))
        return np.concatenate(out) if out else np.zeros(0)


# --- word counts and the base score ---------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n of a column `text`; the end counts as the word of one line feed."""

    def count(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for text in common.each_text(batches):
            seen.update(tokens(text))
            seen[b"\n"] += 1
            if len(seen) > 500_000:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    return texts.select("text").mapInArrow(common.tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


SCORED_SCHEMA = "row long, doc_id long, n_tokens long, known long, logs double, score double, tail array<struct<word: binary, times: long>>"


def score_documents(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    is_training is a condition on doc_id; a null result is false.  base_score is that of single
    words with one added to each count, over all training words; the counts of the HEAD commonest
    words go to every task, those of a document's other words are joined by word, so no task holds
    the vocabulary.  A null text is empty: it has its end only.  Rows with equal ids are each one.
    Without training documents all symbols are equally likely.
    """
    import math

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(F.coalesce(is_training, F.lit(False)))
    model = train(training)
    counts = common.materialise(word_counts(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.col("n").desc(), "word").limit(HEAD).toArrow()
    by_word = dict(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True))

    def score(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        trie, row = model.opened(), TaskContext.get().partitionId() << 33
        logs = {w: math.log10(n + 1) for w, n in by_word.items()}
        names = [x.split()[0] for x in SCORED_SCHEMA.split(", ")][:6]
        pair = pa.struct([("word", pa.binary()), ("times", pa.int64())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1500):
                part = batch.slice(lo, 1500)
                texts, sizes, known, sums, cuts, words_out, times_out = [], [], [], [], [0], [], []
                for text in part.column(1).to_pylist():
                    words = tokens(text)
                    texts.append(b" ".join(words))
                    words.append(b"\n")
                    sizes.append(len(words))
                    got = [x for x in map(logs.get, words) if x is not None]
                    known.append(len(got)), sums.append(math.fsum(got))
                    rest = Counter([w for w in words if w not in logs]) if len(got) < len(words) else {}
                    words_out += rest.keys()
                    times_out += rest.values()
                    cuts.append(len(words_out))
                tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(words_out, pa.binary()), pa.array(times_out, pa.int64())], fields=list(pair)))
                columns = [pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(trie.scores(texts)), tail]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, [*names, "tail"])

    scored = common.materialise(rows.mapInArrow(common.tidy(score), SCORED_SCHEMA), "scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times").join(counts, "word")
    tail = tail.groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_logs"))
    out = scored.drop("tail").join(tail, "row", "left")
    base = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return out.select(
        "doc_id", (~F.coalesce(is_training, F.lit(False))).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
