"""Quality by random-indexing word vectors and a small network with calibrated probabilities.

Each hashed word has a sparse random index vector.  A word's context vector is the sum of the
index vectors of its neighbours, over all documents.  A document is the mean and the deviation of
its words' vectors, with its word count; a network of two layers, fitted in numpy, scores it, and
a temperature fitted on rows apart from the network's makes the scores probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoding, labelled

BITS, DIM, NONZERO, REACH, BLOCK = 15, 32, 4, 2, 1024
#: Words that are counted at once.
CUT = 1 << 18


class _Buckets(dict):
    """Bucket of each word; bounded."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        b = zlib.crc32(word.encode()) & ((1 << BITS) - 1)
        if len(word) <= 64:
            if len(self) > self.limit:
                self.clear()
            self[word] = b
        return b

    def of(self, np, text: str | None):
        words = text.split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def index_vectors(np, seed: int = 5):
    """(buckets, DIM) of int8: NONZERO entries of -1 or 1 each, one in each quarter."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIM), np.int8)
    wide = DIM // NONZERO
    for q in range(NONZERO):
        out[np.arange(1 << BITS), q * wide + rng.integers(0, wide, 1 << BITS)] = rng.choice(np.array([-1, 1], np.int8), 1 << BITS)
    return out


def context_vectors(docs: DataFrame, text_col: str = "text", seed: int = 5):
    """(buckets, DIM): sums of the neighbours' index vectors over all documents, and word counts.

    Each task sums whole numbers into one array of fixed size and sends its nonzero blocks; blocks
    are added up on the executors.  Neighbours are sought inside each text, whole: texts stand apart
    by REACH blanks, and a cut of a long text is made with REACH words of overlap.  So the sums are
    exact and don't depend on how rows are dealt.  What comes to the driver is one array of that
    size, whatever the input.
    """
    import numpy as np

    def sums(batches):
        import pyarrow as pa

        blank = 1 << BITS
        index, table = np.vstack([index_vectors(np, seed), np.zeros((1, DIM), np.int8)]), _Buckets()
        total = np.zeros((blank + 1, DIM + 1))
        gap = np.full(REACH, blank, np.int64)

        def add(words, counted):
            """Words in sequence, and the same with blanks for those that other cuts count."""
            vectors = index[np.concatenate(words)]
            at = np.concatenate(counted)
            near = np.zeros(vectors.shape, np.int8)
            for k in range(1, REACH + 1):
                near[k:] += vectors[:-k]
                near[:-k] += vectors[k:]
            for d in range(DIM):
                total[:, d] += np.bincount(at, near[:, d], blank + 1)
            total[:, DIM] += np.bincount(at, minlength=blank + 1)

        encoding.forget()
        words, counted, n = [], [], 0
        for text in common.each_text(batches):
            ids = table.of(np, text)
            for lo in range(0, len(ids), CUT):
                hi = min(lo + CUT, len(ids))
                first, last = max(0, lo - REACH), min(len(ids), hi + REACH)
                words += [ids[first:last], gap]
                counted += [gap[: lo - first], ids[lo:hi], gap[: last - hi], gap]
                n += hi - lo
                if n >= CUT:
                    add(words, counted)
                    words, counted, n = [], [], 0
        if n:
            add(words, counted)
        blocks = [(b, total[b * BLOCK : (b + 1) * BLOCK]) for b in range((1 << BITS) // BLOCK)]
        blocks = [(b, x.tobytes()) for b, x in blocks if x[:, DIM].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["block", "sums"])

    def merge(pieces):
        import pyarrow as pa

        total = np.zeros((BLOCK, DIM + 1))
        for raw in pieces.column("sums"):
            total += np.frombuffer(raw.as_buffer(), "<f8").reshape(BLOCK, DIM + 1)
        return pa.table({"block": pieces.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(common.tidy(sums), "block int, sums binary")
    out = np.zeros((1 << BITS, DIM + 1))
    for row in parts.groupBy("block").applyInArrow(merge, "block int, sums binary").collect():  # at most 2**BITS / BLOCK rows
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(bytes(row.sums), "<f8").reshape(BLOCK, DIM + 1)
    return out[:, :DIM], out[:, DIM]


def word_vectors(np, sums, counts):
    """Context vectors less what a word of its frequency has by chance, at unit length, float32."""
    spread = counts[:, None] * (sums.sum(0) / max(counts.sum(), 1.0))[None, :]
    v = sums - spread
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


def pooled(np, ids, vectors):
    """Mean and deviation of the words' vectors, log of the word count: 2 * DIM + 1 numbers."""
    if not len(ids):
        return np.zeros(2 * DIM + 1, np.float32)
    first, second = np.zeros(DIM), np.zeros(DIM)
    for lo in range(0, len(ids), 1 << 16):
        v = vectors[ids[lo : lo + (1 << 16)]]
        first += v.sum(0, dtype=np.float64)
        second += np.einsum("ij,ij->j", v, v, dtype=np.float64)
    mean = first / len(ids)
    return np.concatenate([mean, np.sqrt(np.maximum(second / len(ids) - mean**2, 0)), [np.log1p(len(ids)) / 10]]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Word vectors, scaling (mean, deviation), layers (w1, b1, w2, b2), temperature."""

    vectors: object
    scaling: tuple
    layers: tuple
    temperature: float

    def scorer(self):
        import numpy as np

        table = _Buckets()

        def score(texts):
            # One by one: a product of matrices may round a row by the rows beside it.
            logits = np.asarray([_logits(np, pooled(np, table.of(np, t), self.vectors), self.scaling, self.layers) for t in texts]).reshape(len(texts))
            return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -35, 35)))

        return score


def _logits(np, x, scaling, layers):
    w1, b1, w2, b2 = layers
    return np.maximum((x - scaling[0]) / scaling[1] @ w1 + b1, 0) @ w2 + b2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, hidden: int = 32, seed: int = 5) -> Model:
    """Word vectors from all documents; the network from at most max_rows labelled rows (a bounded
    sample).  One training row in five, by its id's hash, fits the temperature and nothing else.
    With one class only, or no labelled row, all documents have the same score.
    """
    import numpy as np

    vectors = word_vectors(np, *context_vectors(docs, seed=seed))

    def features():
        import pyarrow as pa

        table = _Buckets()
        return lambda texts: pa.array([pooled(np, table.of(np, t), vectors).tobytes() for t in texts], pa.binary())

    rows = labelled.training_features(docs, labels, label, max_rows, features, "binary").toArrow().sort_by("doc_id")
    y = (np.asarray(rows["label"].to_numpy()) > 0).astype(np.float64)
    n = 2 * DIM + 1
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, n).astype(np.float64)
    blank = (np.zeros(n), np.ones(n))
    if not 0 < y.sum() < len(y):
        return Model(vectors, blank, (np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1.0)
    apart = np.asarray([zlib.crc32(f"t{i}".encode()) % 5 == 0 for i in rows["doc_id"].to_pylist()])
    if not (0 < y[~apart].sum() < (~apart).sum() and apart.any()):
        apart[:] = False
    scaling = x[~apart].mean(0), x[~apart].std(0) + 1e-6
    layers = _train(np, (x[~apart] - scaling[0]) / scaling[1], y[~apart], hidden, seed)
    temperature = _temperature(np, _logits(np, x[apart], scaling, layers), y[apart]) if apart.any() else 1.0
    return Model(vectors, scaling, layers, temperature)


def _train(np, x, y, hidden: int, seed: int, epochs: int = 30, batch: int = 128, rate: float = 0.003, decay: float = 1e-4):
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.asarray(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            w1, b1, w2, b2 = params
            h = np.maximum(x[part] @ w1 + b1, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -35, 35))) - y[part]) / len(part)
            back = g[:, None] * w2 * (h > 0)
            step += 1
            for i, (m, d) in enumerate(zip(moments, [x[part].T @ back + decay * w1, back.sum(0), h.T @ g + decay * w2, g.sum()], strict=True)):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.999 * m[1] + 0.001 * d * d
                params[i] = params[i] - rate * 0.5 ** (epoch / 10) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return tuple(params)


def _temperature(np, logits, y) -> float:
    """That of a fine geometric grid with the smallest log loss."""
    grid = np.geomspace(0.25, 8, 101)
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row; null and empty texts are documents without words."""
    return labelled.score_texts(docs, model.scorer)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that score at least the threshold, with all their columns, decided row by row."""
    return labelled.keep(docs, fit(docs, labels, **options).scorer, lambda s: s >= threshold)
