"""Toxicity by a factorization machine over hashed terms.

A document's terms are the words that occur in it and their beginnings of four and five letters,
hashed.  Each hash has a weight and a vector; a document's score is the logistic function of bias,
weights, and products of the vectors of all pairs of its terms, so a pair such as an insult with a
group's name counts by itself.

Training rows are few and terms many, so training moves a term by its evidence: how surely its rate
differs between the classes, or how often it occurs, as a term that tells nothing by itself can
only be trusted in pairs if it was seen often.  No term is left out but those seen fewer than
LEAST times, of which nothing can be learnt.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import common, labelled

BITS = 18
#: Training rows with a term, at least; the z at which its evidence is one half.
LEAST, HALF = 3, 6.0
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡¿«»„“”’‘…–—"


def terms(run: str) -> tuple[int, ...]:
    """Hashes of the terms of one space-free run of text."""
    word = run.lower().strip(_EDGES)
    if not word:
        return ()
    mask = (1 << BITS) - 1
    names = ["w " + word] + [f"b {word[:n]}" for n in (4, 5) if len(word) >= n]
    return tuple(zlib.crc32(n.encode()) & mask for n in names)


class _Terms(dict):
    """Terms of a run, or the places of those that `known` has if it is given; bounded."""

    def __init__(self, known: dict[int, int] | None = None, limit: int = 250_000):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, run: str) -> tuple[int, ...]:
        found = terms(run)
        if self.known is not None:
            found = tuple(self.known[t] for t in found if t in self.known)
        if len(run) <= 64:
            if len(self) > self.limit:
                self.clear()
            self[run] = found
        return found

    def document(self, np, text: str | None):
        """The sorted terms of a text, each once."""
        found = set().union(*map(self.__getitem__, set(text.split()))) if text else ()
        out = np.fromiter(found, np.int64, len(found))
        out.sort()
        return out


@dataclass(frozen=True)
class Model:
    """Bias, and of each learnt term its hash, weight, and vector (n, k)."""

    bias: float
    hashes: object
    weights: object
    vectors: object

    def scorer(self):
        import numpy as np

        table = _Terms({t: i for i, t in enumerate(self.hashes.tolist())})

        def score(texts):
            logits = np.full(len(texts), self.bias)
            for i, text in enumerate(texts):
                at = table.document(np, text)
                if len(at):
                    v = self.vectors[at].astype(np.float64)
                    logits[i] += self.weights[at].sum(dtype=np.float64) + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
            return 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))

        return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, max_terms: int = 12_000_000, factors: int = 8, seed: int = 11) -> Model:
    """Fit on at most max_rows labelled rows (a bounded sample, the one thing here that is), fewer
    if their terms are more than max_terms: both bound what comes to the driver.  All terms of these
    rows are trained.  With one class only, or no labelled row, the model has a bias only."""
    import numpy as np
    from pyspark.sql import functions as F

    def features():
        import pyarrow as pa

        table = _Terms()
        return lambda texts: pa.array([table.document(np, t) for t in texts], pa.list_(pa.int32()))

    rows = labelled.training_features(docs, labels, label, max_rows, features, "array<int>").withColumn("place", F.xxhash64("doc_id"))
    sizes = rows.select("place", F.size("x").alias("n")).toArrow().sort_by("place")
    fits = np.cumsum(sizes["n"].to_numpy().astype(np.int64)) <= max_terms
    if not fits.all():
        rows = rows.where(F.col("place") < F.lit(int(sizes["place"][int(fits.argmin())].as_py())))
    data = rows.select("doc_id", "label", "x").toArrow()
    y, order = (data["label"].to_numpy() > 0).astype(np.float32), np.argsort(data["doc_id"].to_numpy(), kind="stable")
    if not 0 < y.sum() < len(y):
        return Model(float(np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    x = data["x"]
    del data
    scale = evidence(np, x, y)
    known = np.flatnonzero(scale).astype(np.int32)
    at, n = _places(np, x, scale)
    del x
    bias, weights, vectors = _train(np, at, n, y[order], scale[known], factors, seed, order)
    del at, n
    common.trim()
    return Model(bias, known, weights, vectors)


def _slices(x, rows: int = 1000):
    """(first row, lengths, terms) of a chunked column of lists, a few rows at a time."""
    first = 0
    for chunk in x.chunks:
        for lo in range(0, len(chunk), rows):
            part = chunk.slice(lo, rows)
            yield first + lo, part.value_lengths().to_numpy(zero_copy_only=False), part.flatten().to_numpy()
        first += len(chunk)


def evidence(np, x, y):
    """For each term 0 to 1: z**4 / (z**4 + HALF**4), z from the difference of its two rates, or the
    share of the rows that have it if that is more; 0 below LEAST rows."""
    size = 1 << BITS
    seen, pos = np.zeros(size, np.int64), np.zeros(size)
    for first, n, at in _slices(x):
        seen += np.bincount(at, minlength=size)
        pos += np.bincount(at, np.repeat(y[first : first + len(n)], n), size)
    yes, no = y.sum(), len(y) - y.sum()
    share = seen / len(y)
    z4 = (np.abs(pos / yes - (seen - pos) / no) ** 2 / np.maximum(share * (1 - share) * (1 / yes + 1 / no), 1e-12)) ** 2
    return np.where(seen >= LEAST, np.maximum(z4 / (z4 + HALF**4), share), 0).astype(np.float32)


def _places(np, x, scale):
    """(places among the terms of some evidence, one row after the other; how many each row has)."""
    place = np.where(scale > 0, np.cumsum(scale > 0) - 1, -1).astype(np.int32)
    lengths, end = [], 0
    out = np.empty(sum(len(at) for _, _, at in _slices(x)), np.int32)
    for _, n, at in _slices(x):
        found = place[at]
        used = found >= 0
        lengths.append(np.bincount(np.repeat(np.arange(len(n)), n)[used], minlength=len(n)))
        kept = found[used]
        out[end : end + len(kept)] = kept
        end += len(kept)
    return out[:end], np.concatenate(lengths)


def _train(np, at, n, y, scale, k: int, seed: int, order=None, epochs: int = 12, rate: float = 0.07, spread: float = 0.05):
    """(bias, weights, vectors) by adaptive gradient steps on the logistic loss, over sparse batches.

    at: the terms of all rows, as numbers below len(scale); n: how many each row has; y: labels in
    the order of the rows that `order` gives, so that how rows came does not matter."""
    rng = np.random.default_rng(seed)
    starts = np.cumsum(n) - n
    if order is not None:
        starts, n = starts[order], n[order]
    w, v = np.zeros(len(scale), np.float32), rng.normal(0, spread, (len(scale), k)).astype(np.float32)
    seen_w, seen_v = np.zeros_like(w), np.zeros_like(v)
    bias, seen_bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0
    slot = np.zeros(len(scale), np.int32)
    batch = min(256, max(16, len(y) // 64))
    for epoch in range(epochs):
        step = rate * 0.5 ** (epoch / 4)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            m = n[part]
            ends = np.cumsum(m)
            here = at[np.repeat(starts[part] - (ends - m), m) + np.arange(ends[-1])]
            r = np.repeat(np.arange(len(part)), m)
            marked = np.zeros(len(scale), bool)
            marked[here] = True
            cols = np.flatnonzero(marked)
            slot[cols] = np.arange(len(cols), dtype=np.int32)
            of = slot[here]
            e = scale[cols]
            vectors = v[cols] * e[:, None]
            full = m > 0
            s, squares, linear = np.zeros((len(part), k), np.float32), np.zeros(len(part)), np.zeros(len(part))
            if full.any():
                cuts = (ends - m)[full]
                s[full] = np.add.reduceat(vectors[of], cuts)
                squares[full] = np.add.reduceat((vectors * vectors).sum(1)[of], cuts)
                linear[full] = np.add.reduceat((w[cols] * e)[of], cuts)
            logit = bias + linear + 0.5 * ((s * s).sum(1) - squares)
            g = ((1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y[part]) / len(part)).astype(np.float32)
            each = g[r]
            total = np.bincount(of, each, len(cols))
            pairs = np.stack([np.bincount(of, each * s[r, f], len(cols)) for f in range(k)], axis=1)
            for x, seen, d in ((w, seen_w, total * e), (v, seen_v, (pairs - vectors * total[:, None]) * e[:, None])):
                seen[cols] += d * d
                x[cols] -= step * d / np.sqrt(seen[cols] + 1e-9)
            seen_bias += float(g.sum()) ** 2
            bias -= step * float(g.sum()) / (seen_bias + 1e-9) ** 0.5
    return bias, w * scale, v * scale[:, None]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row; a null or empty text has the bias's score."""
    return labelled.score_texts(docs, model.scorer)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns, decided row by row."""
    return labelled.keep(docs, fit(docs, labels, **options).scorer, lambda s: s < threshold)
