import random
import zlib

import numpy as np
import pytest

from ragloom.llm import encoding, labelled, quality, toxicity

FILLER = [f"{a}{b}" for a in ("lo", "mi", "sa", "te", "ru", "ka") for b in ("na", "ven", "dor", "lis", "pem", "gat")]


def corpus(n, seed=1):
    """Odd ids: in one text of two an insult (toxic); by threes: shouting junk (quality 0)."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(20, 80))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if not good:
            words = [f"{w}%%%" if k % 2 else f"{w}!!" for k, w in enumerate(words)]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit", "blockheadish"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def data(documents, labels):
    rows, marks = corpus(900)
    return documents(rows), labels(marks + [(5, None, None), (None, 1, 1), (10_000, 1, 0)]), {m[0]: m for m in marks}


def held_out_accuracy(scored, truth, at):
    rows = [r for r in scored if r.held_out]
    assert len(rows) > 100
    return np.mean([r.predicted == truth[r.doc_id][at] for r in rows])


def test_quality(data):
    docs, labels, truth = data
    scored = labelled.report(quality.score(docs, quality.fit(docs, labels)), 0.3).collect()
    assert len(scored) == 900 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert held_out_accuracy(scored, truth, 1) > 0.95


def test_toxicity(data):
    docs, labels, truth = data
    scored = labelled.report(toxicity.score(docs, toxicity.fit(docs, labels)), 0.5).collect()
    assert len(scored) == 900 and all(0 <= r.score <= 1 for r in scored)
    assert held_out_accuracy(scored, truth, 2) > 0.97


def test_held_out_labels_are_not_learnt(data, labels, documents):
    """Wrong labels in the held-out fold change no score."""
    docs, given, truth = data
    wrong = labels([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in truth.values()])
    right = labels(list(truth.values()))
    for module in (quality, toxicity):
        a, b = (sorted((r.doc_id, r.score) for r in module.score(docs, module.fit(docs, x)).collect()) for x in (right, wrong))
        assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("marks", [[], [(1, 1, 1), (2, 1, 1)], [(1, None, None)]])
def test_without_both_classes_one_score(module, marks, documents, labels):
    docs = documents([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x" * 200_000), (4, "w " * 100_000)])
    scored = module.score(docs, module.fit(docs, labels(marks))).collect()
    assert len(scored) == 6
    assert len({round(r.score, 9) for r in scored}) == 1 and 0 <= scored[0].score <= 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_table(module, documents, labels):
    docs = documents([(1, "a")]).limit(0)
    assert module.score(docs, module.fit(docs, labels([(1, 1, 1)]))).count() == 0


def test_keep(data):
    docs, labels, truth = data
    good, clean = quality.keep_good(docs, labels), toxicity.keep_clean(docs, labels)
    assert good.columns == clean.columns == docs.columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert sum(truth[i][2] == 0 for i in kept) == sum(t == 0 for *_, t in truth.values())
    assert sum(truth[i][2] for i in kept) < 0.1 * sum(t for *_, t in truth.values())
    assert 0.9 < good.count() / sum(q for _, q, _ in truth.values()) < 1.1


@pytest.mark.parametrize("cut", [1 << 18, 3])
def test_context_vectors_are_sums_inside_texts(documents, monkeypatch, cut):
    monkeypatch.setattr(quality, "CUT", cut)
    texts = ["a b c", "b c", None, "", "c a b a", "d", "a b c d e f g h i a b c"]
    index, table = quality.index_vectors(np), quality._Buckets()
    expected, seen = np.zeros((1 << quality.BITS, quality.DIM)), np.zeros(1 << quality.BITS)
    for text in texts:
        ids = table.of(np, text)
        for i in range(len(ids)):
            seen[ids[i]] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    expected[ids[i]] += index[ids[j]]
    for parts in (1, 3):
        sums, counts = quality.context_vectors(documents(list(enumerate(texts))).repartition(parts))
        assert np.array_equal(sums, expected) and np.array_equal(counts, seen)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_the_dealing(spark, small, module):
    """To the last bit."""
    docs, marks = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    found = []
    for parts in (1, 3, 7):
        dealt = docs.repartition(parts)
        found.append(sorted(tuple(r) for r in module.score(dealt, module.fit(dealt, marks.repartition(parts))).collect()))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_rows_are_kept_one_by_one(module, documents, labels):
    """Null and repeated ids: each row by its own text."""
    rows, marks = corpus(400)
    odd = [(None, rows[1][1]), (None, rows[2][1]), (7000, rows[3][1]), (7000, rows[4][1]), (7000, None), (7000, rows[3][1])]
    docs, given = documents(rows + odd), labels(marks)
    model = module.fit(docs, given)
    keep, good = (module.keep_good, lambda s: s >= 0.3) if module is quality else (module.keep_clean, lambda s: s < 0.5)
    scores = dict(zip([r[1] for r in rows + odd], model.scorer()([r[1] for r in rows + odd]), strict=True))
    expected = sorted(repr((i, t)) for i, t in rows + odd if good(scores[t]))
    kept = keep(docs, given)
    assert kept.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == expected


def test_training_rows_are_bounded(documents, labels):
    """One id many times with different texts, and more labels than rows wanted."""
    docs = documents([(1, f"text {k}") for k in range(300)] + [(i, "other") for i in range(2, 60)])
    marks = labels([(i, 1, 0) for i in range(1, 60)])
    import pyarrow as pa

    found = [labelled.training_features(docs.repartition(p), marks, "quality", n, lambda: lambda texts: pa.array(texts, pa.string()), "string").collect() for p in (1, 4) for n in (1, 20, 1000)]
    assert [len(f) for f in found] == [1, 20, len(found[2])] * 2 and 20 < len(found[2]) < 60
    assert sorted(found[0]) == sorted(found[3]) and sorted(found[2]) == sorted(found[5])


NOISE = [f"noise{k * 7919 % 6007}x{k}" for k in range(6000)]


@pytest.mark.parametrize("vocabulary", [FILLER, NOISE])
def test_factorization_machine_learns_pairs(documents, labels, vocabulary):
    """Two words that are harmless alone and toxic together, which weights alone can't tell."""
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["alpha"] * a + ["omega"] * b + [rng.choice(vocabulary) for _ in range(5)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(a == b)))
    docs = documents(rows)
    model = toxicity.fit(docs, labels(marks))
    truth = {m[0]: m for m in marks}
    assert held_out_accuracy(labelled.report(toxicity.score(docs, model), 0.5).collect(), truth, 2) > 0.9


def test_factorization_machine_by_pairs(data):
    """The score is bias, weights and products of all pairs' vectors, summed in a plain loop."""
    docs, given, _ = data
    model = toxicity.fit(docs, given)
    texts = [r.text for r in docs.limit(30).collect()] + ["", None, "unseen words only"]
    for text, s in zip(texts, model.scorer()(texts), strict=True):
        place = {t: k for k, t in enumerate(model.hashes.tolist())}
        at = sorted({place[t] for run in (text or "").split() for t in toxicity.terms(run) if t in place})
        logit = model.bias + sum(float(model.weights[i]) for i in at)
        logit += sum(float(model.vectors[i].astype(float) @ model.vectors[j].astype(float)) for k, i in enumerate(at) for j in at[:k])
        assert s == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_training_lowers_the_loss():
    """By a plain loss of every row, one without terms among them."""
    at, n, y = np.asarray([0, 1, 1, 2, 0, 2, 0, 1, 2, 1, 0, 2]), np.asarray([2, 2, 2, 3, 0, 1, 2]), np.asarray([1, 0, 1, 0, 1, 0, 1], np.float32)
    bias, w, v = toxicity._train(np, at, n, y, np.ones(3, np.float32), 2, 1, epochs=40, rate=0.2)
    start = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def loss(bias, w, v):
        out, k = 0.0, 0
        for size, label in zip(n, y, strict=True):
            mine = at[k : k + size]
            k += size
            s = v[mine].sum(0)
            z = bias + w[mine].sum() + 0.5 * ((s * s).sum() - (v[mine] ** 2).sum())
            out += np.logaddexp(0, z) - label * z
        return out

    assert loss(bias, w, v) < 0.9 * loss(start, np.zeros_like(w), np.zeros_like(v))


def test_evidence():
    """By a plain count of rows with and without each term."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 9))).tolist() for _ in range(200)]
    y = np.asarray([float(1 in r or rng.random() < 0.2) for r in rows], np.float32)
    x = pa.chunked_array([pa.array(rows[:70], pa.list_(pa.int32())), pa.array(rows[70:], pa.list_(pa.int32()))])
    scale = toxicity.evidence(np, x, y)
    for t in range(30):
        has = np.asarray([t in r for r in rows])
        p, q, share = (has & (y > 0)).sum() / y.sum(), (has & (y == 0)).sum() / (1 - y).sum(), has.mean()
        z4 = ((p - q) ** 2 / (share * (1 - share) * (1 / y.sum() + 1 / (1 - y).sum()))) ** 2
        assert scale[t] == pytest.approx(max(z4 / (z4 + 6.0**4), share) if has.sum() >= 3 else 0, rel=1e-5)
    assert not scale[30:].any()
    at, n = toxicity._places(np, x, scale)
    known = np.flatnonzero(scale)
    assert [known[p].tolist() for p in np.split(at, np.cumsum(n)[:-1])] == [[t for t in r if scale[t]] for r in rows]


def test_many_terms_bound_the_rows(data):
    docs, given, truth = data
    model = toxicity.fit(docs, given, max_terms=20_000)
    whole = toxicity.fit(docs, given)
    assert np.count_nonzero(model.weights) > 0 and not np.array_equal(model.weights, whole.weights)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert quality._temperature(np, logits * 3, y) == pytest.approx(3, rel=0.1)


def test_workers_drop_idle_encoders(tokenizer_path):
    """Workers live on after packing: a filter's tasks there must not hold its tables beside their own."""
    from types import SimpleNamespace

    import pyarrow as pa

    encoding.encoder(tokenizer_path).encode_all(["some words"])
    docs = SimpleNamespace(columns=["text"], schema=None, mapInArrow=lambda run, schema: run)
    run = labelled.keep(docs, lambda: lambda texts: [len(t) / 10 for t in texts], lambda s: s >= 0.5)
    batch = pa.RecordBatch.from_arrays([pa.array(["long enough", "no"])], ["text"])
    assert [r.to_pydict() for r in run([batch])] == [{"text": ["long enough"]}]
    assert not encoding._encoders
