import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import ppm
from ragloom.llm.common import crc_mod


class Plain:
    """The same model, symbol by symbol from dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            s = self.symbols(t)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    @staticmethod
    def symbols(text):
        return (ppm.PAD,) * ppm.ORDER + tuple(b" ".join(ppm.tokens(text))) + (ppm.END,)

    def log(self, context, symbol):
        excluded, out = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            here = self.seen.get(context[ppm.ORDER - k :])
            left = {s: n for s, n in (here or {}).items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * total))
            out += math.log10(len(left) / (2 * total))
            excluded |= set(here)
        return out - math.log10(ppm.ALPHABET - len(excluded))

    def score(self, text):
        s = self.symbols(text)
        return sum(self.log(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s)))


def texts(n):
    rng = random.Random(7)
    parts = ["ab", "Cé", "dou", "ß", "x,", "the"]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_against_plain(spark, documents, monkeypatch, head):
    monkeypatch.setattr(ppm, "HEAD", head)
    rows = list(enumerate(texts(120))) + [(500, None), (501, ""), (502, "unseen ZZZ öö unseen"), (502, "ab")]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model, counts = Plain(train), Counter(w for t in train for w in [*ppm.tokens(t), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    found = ppm.score_documents(documents(rows), crc_mod(F.col("doc_id"), 7) != 2).collect()
    expected = []
    for i, t in rows:
        words = [*ppm.tokens(t), b"\n"]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        expected.append((i, zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), total, base, model.score(t)))
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found)), sorted(expected), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_probabilities_sum_to_one():
    model = Plain(texts(40))
    for context in [model.symbols("ab cé")[k : k + ppm.ORDER] for k in range(6)] + [(1,) * ppm.ORDER]:
        assert sum(10 ** model.log(context, s) for s in range(ppm.ALPHABET)) == pytest.approx(1)


def test_no_training_rows(spark, documents):
    rows = ppm.score_documents(documents([(1, "ab c"), (2, None)]), F.lit(False)).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({1: -5 * math.log10(257), 2: -math.log10(257)})
    assert all(r.base_score == 0 and r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert ppm.score_documents(documents([(1, "x")]).limit(0), F.lit(True)).count() == 0


def test_long_text(spark, documents):
    long = "abc def " * 60_000
    rows = {r.doc_id: r for r in ppm.score_documents(documents([(1, long), (2, "abc")]), F.lit(True)).collect()}
    assert rows[1].n_tokens == 120_001 and rows[1].score > rows[1].base_score


@pytest.mark.parametrize("kept", [64, 2])
def test_tables_in_other_stores(spark, monkeypatch, kept):
    """Blocks read by range give what mapped shards give."""
    from ragloom.llm import common, sorted_files

    monkeypatch.setattr(sorted_files, "STEP", 50)
    monkeypatch.setattr(sorted_files, "KEPT", kept)
    frame = spark.range(0, 4000, 3).selectExpr("id * id AS key", "id AS a", "-id AS b").repartition(5)
    table = sorted_files.SortedTable.write(frame, common.fresh_path(spark, "sorted"), "t")
    keys = np.random.default_rng(1).permutation(np.r_[np.arange(0, 4000) ** 2, -5, 1 << 50, 9, 9])
    mapped = table.opened().find(keys)
    monkeypatch.setattr(common, "local_path", lambda uri: None)
    ranged = table.opened()
    assert np.array_equal(ranged.find(keys), mapped) and np.array_equal(ranged.find(keys[:7]), mapped[:, :7])
    assert np.count_nonzero(mapped[0]) == 1334 + 1  # 0 has the value 0; 9 is there three times


def test_null_ids(spark, documents):
    """Rows like any others: scored, and by the query's condition trained on."""
    rows = ppm.score_documents(documents([(None, "ab cd"), (None, "ab"), (None, None), (1, "ab")]), crc_mod(F.col("doc_id"), 7) != 2).collect()
    assert sorted((r.doc_id is None, r.n_tokens, r.held_out) for r in rows) == [(False, 2, zlib.crc32(b"1") % 7 == 2), (True, 1, False), (True, 2, False), (True, 3, False)]
    assert all(r.score < 0 and r.n_known == r.n_tokens for r in rows)
