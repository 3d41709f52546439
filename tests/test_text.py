import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import text
from ragloom.operators.chunking import chunk_documents, chunk_text, split_markdown


def values(spark, column, inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {"The cat's a-hat": "cats hat", "éa the": "éa", "a_the the_": "athe the", "AN": "", "x the y": "x y", "a an the": "", "  A  b ": "b", None: "", "Hello, World!": "hello world"}
    assert values(spark, text.normalize_answer, list(cases)) == list(cases.values())
    assert values(spark, lambda x: text.normalize_answer(x, True), ["The Cat the"]) == ["The Cat"]


def test_matches(spark):
    pairs = [("The answer", "answer!", True, True, True), ("", "", True, True, True), ("x", "", False, True, False), ("x b c d e", "b c d e f", False, False, False), ("b c d e", "b c d e f", False, False, True), ("say yes now", "yes", False, True, False)]
    frame = spark.createDataFrame(pairs, "p string, t string, e boolean, c boolean, f boolean")
    found = frame.select(text.exact_match(F.col("p"), F.col("t")), text.contains_match(F.col("p"), F.col("t")), text.fuzzy_match(F.col("p"), F.col("t")), "e", "c", "f").collect()
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in found)


def test_estimate(spark):
    inputs = ["", "a", "a b", "a b c", " \n\t", None, "a b " * 30]
    assert values(spark, text.estimate_tokens, inputs) == [int(len((x or "").split()) / 0.75) for x in inputs]


def test_strip_and_key(spark):
    assert values(spark, text.pystrip, ["\n a \t", " x ", ""]) == ["a", "x", ""]
    assert values(spark, text.node_key, [" New\tYork\n"]) == ["new\tyork"]


def test_markdown(spark):
    lines = ["x"] * 49
    assert values(spark, text.is_markdown, ["\n".join(lines + ["# h"]), "\n".join(lines + ["x", "# h"]), "  \t# h", "no", None, "```\n# c\n```"]) == [True, False, True, False, False, True]


def test_context_block(spark):
    rows = [("c", {"title": "T", "author": "A"}, "[Источник: T, Автор: A]\nc"), ("c", {"doc_title": "", "title": "T"}, "c"), ("c", {}, "c"), ("c", None, "c"), ("c", {"author": "A"}, "[Автор: A]\nc"), ("c", {"doc_title": "D", "title": "T"}, "[Источник: D]\nc")]
    frame = spark.createDataFrame(rows, "c string, m map<string,string>, e string")
    assert all(r[0] == r[1] for r in frame.select(text.context_block(F.col("c"), F.col("m")), "e").collect())


def test_url_id(spark):
    frame = spark.createDataFrame([("http://x", 3), ("", 4), (None, 5)], "u string, i int")
    assert [r[0] for r in frame.select(text.url_id(F.col("u"), F.col("i"))).collect()][1:] == ["doc_4", "doc_5"]


# --- chunks -----------------------------------------------------------------------------------------


def test_chunks_of_nothing():
    assert chunk_text("") == [("", 0, 1)]
    assert len(chunk_text("  \n ")) == 1


def test_long_sentence():
    """600 words in a row: two whole chunks of 256; the rest opens the next one."""
    words = " ".join(f"w{i}" for i in range(600)) + "."
    found = chunk_text(words + " Then this.", 256, 50)
    assert [len(c.split()) for c, *_ in found] == [256, 256, 90]
    assert found[2][0].endswith("Then this.")
    assert found[0][1] == 0 and found[1][1] == found[0][2] + 1


def test_overlap_keeps_what_fits():
    sentences = ["a b c."] * 3 + ["d e f g h i."]
    found = chunk_text(" ".join(sentences), 12, 4)
    assert [c for c, *_ in found] == ["a b c. a b c. a b c.", "a b c. d e f g h i."]
    assert [c for c, *_ in chunk_text(" ".join(sentences), 12, 0)] == ["a b c. a b c. a b c.", "d e f g h i."]


@given(st.lists(st.sampled_from(["one", "two.", "three!", "four", "five?", "\n"]), max_size=300), st.integers(3, 40), st.integers(0, 10))
@settings(max_examples=60, deadline=None)
def test_chunk_words_follow_the_text(words, size, overlap):
    whole = " ".join(words)
    found = chunk_text(whole, size, overlap)
    at, text_words = 0, whole.split()
    for chunk, *_ in found:  # each chunk is a run of words that begins no later than the last one ended
        part = chunk.split()
        assert any(text_words[k : k + len(part)] == part for k in range(at + 1))
        at = max((k + len(part) for k in range(at + 1) if text_words[k : k + len(part)] == part), default=at)
    assert at == len(text_words)


def test_without_overlap_all_words_once():
    whole = " ".join(f"w{i}{'.' if i % 7 == 0 else ''}" for i in range(500))
    assert " ".join(c for c, *_ in chunk_text(whole, 20, 0)).split() == whole.split()


def test_split_markdown():
    found = split_markdown("intro\n# A\nx\n## B\ny\n```\n# no\n```\n# C\nz")
    assert [h for _, h in found] == [{}, {"header_1": "A"}, {"header_1": "A", "header_2": "B"}, {"header_1": "C"}]
    assert "# no" in found[2][0]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("d", "One. Two.", "T", {"chunk_index": "mine"}), ("e", None, None, None), ("m", "# H\ntext", "M", {})], "doc_id string, content string, title string, metadata map<string,string>")
    found = {r.chunk_id: r for r in chunk_documents(docs, markdown=True).collect()}
    assert set(found) == {"d::chunk_0", "m::chunk_0"} | {k for k in found if k.startswith("e")}
    assert found["d::chunk_0"].metadata == {"title": "T", "chunk_index": "mine"}
    assert found["m::chunk_0"].metadata["header_1"] == "H"
    assert math.isclose(found["d::chunk_0"].end_idx, 10)


@pytest.mark.parametrize("reply", [None, "x"])
def test_sentences(spark, reply):
    assert values(spark, text.sentences, ["A. B!  C?\nD", "no end", ""]) == [["A.", "B!", "C?", "D"], ["no end"], [""]]
