import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, gone_id string, name int, copies int"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (id, text) or (id, text, source), with extra columns whose names the
    operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", 1, 2) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tokenizer_path():
    from ragloom.llm.queries import tokenizer_file

    return tokenizer_file("word_bpe_49k.json")
