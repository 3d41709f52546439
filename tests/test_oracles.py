"""Every query with SQL gives the same rows, names and values as DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ragloom import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, small, name):
    found = catalogue.QUERIES[name](spark, small).toPandas()
    assert rows(found) == rows(con.execute(catalogue.ORACLES[name]).df())


def test_relevance_of_short_items(spark, tmp_path):
    """Items of few words, whose first and last may be parts of longer ones."""
    items = ["", "w", "two", "one two", "ne two thre", "one two three", "ne two three fou", "one two three four fiv", "e  two", "absent", None]
    texts = ["one two three four five", "none two three fourth", "one\ttwo three", "one  two", "two", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found, told = catalogue.QUERIES["retrieval_relevance"](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLES["retrieval_relevance"]).df()
    assert len(told) > 20 and rows(found) == rows(told)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no fixture tables")
    assert entry.entry(spark).count() == 40


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["context_for_items", "edge_merge", "accuracy_by_type", "components"])
def test_partitions_change_nothing(spark, small, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append(rows(catalogue.QUERIES[name](spark, small).toPandas()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
