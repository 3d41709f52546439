import base64
import gzip
import hashlib

import pytest

from ragloom.llm import common, warc

PAGES = [
    (5, "http://www.a.b/x", "hi"), (3, "http://a.b/x#f", "hi"), (3, "http://a.b/x", "hi"), (4, None, None), (7, "http://z", ""), (None, "q", "hi"),
    (3, "http://a.b/x", "other"), (9, "b", "other"), (11, "http://[bad", "é" * 300_000), (12, "http://c/\n\x01", "\r\n\r\nWARC/1.1\r\n"), (13, "http://c/2", "alone"),
]


@pytest.fixture(scope="module")
def written(spark):
    pages = spark.createDataFrame([(i, u, h, "k", "d", 1) for i, u, h in PAGES], "page_id long, url string, html string, id_key string, digest string, refers_to int").repartition(4)
    folder, captures = warc.write_archives(pages)
    warc.write_index(captures, f"{folder}/index", block_lines=2)
    return folder, captures


def test_records(spark, written):
    folder, captures = written
    rows = warc.read_archives(spark, folder, warc.archives_of(captures)).collect()
    assert len(rows) == len(PAGES)
    payload = {(i, hashlib.sha1((h or "").encode()).digest()): (h or "").encode() for i, _, h in PAGES}
    first = {}
    for (i, d), raw in payload.items():
        if i is not None:
            first[d] = min(first.get(d, i), i)
    responses = 0
    for r in rows:
        d = base64.b32decode(r.payload_digest)
        raw = payload[r.page_id, d]
        assert r.payload_bytes == len(raw)
        if r.record_type == "response":
            responses += 1
            assert bytes(r.payload) == raw and r.refers_to is None and r.page_id == first[d]
        else:
            assert r.payload is None and r.refers_to == first[d]
    assert responses == len(first)


def test_index(spark, written):
    folder, captures = written
    index = warc.CaptureIndex(spark, f"{folder}/index")
    assert len(index.keys) > 3
    for _, url, _ in PAGES:
        found = index.lookup(url)
        assert len(found) == captures.where(captures.surt == warc.surt(url)).count() > 0
        for capture in found:
            headers, payload = warc.fetch(folder, capture)
            assert headers["warc-type"] == capture["record_type"]
            if capture["record_type"] == "response":
                assert warc.digest(payload) == headers["warc-payload-digest"].removeprefix("sha1:")
    assert index.lookup("http://none.example/") == []


def test_every_page_is_read_through_the_index(spark, written):
    folder, captures = written
    pages = spark.createDataFrame([(u,) for _, u, _ in PAGES] + [("http://none.example/",)], "url string")
    found = warc.CaptureIndex(spark, f"{folder}/index").lookup_all(pages)
    key = lambda r: repr(r)
    rows = sorted(warc.read_captures(folder, found, 3).collect(), key=key)
    assert rows == sorted(warc.read_archives(spark, folder, warc.archives_of(captures)).collect(), key=key)
    wrong = captures.withColumn("page_id", captures.page_id + 1).where("page_id = 14")
    with pytest.raises(Exception, match="another record"):
        warc.read_captures(folder, wrong, 3).collect()


def test_query_opens_the_index(spark, tmp_path, monkeypatch):
    """Without the index's lines of a page the query has no row of it."""
    from ragloom.llm import queries

    spark.createDataFrame([(i, f"http://h{i}/", f"page {i}") for i in range(6)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op4_warc(spark, str(tmp_path)).count() == 6
    whole = warc.write_index
    monkeypatch.setattr(warc, "write_index", lambda captures, folder: whole(captures.where("page_id <> 3"), folder))
    assert sorted(r.page_id for r in queries.op4_warc(spark, str(tmp_path)).collect()) == [0, 1, 2, 4, 5]


def test_any_key_is_found(spark):
    urls = ["http://a/x", "http://a/x\x01", "http://a/x!", "http://[a\tb", "http://[a\nb", "http://a/\u2028\x85\x1cy", "http://a/x\x01y"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder, captures = warc.write_archives(pages)
    warc.write_index(captures, f"{folder}/index", block_lines=3)
    index = warc.CaptureIndex(spark, f"{folder}/index")
    assert all(i in [c["page_id"] for c in index.lookup(u)] for i, u in enumerate(urls))
    assert sorted(r.page_id for r in warc.read_captures(folder, index.lookup_all(pages), 2).collect()) == list(range(7))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    folder, captures = warc.write_archives(pages, min_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, folder, warc.archives_of(captures)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_null_ids_and_repeated_ids(spark):
    """Of equal payloads one is the response, also if no page_id tells them apart; as the SQL has it."""
    import duckdb

    rows = [(None, "b", "x"), (None, "a", "x"), (None, None, "x"), (None, "c", "y"), (4, "d", "y"), (4, "e", "y"), (9, "f", "y"), (None, "g", "alone"), (None, "h", None), (None, "i", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, captures = warc.write_archives(pages)
    found = warc.read_archives(spark, folder, warc.archives_of(captures)).collect()
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    told = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.oracle()})").fetchall()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == sorted(told, key=repr)
    assert sorted((r.url, r.record_type, r.refers_to) for r in found if r.payload_bytes == 1) == [("", "response", None), ("a", "revisit", None), ("b", "revisit", None), ("c", "revisit", 4), ("d", "response", None), ("e", "revisit", 4), ("f", "revisit", 4)]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, captures = warc.write_archives(pages)
    warc.write_index(captures, f"{folder}/index")
    assert warc.read_archives(spark, folder, warc.archives_of(captures)).count() == 0
    assert warc.CaptureIndex(spark, f"{folder}/index").lookup("http://a") == []


@pytest.mark.parametrize(("url", "key"), [("https://www.Example.com:80/A?b=C#d", "com,example)/a?b=c"), ("http://a.b.c", "c,b,a)/"), (None, ")/"), ("x y", ")x y")])
def test_surt(url, key):
    assert warc.surt(url) == key


def test_damage_is_an_error(spark, written):
    folder, captures = written
    raw = warc.record(1, "u", b"payload", None, False)
    path = common.local_path(common.fresh_path(spark, "damaged"))
    common.make_dirs(path)
    with open(f"{path}/000000.warc.gz", "wb") as f:
        f.write(gzip.compress(raw.replace(b"payload\r\n\r\n", b"pXyload\r\n\r\n")))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, path, [0]).collect()
    with open(f"{path}/000000.warc.gz", "wb") as f:
        f.write(gzip.compress(raw)[:-9])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, path, [0]).collect()
