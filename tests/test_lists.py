"""Folders of many files, and lists too large for one row."""

import json

import pytest
from pyspark.sql import functions as F

from ragloom import catalogue_flows as flows
from ragloom.sources import documents


def test_listing_asks_no_file_alone(spark, tmp_path, monkeypatch):
    """The driver's calls don't grow with the number of files."""
    for k in range(300):
        (tmp_path / f"{k}.json").write_text('{"text": "a"}')
    (tmp_path / "e 1.txt").write_text("")
    (tmp_path / "f.md").write_text("x")
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **b: calls.append(a) or send(*a, **b))
    found = documents.documents_from_dir(spark, str(tmp_path))
    monkeypatch.undo()
    texts = [("e 1", "", "e 1.txt"), ("f", "x", "f.md")]
    assert sorted(tuple(r)[:3] for r in found.where("title <> ''").collect()) == texts and found.count() == 302
    (tmp_path / "more").mkdir()
    for k in range(900):
        (tmp_path / "more" / f"m{k}.json").write_text('{"text": "a"}')
    first, calls[:] = len(calls), []
    monkeypatch.setattr(client, "send_command", lambda *a, **b: calls.append(a) or send(*a, **b))
    documents.documents_from_dir(spark, str(tmp_path))
    monkeypatch.undo()
    assert len(calls) < first + 100


_ITEMS = [{"id": f"i{k}", "content": c * (k % 7 + 1)} if k % 5 else c for k, c in enumerate(["a}b", "{[,", '\\"}', "\\\\", "x\\", "тек}ст,", '"]', ""] * 20)]
_LIST = json.dumps(_ITEMS)
FILES = {
    "plain": _LIST, "pretty": " \n" + json.dumps(_ITEMS, indent=2, ensure_ascii=False) + "\n", "cut": _LIST[:-1], "trailing": _LIST + " x}[1,2", "comma": _LIST[:-1] + ",]",
    "broken": _LIST.replace('"id": "i39"', '"id" "i39"'), "object": json.dumps({"id": "o", "x": _ITEMS}), "open": json.dumps({"id": "o", "x": _ITEMS})[:-1], "blank": " " * 3000,
    "one": json.dumps([{"id": "z", "content": "q}" * 3000}]), "empty": "[" + " " * 3000 + "]", "scalar": json.dumps("}" * 3000), "slash": _LIST[:-1] + ', {"a": 1} \\" ]',
}


@pytest.mark.parametrize("block", ["3000", "1000000"])
def test_large_lists(spark, tmp_path, monkeypatch, block):
    """What is cut in blocks is what one parser gives, for files that are no JSON too."""
    for name, text in FILES.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = lambda: sorted(map(tuple, documents._json_items(spark, str(tmp_path), ".json").select("stem", "n", "idx", F.to_json("v")).collect()))
    whole = rows()
    assert {r[0] for r in whole} == {"plain", "pretty", "trailing", "object", "one"}
    monkeypatch.setattr(documents, "LARGE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        assert rows() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_saved_list(spark, tmp_path):
    """A list is saved in order by several tasks; no row holds it."""
    rows = spark.range(0, 3000).repartition(7).withColumn("text", F.concat(F.lit('a,"}'), "id"))
    for given, name in ((rows, "some"), (rows.limit(0), "none")):
        path = flows._save_list(given, ["id"], F.struct("id", "text"), f"{tmp_path}/{name}.json")
        assert json.loads(open(path).read()) == [{"id": k, "text": f'a,"}}{k}'} for k in range(3000 if name == "some" else 0)]
    assert documents.corpus_from_json(spark, f"{tmp_path}/some.json").count() == 3000
