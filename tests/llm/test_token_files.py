import zlib

import numpy as np

from ragloom.llm import token_files
from ragloom.llm.encoding import WordEncoder


def test_round_trip(spark, documents, tokenizer_path):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(None, "null id"), (500, None), (501, ""), (3, "twice"), (600, "long " * 40_000), (None, None), (None, "null id"), (700, "again"), (700, "again")]
    files = token_files.write_token_files(documents(rows), tokenizer_path, end_id=2)
    assert token_files.TokenFiles.open(files.folder) == files and files.dtype == "<u2"
    encode = WordEncoder(tokenizer_path)._ids
    expected, start = [], 0
    order = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]])):
        code = encode(text or "") + b"\2\0\0\0"
        expected.append((doc_id, start, len(code) // 4, zlib.crc32(code)))
        start += len(code) // 4
    found = sorted((tuple(r) for r in token_files.token_file_digests(spark, files).collect()), key=lambda r: r[1])
    assert found == expected and files.tokens == start
    raw = {(r.doc_id, r.start): np.frombuffer(bytes(r.ids), "<u2") for r in token_files.read_token_files(spark, files).collect()}
    assert len(raw) == len(rows)
    assert all(zlib.crc32(raw[d, s].astype("<u4").tobytes()) == c for d, s, _, c in expected)


def test_empty(spark, documents, tokenizer_path):
    files = token_files.write_token_files(documents([(1, "x")]).limit(0), tokenizer_path, end_id=2)
    assert files.tokens == 0
    assert token_files.token_file_digests(spark, files).count() == 0
