"""Chunking: sentences packed greedily, with an overlap, into chunks of about a number of tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUT = re.compile(r"(?<=[.!?])\s+")
CHUNK_SCHEMA = "doc_id string, chunk_index int, content string, start_idx int, end_idx int"


def _estimate(text: str) -> int:
    return int(len(text.split()) / 0.75)


class _Packer:
    """Sentences so far, their tokens, and where the open chunk begins."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.parts: list[tuple[str, int]] = []  # text, tokens it counts for
        self.begin, self.at, self.done = 0, 0, []

    @property
    def tokens(self) -> int:
        return sum(n for _, n in self.parts)

    def close(self) -> None:
        if self.parts:
            self.done.append((" ".join(t for t, _ in self.parts), self.begin, self.at))

    def tail(self) -> list[tuple[str, int]]:
        """The last parts that fit into the overlap, each by its own estimate."""
        kept, room = [], self.overlap
        for text, _ in reversed(self.parts):
            n = _estimate(text)
            if n > room:
                break
            kept.append((text, n))
            room -= n
        return kept[::-1]

    def add(self, sentence: str) -> None:
        n = _estimate(sentence)
        if n > self.size:
            self._add_long(sentence.split())
        elif self.tokens + n > self.size:
            self.close()
            self.parts = (self.tail() if self.overlap > 0 else []) + [(sentence, n)]
            self.begin = self.at
        else:
            self.parts.append((sentence, n))
        self.at += len(sentence) + 1

    def _add_long(self, words: list[str]) -> None:
        """Runs of `size` words are chunks; words left over open the next one, each a part."""
        if self.parts:
            self.close()
            self.parts, self.begin = [], self.at
        whole = len(words) // self.size * self.size
        for lo in range(0, whole, self.size):
            text = " ".join(words[lo : lo + self.size])
            self.done.append((text, self.begin, self.at + len(text)))
            self.begin = self.at + len(text) + 1
        self.parts = [(w, 1) for w in words[whole:]]


def chunk_text(text: str, size: int = 256, overlap: int = 50) -> list[tuple[str, int, int]]:
    """(chunk, start, end) of a text.  Places are approximate: they take one character between
    sentences.  An empty text is one empty chunk."""
    packer = _Packer(size, overlap)
    for sentence in _CUT.split(text):
        packer.add(sentence)
    packer.close()
    return packer.done


def split_markdown(text: str) -> list[tuple[str, dict[str, str]]]:
    """(section, its headers) at each heading outside fenced code; headers of levels 1 to 3."""
    sections, lines, open_headers, fenced = [], [], {}, False

    def flush():
        if body := "\n".join(lines).strip():
            sections.append((body, {f"header_{k}": v for k, v in sorted(open_headers.items()) if k <= 3}))

    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            flush()
            lines, level = [], len(m[1])
            open_headers = {k: v for k, v in open_headers.items() if k < level} | {level: m[2].strip()}
        lines.append(line)
    flush()
    return sections


def chunk_documents(docs: DataFrame, size: int = 256, overlap: int = 50, markdown: bool = False) -> DataFrame:
    """chunk_id, doc_id, content, start_idx, end_idx, metadata of documents (doc_id, content, title,
    metadata).

    The metadata hold title and chunk_index; the document's own go before both.  With `markdown`,
    texts that look like it are cut at headings first, and chunks have header_1 to header_3.  A
    document is one row's work, so its partition is kept and nothing is shuffled.
    """
    from ..functions.text import is_markdown

    slim = docs.select(F.col("doc_id").cast("string"), "content", "title", "metadata", (is_markdown(F.col("content")) if markdown else F.lit(False)).alias("md"))
    schema = "doc_id string, title string, metadata map<string,string>, chunk_index int, content string, start_idx int, end_idx int, headers map<string,string>"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]
        names = ["doc_id", "title", "metadata", "chunk_index", "content", "start_idx", "end_idx", "headers"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for doc_id, content, title, metadata, md in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    parts = split_markdown(content or "") if md else [(content or "", {})]
                    found = [(c, h) for text, h in parts for c in chunk_text(text, size, overlap)]
                    out += [(doc_id, title, metadata, k, *c, list(h.items())) for k, (c, h) in enumerate(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = slim.mapInArrow(run, schema)
    own = F.create_map(F.lit("title"), F.coalesce("title", F.lit("")), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    given = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    later = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), F.map_filter("headers", lambda k, v: ~F.map_contains_key(given, k)), given)
    return found.select(F.concat(F.col("doc_id"), F.lit("::chunk_"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "content", "start_idx", "end_idx", later.alias("metadata"))
