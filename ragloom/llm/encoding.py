"""Token ids of whole texts by a public tokenizer file, at the speed of a table look-up."""

from __future__ import annotations

import json

#: Split by str.split, but no white space to the tokenizers' regular expressions.
_ODD = "\x1c\x1d\x1e\x1f"
#: Parts runs faster than a special token, for which a text is cut before it is normalised.
_PLAIN_MARK = "\x01"

#: The one definition of normalising and parting text for which runs may be put together.
#: It lower-cases each character by itself, and no piece holds both a letter and a mark after it.
_FOLDING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: A simple run is a word of ASCII and Latin-1 letters, which NFC leaves as they are and any
#: lower-casing treats alike, and these marks after it: two pieces.  No "<": added tokens are sought
#: before the case is folded.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "<")


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Runs(dict):
    """The ids of runs; those of a run that is not held are found by `learn`."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, run: str) -> bytes:
        return self.learn(self, run)


class WordEncoder:
    """Ids of texts under a tokenizer whose pieces never span white space.

    Such a tokenizer gives a text the ids of its space-free runs, one after the other, so a run is
    encoded once and then looked up; runs not yet known are encoded many at a time, parted by a
    mark that none of them holds.  Under the definition _FOLDING a simple run is put together from
    its lower-case word, which the tokenizer's model takes as it is, and the marks after it; all
    other runs are encoded as they are.  A tokenizer that is not of this kind encodes each text
    whole.  When the table holds `limit` runs it becomes the older one, from which runs still in use
    are taken over into a new one; long runs stay out of it: memory is bounded.
    """

    BLOCK, LONG = 250, 64

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special and not t[1].lstrip and not t[1].rstrip]
        self.mark_id, self.mark = (special[-1][0], special[-1][1].content) if special else (None, None)
        probe = ["ab  'll \u0107d\n12", "x\ty.. z", " q r!?\r\ns"]
        self.independent = self.mark is not None and all(self._ids(p) == b"".join(map(self._ids, p.split())) for p in probe)
        self.folds = self.independent and self._folding()
        if self.folds and len(self._ids(_PLAIN_MARK)) == 4:
            # Byte-level ids: no other character has this byte, so its id parts runs that don't hold it.
            self.mark, self.mark_id = _PLAIN_MARK, int.from_bytes(self._ids(_PLAIN_MARK), "little")
        if self.folds:
            pieces, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
            self.letters = {ord(c): pieces(c)[0][0] for c in map(chr, range(0x80, 0x100)) if c.isalpha()}
            self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.limit = limit
        self.table: dict[str, bytes] = _Runs(self._simple)
        self.older: dict[str, bytes] = {}
        self.others: set[str] = set()

    def _folding(self) -> bool:
        """Whether the tokenizer is defined as _FOLDING, and all its added tokens hold a "<"."""
        given = json.loads(self.tokenizer.to_str())
        steps = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        added = all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        parted = steps[0].get("pattern") == {"Regex": _FOLDING["pattern"]} and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        by_bytes = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        return added and given["normalizer"] == _FOLDING["normalizer"] and parted and by_bytes

    def _ids(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, table: dict[str, bytes], run: str) -> bytes | None:
        """The ids of a run that the older table holds or that is simple, kept; None for another,
        which is noted in `others`."""
        ids = self.older.get(run)
        if ids is None:
            word = run.rstrip(_MARKS) if self.folds and len(run) <= self.LONG else ""
            if not word.isalpha() or not _latin(word):
                self.others.add(run)
                return None
            lower = word.lower()
            if lower == run:
                ids = self._word(run)
            else:
                ids = table.get(lower) or self.older.get(lower)
                if ids is None:
                    table[lower] = ids = self._word(lower)
                if marks := run[len(word) :]:
                    after = table.get(marks)
                    if after is None:
                        table[marks] = after = self._ids(marks)
                    ids += after
        table[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of lower-case letters, which the tokenizer would leave as one piece."""
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])

    def _learn(self, runs: list[str]) -> None:
        import numpy as np

        for lo in range(0, len(runs), self.BLOCK):
            block = runs[lo : lo + self.BLOCK]
            flat = np.asarray(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(flat == self.mark_id)
            raw = flat.tobytes()
            self.table.update(zip(block, (raw[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(flat)], strict=True)), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null."""
        out: list[bytes] = []
        for lo in range(0, len(texts), 500):
            if len(self.table) > self.limit:
                self.table, self.older = _Runs(self._simple), self.table
            get = self.table.__getitem__  # one look-up a run: most are known
            others, new, late = self.others, set(), []
            for text in texts[lo : lo + 500]:
                if not text or not self._parts(text):
                    out.append(self._ids(text) if text else b"")
                    continue
                runs = (text.lower() if self.folds and "<" not in text and _latin(text) else text).split()
                code = list(map(get, runs))
                if others:
                    late.append((len(out), runs, code))
                    new |= others
                    others.clear()
                    out.append(b"")
                else:
                    out.append(b"".join(code))
            self._learn([r for r in new if len(r) <= self.LONG])
            whole = {r: self._ids(r) for r in new if len(r) > self.LONG}
            for at, runs, code in late:
                out[at] = b"".join([(whole[r] if r in whole else self.table[r]) if c is None else c for r, c in zip(runs, code, strict=True)])
        return out

    def _parts(self, text: str) -> bool:
        """Whether the text has the ids of its runs, one after the other."""
        return self.independent and self.mark not in text and not any(c in text for c in _ODD)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this worker's encoders: a later stage's tasks in the same process don't need them."""
    _encoders.clear()
