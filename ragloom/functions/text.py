"""Text functions: stripping, answer normalisation and matching, token estimates, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation, in one character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Labels of a context block's header.
SOURCE_LABEL, AUTHOR_LABEL = "Источник", "Автор"


def pystrip(text: Column) -> Column:
    """Without white space of any kind at either end (trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def node_key(name: Column) -> Column:
    """The key under which names of one entity meet."""
    return F.lower(pystrip(name))


def normalize_answer(answer: Column, case_sensitive: bool = False) -> Column:
    """Lower-cased, without articles and punctuation, single spaces; null counts as empty.

    Articles go before punctuation, so an underscore keeps the article it touches."""
    text = F.coalesce(answer.cast("string"), F.lit(""))
    text = text if case_sensitive else F.lower(text)
    text = F.regexp_replace(text, r"(?U)\b(a|an|the)\b", " ")
    text = F.regexp_replace(text, PUNCTUATION, "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _both(prediction: Column, truth: Column, normalize: bool) -> tuple[Column, Column]:
    if normalize:
        return normalize_answer(prediction), normalize_answer(truth)
    return F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))


def exact_match(prediction: Column, truth: Column, normalize: bool = True) -> Column:
    p, t = _both(prediction, truth, normalize)
    return p == t


def contains_match(prediction: Column, truth: Column, normalize: bool = True) -> Column:
    """The truth is part of the prediction; an empty truth is part of anything."""
    p, t = _both(prediction, truth, normalize)
    return F.contains(p, t)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def fuzzy_match(prediction: Column, truth: Column, normalize: bool = True, threshold: float = 0.8) -> Column:
    """Jaccard similarity of the token sets reaches the threshold; an empty truth matches an empty
    prediction only."""
    p, t = (token_set(x) for x in _both(prediction, truth, normalize))
    shared = F.size(F.array_intersect(p, t)) / F.greatest(F.size(F.array_union(p, t)), F.lit(1))
    return F.when(F.size(t) == 0, F.size(p) == 0).otherwise(shared >= threshold)


def estimate_tokens(text: Column) -> Column:
    """Words over 0.75, cut to a whole number."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))
    return F.floor(words / F.lit(0.75)).cast("int")


def sentences(text: Column) -> Column:
    """Cut after each full stop, exclamation or question mark that white space follows."""
    return F.split(text, r"(?U)(?<=[.!?])\s+", -1)


def is_markdown(text: Column, first_lines: int = 50) -> Column:
    """One of the first lines begins with a number sign, white space aside."""
    return F.coalesce(F.exists(F.slice(F.split(text, "\n"), 1, first_lines), lambda x: x.rlike(r"(?U)^\s*#")), F.lit(False))


def context_block(content: Column, metadata: Column) -> Column:
    """The content under a header of title and author, each only if there is one.

    A key doc_title, even with an empty value, goes before title."""
    title = F.when(F.map_contains_key(metadata, "doc_title"), metadata["doc_title"]).otherwise(metadata["title"])
    named = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x))
    header = F.concat_ws(", ", named(SOURCE_LABEL, title), named(AUTHOR_LABEL, metadata["author"]))
    return F.when(metadata.isNull() | (header == ""), content).otherwise(F.concat(F.lit("["), header, F.lit("]\n"), content))


def url_id(url: Column, position: Column) -> Column:
    """Twelve digits of the URL's md5, or the position where there is no URL."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.substring(F.md5(url.cast("binary")), 1, 12)).otherwise(F.concat(F.lit("doc_"), position.cast("string")))


def shortened(text: Column, length: int) -> Column:
    """The first code points: 500 in replies, 1000 in stored contexts."""
    return F.substring(text, 1, length)
