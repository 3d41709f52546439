"""Model providers: embedding and chat.  The offline ones are deterministic stand-ins for tests and
dry runs; their output says nothing about the quality of a model."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def reply(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Counts of lower-cased words by the first 8 digits of their md5, modulo the dimension."""

    dimension: int = 64
    _seen: dict[str, int] = field(default_factory=dict, compare=False, repr=False)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            row = [0.0] * self.dimension
            for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
                at = self._seen.get(word)
                if at is None:
                    if len(self._seen) > 500_000:
                        self._seen.clear()
                    at = self._seen[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension
                row[at] += 1.0
            out.append(row)
        return out


@dataclass(frozen=True)
class OfflineChat:
    """Stand-in replies: JSON of capitalised words for extraction, the first words of the prompt's
    text else."""

    words: int = 30

    def reply(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str:
        from .functions import prompts

        if system == prompts.EXTRACT_SYSTEM:
            return json.dumps(capitalised(prompt.partition("Text:\n")[2]), ensure_ascii=False)
        if system == prompts.CLASSIFY_SYSTEM:
            return "reasoning" if re.search(r"\b(and|why|compare|before|after|both)\b", prompt.lower()) else "fact"
        return " ".join(prompt.split()[: self.words])


def capitalised(text: str, limit: int = 10) -> dict:
    """Words of an upper-case and further letters as entities; consecutive ones are related."""
    names = [w for w in re.findall(r"[^\W\d_]{2,}", text) if w[0].isupper()]
    pairs = list(zip(names, names[1:], strict=False))[:limit]
    kept = list(dict.fromkeys(n for p in pairs for n in p)) or names[:1]
    return {
        "entities": [{"entity_name": n, "entity_type": "Word", "entity_description": ""} for n in kept],
        "relationships": [{"source_entity": a, "target_entity": b, "relation": "CO_OCCURS", "relationship_description": ""} for a, b in pairs],
    }


def retried(call: Callable[[], object], attempts: int = 3, wait: Callable[[float], None] = time.sleep):
    """The call's result; after a failure it waits 1, 2, 4 ... seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except (OSError, urllib.error.URLError, ValueError, KeyError):
            if k == attempts - 1:
                raise
            wait(2.0**k)
    raise ValueError("attempts must be positive")


@dataclass(frozen=True)
class _Http:
    base_url: str
    model: str
    api_key: str = field(default="", repr=False)
    timeout: float = 60.0
    attempts: int = 3

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})

        def call():
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)

        return retried(call, self.attempts)


@dataclass(frozen=True)
class HttpEmbedder(_Http):
    dimension: int = 1536
    batch: int = 100

    def embed(self, texts: list[str]) -> list[list[float]]:
        """In the order of the texts, whatever the order of the reply."""
        out = []
        for lo in range(0, len(texts), self.batch):
            data = self._post("embeddings", {"model": self.model, "input": texts[lo : lo + self.batch]})["data"]
            out += [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        return out


@dataclass(frozen=True)
class HttpChat(_Http):
    temperature: float = 0.0
    max_tokens: int = 512

    def reply(self, prompt: str, system: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str:
        """An explicit temperature of 0 counts."""
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature if temperature is None else temperature, "max_tokens": max_tokens or self.max_tokens}
        return (self._post("chat/completions", body)["choices"][0]["message"]["content"] or "").strip()


def output_limit(info: dict | None, fallback: int = 4096, share: int = 4, most: int = 16384) -> int:
    """Tokens that a model may reply with, from what its provider says of it."""
    info = info or {}
    stated = (info.get("top_provider") or {}).get("max_completion_tokens") or info.get("max_completion_tokens")
    if stated:
        return int(stated)
    return min(int(info["context_length"]) // share, most) if info.get("context_length") else fallback


_infos: dict[tuple[str, str], dict] = {}


def model_info(model: str, base_url: str, fetch: Callable[[str], dict]) -> dict | None:
    """What the provider says of a model, by its own page or else the list; None after any error.
    Only successes are kept."""
    key = (base_url, model)
    if key in _infos:
        return _infos[key]
    for page, pick in ((f"{base_url}/models/{model}", lambda r: r.get("data", r)), (f"{base_url}/models", lambda r: next((m for m in r["data"] if m.get("id") == model), None))):
        try:
            if found := pick(fetch(page)):
                _infos[key] = found
                return found
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return None
