"""Language-model providers: the interface, an offline one, and one over HTTP."""

from __future__ import annotations

import json
import math
import os
import re
import time
import urllib.request
from typing import Protocol

import numpy as np

from brevis.functions.text import SPACE

DIMENSIONS = 64
#: Fixed value: words that mark a sentence as worth remembering.
_SIGNAL = re.compile(r"\b(?:want|need|prefer|must|should|decided|use|is|are|named|called|because|so that|goal)\b", re.I | re.A)
PROMPT = (
    "List what later turns of this conversation will still need: preferences, decisions, names, goals and open tasks. "
    "One short fact a line, each after \"- \". Leave out politeness, repeats and what soon passes. The conversation:\n---"
)


class Provider(Protocol):
    def complete(self, prompt: str, max_tokens: int = 1024) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class OfflineProvider:
    """Extracts telling sentences and embeds by hashing; the same results everywhere."""

    def complete(self, prompt: str, max_tokens: int = 1024) -> str:
        body = prompt.rpartition("---")[2]
        space = f"[{SPACE}]"
        parts = (re.sub(f"^{space}+|{space}+$", "", x) for x in re.split(f"(?<=[.!?]){space}+|\n+", body))
        found = [x for x in parts if x]
        worth = [5 * bool(_SIGNAL.search(x)) + min(len(x) / 40, 4) for x in found]
        best = sorted(range(len(found)), key=lambda i: (-worth[i], i))[: max(1, math.ceil(len(found) / 4))]
        return "\n".join("- " + re.sub(f"^(?:user|assistant){space}*:{space}*", "", found[i], flags=re.I) for i in best)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The vectors of ``embed`` before they are scaled: whole numbers of words."""
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z0-9_]+", text.lower()):
                row[bucket(word)] += 1
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        out = self.counts(texts)
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)


def directions(provider: Provider, texts: list[str]) -> np.ndarray:
    """Vectors whose cosines rank texts: those of ``embed``, of any length. The offline provider's are
    taken unscaled: whole numbers add up exactly, so rounding does not part texts of equal sums."""
    if getattr(provider.embed, "__func__", None) is OfflineProvider.embed:
        return provider.counts(texts)
    return provider.embed(texts)


def bucket(word: str) -> int:
    """32-bit FNV-1a of a word, its absolute signed value modulo the dimensions."""
    h = 2166136261
    for c in word:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return (h if h < 1 << 31 else (1 << 32) - h) % DIMENSIONS


class HttpProvider:
    """A messages endpoint over HTTP; made once per task. It has no embeddings."""

    def __init__(self, url: str, model: str, key: str | None = None, key_variable: str = "BREVIS_API_KEY", timeout: float = 60.0, tries: int = 3, pause: float = 1.0):
        self.url, self.model, self.key = url, model, key or os.environ.get(key_variable)
        self.timeout, self.tries, self.pause = timeout, tries, pause
        if not self.key:
            raise ValueError(f"give a key or set {key_variable}")

    def complete(self, prompt: str, max_tokens: int = 1024) -> str:
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"content-type": "application/json", "x-api-key": self.key})
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # other than 2xx raises
                    return "".join(part.get("text", "") for part in json.load(reply)["content"] if part.get("type") == "text")
            except OSError as e:
                # too many requests, a server's own failure or a lost connection may pass
                if not left or getattr(e, "code", 500) not in (408, 429) and getattr(e, "code", 500) < 500:
                    raise
            time.sleep(self.pause * (self.tries - left))
        raise AssertionError("unreachable")


def distill(transcript: str, provider: Provider) -> list[str]:
    """Facts of a transcript, one a line of the completion."""
    out = []
    for line in provider.complete(f"{PROMPT}\n{transcript}", max_tokens=512).split("\n"):
        fact = re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", re.sub(f"^[-*][{SPACE}]*", "", line))
        if fact:
            out.append(fact)
    return out


def words_of(text: str) -> frozenset[str]:
    return frozenset(re.findall("[a-z0-9_]+", text.lower()))


def keep_unlike(texts: list[str], threshold: float = 0.8) -> list[int]:
    """Indexes kept in order: a text goes if it is too like one kept before (Jaccard of words).

    Only kept texts that share a word are compared, found through an index of words.
    """
    kept: dict[int, frozenset[str]] = {}
    index: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        own = words_of(text)
        near: dict[int, int] = {}
        for w in own:
            for j in index.get(w, ()):
                near[j] = near.get(j, 0) + 1
        if any(n / (len(own) + len(kept[j]) - n) >= threshold for j, n in near.items()):
            continue
        kept[i] = own
        for w in own:
            index.setdefault(w, []).append(i)
    return list(kept)
