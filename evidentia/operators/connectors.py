"""Hosted models behind the interfaces of providers. Their client packages are imported where a call is made, so none is needed here.

Connectors are sent to the tasks with their settings and make their clients there. Calls go out in bounded batches, no faster than
per_minute, and are tried again with growing waits; the last failure is raised and falls back as providers defines.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from evidentia.functions.arrow import chunks_by_bytes
from evidentia.settings import Settings

#: Texts and bytes of one embedding call.
BATCH_TEXTS, BATCH_BYTES = 256, 200_000


@dataclass
class Connector:
    api_key: str = field(repr=False)
    model: str
    tries: int = 4
    wait: float = 1.0
    per_minute: float | None = None
    name: str = ""
    detector: str = ""

    def __post_init__(self) -> None:
        self._client: Any = None
        self._next = 0.0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_client": None, "_next": 0.0}

    def client(self) -> Any:
        if self._client is None:
            self._client = self.connect()
        return self._client

    def connect(self) -> Any:
        raise NotImplementedError

    def call(self, use: Callable[[], Any]) -> Any:
        """use(), at the allowed rate, tried again after failures. A missing package is raised at once."""
        for left in range(self.tries - 1, -1, -1):
            if self.per_minute:
                time.sleep(max(0.0, self._next - time.monotonic()))
                self._next = time.monotonic() + 60 / self.per_minute
            try:
                return use()
            except ImportError:
                raise
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))

    @staticmethod
    def batches(texts: list[str]) -> Iterator[list[str]]:
        for i, j in chunks_by_bytes([len(t.encode()) for t in texts], BATCH_BYTES):
            for k in range(i, j, BATCH_TEXTS):
                yield texts[k : min(j, k + BATCH_TEXTS)]


class _OpenAI(Connector):
    def connect(self) -> Any:
        from openai import OpenAI

        return OpenAI(api_key=self.api_key)


class OpenAIEmbedder(_OpenAI):
    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for batch in self.batches(texts):
            reply = self.call(lambda batch=batch: self.client().embeddings.create(model=self.model, input=batch))
            out += [list(item.embedding) for item in reply.data]
        return out


class OpenAIGenerator(_OpenAI):
    def generate(self, prompts: list[str]) -> list[str]:
        ask = lambda p: self.client().chat.completions.create(model=self.model, temperature=0.1, messages=[{"role": "user", "content": p}])
        return [self.call(lambda p=p: ask(p)).choices[0].message.content or "" for p in prompts]


class _Gemini(Connector):
    def connect(self) -> Any:
        from google import genai

        return genai.Client(api_key=self.api_key)


class GeminiEmbedder(_Gemini):
    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        reply = self.call(lambda: self.client().models.embed_content(model=self.model, contents=text))
        found = getattr(reply, "embedding", None) or (getattr(reply, "embeddings", None) or [None])[0]
        if getattr(found, "values", None) is None:
            raise RuntimeError("The reply holds no embedding")
        return list(found.values)


class GeminiGenerator(_Gemini):
    def generate(self, prompts: list[str]) -> list[str]:
        return [self.call(lambda p=p: self.client().models.generate_content(model=self.model, contents=p)).text or "" for p in prompts]


def embedder(settings: Settings, provider: str = "Local TF-IDF") -> OpenAIEmbedder | GeminiEmbedder | None:
    """The embedder of a provider whose key is set; None stands for the local index."""
    if provider == "OpenAI" and settings.openai_api_key:
        return OpenAIEmbedder(settings.openai_api_key, settings.openai_embedding_model, name="OpenAI", detector="openai")
    if provider == "Google Gemini" and settings.google_api_key:
        return GeminiEmbedder(settings.google_api_key, settings.gemini_embedding_model, name="Google Gemini", detector="gemini")
    return None


def guard_embedder(settings: Settings) -> OpenAIEmbedder | GeminiEmbedder | None:
    """The guard takes the first provider with a key."""
    return embedder(settings, "Google Gemini") or embedder(settings, "OpenAI")


def generator(settings: Settings, provider: str = "Local") -> OpenAIGenerator | GeminiGenerator | None:
    """The generator of a provider whose key is set; None stands for the local answers."""
    if provider == "Gemini" and settings.google_api_key:
        return GeminiGenerator(settings.google_api_key, settings.gemini_reasoning_model, name="Gemini")
    if provider == "OpenAI" and settings.openai_api_key:
        return OpenAIGenerator(settings.openai_api_key, settings.openai_chat_model, name="OpenAI")
    return None
