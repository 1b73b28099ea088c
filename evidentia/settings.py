"""Settings of a knowledge base, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from evidentia.functions import fixed_values as V

#: A key that still starts like the template's placeholder counts as unset.
_PLACEHOLDER = "your_"


@dataclass(frozen=True)
class Settings:
    chunk_size: int = V.CHUNK_SIZE
    chunk_overlap: int = V.CHUNK_OVERLAP
    max_chunks: int = V.MAX_CHUNKS
    openai_api_key: str | None = None
    google_api_key: str | None = None
    openai_chat_model: str = "gpt-4o-mini"
    openai_embedding_model: str = "text-embedding-3-small"
    gemini_embedding_model: str = "gemini-embedding-001"
    gemini_reasoning_model: str = "gemini-2.5-flash-lite"


def from_environment() -> Settings:
    named = {}
    for field in ("openai_api_key", "google_api_key", "openai_chat_model", "openai_embedding_model", "gemini_embedding_model", "gemini_reasoning_model"):
        value = os.environ.get(field.upper())
        if value and not (field.endswith("_key") and value.startswith(_PLACEHOLDER)):
            named[field] = value
    return Settings(**named)
