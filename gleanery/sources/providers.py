"""Where summaries and embeddings come from.

A provider works on batches inside tasks. Only the stub is built in; clients of
hosted models register from outside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from gleanery.functions.content import STUB_LINES, STUB_MIN_BYTES, WHITE_SPACE

# Vector lengths of known embedding models, and per provider.
MODEL_DIMS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
}
PROVIDER_DIMS = {"openai": 1536, "vertexai": 768}


class Provider(Protocol):
    """Summaries and vectors; an item that fails comes back as ``None``."""

    dim: int

    def summarize_batch(self, items: list[tuple[str, str, str]]) -> list[str | None]:
        """Summaries of (path, language, content)."""

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]:
        """Vectors of ``dim`` floats."""


class StubProvider:
    """Telling comments as summaries, zero vectors as embeddings."""

    def __init__(self, dim: int):
        self.dim = dim

    def summarize_batch(self, items):
        return [self._summary(path, content) for path, _, content in items]

    def embed_batch(self, texts):
        return [[0.0] * self.dim for _ in texts]

    @staticmethod
    def _summary(path: str, content: str) -> str:
        for line in content.split("\n", STUB_LINES)[:STUB_LINES]:
            line = line.strip(WHITE_SPACE)
            if line.startswith(("#", "//")) and len(line.encode()) > STUB_MIN_BYTES:
                return line
        return f"Code file: {path}"


_FACTORIES: dict[str, Callable[..., Provider]] = {
    "stub": StubProvider,
}
_HOSTED = ("openai", "vertexai")


def default_dim(provider: str, model: str = "") -> int:
    if provider == "vertexai":
        return PROVIDER_DIMS[provider]
    return MODEL_DIMS.get(model, PROVIDER_DIMS["openai"])


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    """Make a provider selectable by name. The factory must be picklable."""
    _FACTORIES[name.lower()] = factory


#: Characters of content that a hosted model takes; the specifications of such providers
#: set it as their ``input_limit``.
HOSTED_INPUT = 400_000


@dataclass(frozen=True)
class ProviderSpec:
    """A chosen provider that tasks can build for themselves.

    ``input_limit`` cuts the content a summary is made of; without one, the provider
    gets whole texts.
    """

    name: str
    factory: Callable[..., Provider]
    options: dict = field(default_factory=dict)
    input_limit: int | None = None

    def build(self) -> Provider:
        return self.factory(**self.options)

    @property
    def dim(self) -> int:
        return self.options["dim"]


def make_provider(
    name: str | None, input_limit: int | None = None, **options
) -> ProviderSpec:
    """The provider of this name; raises ``ValueError`` if there is none."""
    if not name:
        raise ValueError("provider config is required")
    key = name.lower()
    if key in _HOSTED:
        input_limit = input_limit or HOSTED_INPUT
        options["dim"] = options.get("dim") or default_dim(key, options.get("embed_model", ""))
    if key not in _FACTORIES:
        hint = "; register a client for it first" if key in _HOSTED else ""
        raise ValueError(f"unsupported provider: {name}{hint}")
    if not options.get("dim"):
        raise ValueError("embedding dimension must be set")
    return ProviderSpec(key, _FACTORIES[key], options, input_limit)
