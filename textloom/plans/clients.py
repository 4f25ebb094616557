"""Model clients and embedders behind plain callables: specs, a registry, retries and batches. No service is called from here."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from textloom.plans.settings import SettingError

Client = Callable[[str], str]
Embedder = Callable[[Sequence[str]], list[list[float]]]
ATTEMPTS, FIRST_WAIT = 4, 1.0


@dataclass(frozen=True)
class Spec:
    """provider[:model]; a model may hold colons."""

    provider: str
    model: str = ""

    @staticmethod
    def parse(value: str, defaults: dict[str, str]) -> Spec:
        provider, _, model = value.partition(":")
        if provider not in defaults:
            raise SettingError(f"no provider {provider!r}; there are {', '.join(sorted(defaults))}")
        return Spec(provider, model or defaults[provider])

    def __str__(self) -> str:
        return f"{self.provider}:{self.model}" if self.model else self.provider


@dataclass
class Registry:
    """Providers by name: a default model, the environment variable of a key if any, and what makes a client of (model, key)."""

    makers: dict[str, tuple[str, str, Callable[[str, str], Callable]]] = field(default_factory=dict)

    def add(self, provider: str, model: str, key_name: str, make: Callable[[str, str], Callable]) -> None:
        self.makers[provider] = (model, key_name, make)

    def client(self, value: str) -> Callable:
        """A client that is made, and its key read, at first use."""
        spec = Spec.parse(value, {n: m for n, (m, *_) in self.makers.items()})
        _, key_name, make = self.makers[spec.provider]
        made: list[Callable] = []

        def call(*args):
            if not made:
                key = os.environ.get(key_name, "") if key_name else ""
                if key_name and not key:
                    raise SettingError(f"{spec.provider} needs {key_name}")
                made.append(make(spec.model, key))
            return made[0](*args)

        return call


class Busy(Exception):
    """A failure that may pass; wait is what the service asks for, in seconds."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class TooLarge(Exception):
    """A batch that has to be sent in halves."""


def retried(call: Callable, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again while it is Busy: waits double, unless the service names its own."""

    def run(*args):
        wait = first_wait
        for k in range(attempts):
            try:
                return call(*args)
            except Busy as e:
                if k == attempts - 1:
                    raise
                sleep(wait if e.wait is None else e.wait)
                wait *= 2

    return run


def batched(embed: Embedder, size: int) -> Embedder:
    """embed in batches of size, in order; a batch that is TooLarge goes in halves."""

    def one(texts: Sequence[str]) -> list[list[float]]:
        try:
            return embed(texts)
        except TooLarge:
            if len(texts) < 2:
                raise
            half = len(texts) // 2
            return one(texts[:half]) + one(texts[half:])

    return lambda texts: [v for i in range(0, len(texts), size) for v in one(texts[i : i + size])]


def prompted(embed: Embedder, document: str, query: str) -> tuple[Embedder, Embedder]:
    """(for documents, for queries): embedders whose model wants another opening for either."""
    return (lambda texts: embed([document + t for t in texts])), (lambda texts: embed([query + t for t in texts]))
