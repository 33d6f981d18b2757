"""Models over HTTP as plain callables, tried again on time-outs, overload and server errors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

RETRIED = (408, 425, 429)


def with_retry(call: Callable[[], object], attempts: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """``call`` until it succeeds; the wait doubles, other errors than passing ones are raised at once."""
    for turn in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if turn + 1 == attempts or not (e.code in RETRIED or e.code >= 500):
                raise
        except (TimeoutError, urllib.error.URLError, ConnectionError):
            if turn + 1 == attempts:
                raise
        sleep(wait * 2**turn)
    raise ValueError("no attempt was allowed")


def post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


@dataclass
class HttpModel:
    """One model behind one address; ``send`` is what reaches it, so that tests need no network."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60
    attempts: int = 4
    send: Callable[..., dict] = post
    sleep: Callable[[float], None] = time.sleep

    def _ask(self, body: dict) -> dict:
        return with_retry(lambda: self.send(self.url, body, self.headers, self.timeout), self.attempts, sleep=self.sleep)

    def complete(self, prompt: str, system: str = "", max_tokens: int = 64) -> str:
        reply = self._ask({"model": self.model, "prompt": prompt, "system": system, "stream": False, "options": {"num_predict": max_tokens}})
        return str(reply.get("response", "")).strip()

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = self._ask({"model": self.model, "input": texts}).get("embeddings", [])
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
