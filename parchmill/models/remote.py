"""Adapters to language models that answer over HTTP, by the standard library alone.

An adapter is built once per worker and maps prompts to answers. Failures are tried again; a prompt whose tries are used
up has no answer, which classifies as all defaults. No address and no key is built in: a key is read from the environment
variable that ``key_variable`` names, on the executors.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass
from urllib.request import Request, urlopen


@dataclass(frozen=True)
class Endpoint:
    """Options of an address: ``form`` is "chat" (messages, choices) or "generate" (prompt, response)."""

    url: str
    model: str
    form: str = "chat"
    key_variable: str | None = None
    tries: int = 3
    wait: float = 1.0
    timeout: float = 120.0

    def __call__(self) -> Endpoint:
        return self

    def body(self, prompt: str) -> dict:
        if self.form == "generate":
            return {"model": self.model, "prompt": prompt, "stream": False}
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}]}

    def answer(self, said: dict) -> str | None:
        if self.form == "generate":
            return said.get("response")
        return ((said.get("choices") or [{}])[0].get("message") or {}).get("content")

    def ask(self, prompt: str) -> str | None:
        headers = {"Content-Type": "application/json"}
        if self.key_variable and os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        for attempt in range(self.tries):
            try:
                with urlopen(Request(self.url, json.dumps(self.body(prompt)).encode(), headers), timeout=self.timeout) as reply:
                    return self.answer(json.loads(reply.read()))
            except (OSError, ValueError):
                if attempt + 1 < self.tries:
                    time.sleep(self.wait * 2**attempt)
        return None

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self.ask(p) for p in prompts]


def adapter(endpoint: Endpoint):
    """A factory for :class:`.base.LanguageModel`: ``make=adapter(Endpoint(url, model))``."""
    return lambda: endpoint.complete
