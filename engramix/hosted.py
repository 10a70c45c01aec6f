"""Models behind HTTP endpoints of the common chat-completions and embeddings form, on the standard library.

Objects hold plain settings only and so travel to executors.
"""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from engramix.clients import Request


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(ask, timeout=timeout) as answer:  # noqa: S310  the caller names the endpoint
        return json.loads(answer.read())


@dataclass
class HostedLLM:
    key: str
    base_url: str
    model: str
    timeout: float = 120.0

    def complete(self, request: Request) -> str:
        body = {
            "model": self.model, "temperature": request.temperature, "max_tokens": request.max_tokens,
            "messages": [{"role": "system", "content": request.system}, {"role": "user", "content": request.user}],
        }
        if request.json:
            body["response_format"] = {"type": "json_object"}
        return _post(f"{self.base_url.rstrip('/')}/chat/completions", self.key, body, self.timeout)["choices"][0]["message"]["content"]


@dataclass
class HostedEmbedder:
    """dim is what the model is said to give; the first answer corrects it."""

    key: str
    base_url: str
    model: str
    dim: int = 1024
    timeout: float = 60.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = _post(f"{self.base_url.rstrip('/')}/embeddings", self.key, {"model": self.model, "input": list(texts)}, self.timeout)["data"]
        out = [[float(x) for x in d["embedding"]] for d in sorted(found, key=lambda d: d.get("index", 0))]
        if out:
            self.dim = len(out[0])
        return out
