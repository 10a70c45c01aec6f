"""Model clients. Real ones are plugged in by the caller; the stubs here are deterministic."""

from __future__ import annotations

import hashlib
import logging
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
TASKS = ("triples", "markers", "episodes", "summary", "procedures", "rerank")


@dataclass(frozen=True)
class Request:
    """One question to a model. kind is one of TASKS; clients may choose a model by it."""

    kind: str
    system: str
    user: str
    json: bool = True
    max_tokens: int = 1024
    temperature: float = 0.0


class LLM(Protocol):
    def complete(self, request: Request) -> str: ...


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class StubLLM:
    """Answers by the first part of the prompt (system, then user) that a fixture names, else the default."""

    fixtures: dict[str, str] = field(default_factory=dict)
    default: str | None = "[]"

    def complete(self, request: Request) -> str:
        for part, answer in self.fixtures.items():
            if part in request.system or part in request.user:
                return answer
        if self.default is None:
            raise LookupError("no fixture for this prompt")
        return self.default


@dataclass
class StubEmbedder:
    """Unit vectors from the text's SHA-256."""

    dim: int = 16
    model: str = "stub"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [b / 255.0 - 0.5 for b in hashlib.sha256(t.encode()).digest()[: self.dim]]
            norm = math.sqrt(sum(x * x for x in raw)) or 1.0
            out.append([x / norm for x in raw])
        return out


class CachedEmbedder:
    """Keeps the vectors of the last `size` texts; only new ones are asked, each once per call."""

    def __init__(self, inner: Embedder, size: int = 128):
        self.inner, self.size, self.model = inner, size, inner.model
        self._kept: OrderedDict[str, list[float]] = OrderedDict()

    @property
    def dim(self) -> int:
        return self.inner.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = {}
        for t in texts:
            if t in self._kept:
                self._kept.move_to_end(t)
                found[t] = self._kept[t]
        fresh = [t for t in dict.fromkeys(texts) if t not in found]
        for t, v in zip(fresh, self.inner.embed(fresh) if fresh else []):
            found[t] = self._kept[t] = v
            if len(self._kept) > self.size:
                self._kept.popitem(last=False)
        return [found[t] for t in texts]


def ask(rows: DataFrame, llm: LLM, requests: dict[str, tuple[str, bool]], text: str = "text") -> DataFrame:
    """rows without `text`, with one answer column per request {column: (system prompt, json)} and `failed`.

    Called on the executors in Arrow batches. Where one call of a row fails all its answers are null
    and `failed` holds the error, so a caller can leave the row for the next cycle.
    """
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    schema += "".join(f", `{c}` string" for c in requests) + ", failed string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            answers: dict[str, list] = {c: [] for c in requests}
            failed = []
            for t in batch[text]:
                try:
                    got = {c: llm.complete(Request(c, system, t or "", as_json)) for c, (system, as_json) in requests.items()}
                    failed.append(None)
                except Exception as e:  # one bad answer must not cost the batch
                    got = dict.fromkeys(requests)
                    failed.append(f"{type(e).__name__}: {e}"[:500])
                for c in requests:
                    answers[c].append(got[c])
            for c, a in answers.items():
                out[c] = pd.Series(a, index=out.index, dtype=object)
            out["failed"] = pd.Series(failed, index=out.index, dtype=object)
            yield out

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, embedder: Embedder, text: str, at_a_time: int = 64) -> DataFrame:
    """rows without `text`, with v, model and dim; asked in batches on the executors.

    Rows of a batch whose call fails are left out, so they are still without a vector and come again
    in the next cycle.
    """
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + ", v array<double>, model string, dim int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, vectors, got = list(batch[text]), [], []
            for i in range(0, len(texts), at_a_time):
                part = texts[i : i + at_a_time]
                try:
                    vectors += embedder.embed(part)
                    got += range(i, i + len(part))
                except Exception as e:  # the other batches still count
                    log.warning("%d texts got no vector: %s: %s", len(part), type(e).__name__, e)
            out = batch[keep].iloc[got].copy()
            out["v"] = pd.Series(vectors, index=out.index, dtype=object)
            out["model"], out["dim"] = embedder.model, embedder.dim
            yield out

    return rows.mapInPandas(run, schema)
