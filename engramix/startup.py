"""A memory from environment variables, one per process, and the checks that tell why one would not start.

ENGRAMIX_ROOT, and for both LLM and EMBEDDING: ENGRAMIX_<X>_API_KEY, _BASE_URL and _MODEL. The keys
fall back to OPENAI_API_KEY, the embedding key to the model's first.
"""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from engramix.clients import CachedEmbedder, Request
from engramix.hosted import HostedEmbedder, HostedLLM
from engramix.memory import Memory
from engramix.plans import service
from engramix.sources.store import SCHEMA_VERSION, MemoryStore

log = logging.getLogger(__name__)
DEFAULT_URL = "https://api.openai.com/v1"


@dataclass(frozen=True)
class Settings:
    root: str
    llm_key: str | None
    llm_url: str
    llm_model: str
    embedding_key: str | None
    embedding_url: str
    embedding_model: str

    @classmethod
    def resolve(cls, env: Mapping[str, str] | None = None) -> Settings:
        """What the environment asks for; never fails and asks no endpoint."""
        env = os.environ if env is None else env
        get = lambda name, default=None: env.get(f"ENGRAMIX_{name}") or default
        llm = get("LLM_API_KEY") or env.get("OPENAI_API_KEY") or None
        return cls(
            get("ROOT", os.path.expanduser("~/.engramix")), llm, get("LLM_BASE_URL", DEFAULT_URL), get("LLM_MODEL", "gpt-4o-mini"),
            get("EMBEDDING_API_KEY") or llm, get("EMBEDDING_BASE_URL", DEFAULT_URL), get("EMBEDDING_MODEL", "text-embedding-3-small"),
        )

    def llm(self) -> HostedLLM:
        return HostedLLM(self.llm_key or "", self.llm_url, self.llm_model)

    def embedder(self) -> HostedEmbedder:
        return HostedEmbedder(self.embedding_key or "", self.embedding_url, self.embedding_model)


def build(spark: SparkSession, settings: Settings | None = None) -> Memory:
    """A memory as the environment describes it; fails at once without a key for the model.

    Without a key for embeddings search is by words alone. A lock that an earlier process left is
    cleared: one process at a time is to run cycles on a root.
    """
    s = settings or Settings.resolve()
    if not s.llm_key:
        raise RuntimeError("no key for the model: set ENGRAMIX_LLM_API_KEY or OPENAI_API_KEY")
    if not s.embedding_key:
        log.warning("no key for embeddings: search goes by words alone")
    memory = Memory(spark, f"{s.root}/store", s.llm(), CachedEmbedder(s.embedder()) if s.embedding_key else None, notes=s.root)
    if memory.store.clear_lock():
        log.warning("cleared the lock of an earlier process")
    return memory


_instance: Memory | None = None


def instance(spark: SparkSession) -> Memory:
    """The process's memory, built at first use."""
    global _instance
    if _instance is None:
        _instance = build(spark)
    return _instance


def set_instance(memory: Memory | None) -> None:
    global _instance
    _instance = memory


def preflight(spark: SparkSession, settings: Settings | None = None, probe: bool = True) -> list[tuple[str, str, str]]:
    """(check, ok, warn or fail, detail) of the root, model, embedder, schema, dimension and stored names. probe: ask the endpoints."""
    s = settings or Settings.resolve()
    out: list[tuple[str, str, str]] = []

    def check(name: str, f) -> object:
        try:
            state, detail, value = f()
        except Exception as e:  # a check must not end the others
            state, detail, value = "fail", f"{type(e).__name__}: {e}", None
        out.append((name, state, detail))
        return value

    def root():
        os.makedirs(s.root, exist_ok=True)
        path = os.path.join(s.root, f".probe-{uuid.uuid4().hex}")
        with open(path, "w", encoding="utf-8") as f:
            f.write("ok")
        os.remove(path)
        return "ok", f"{s.root} is writable", None

    def model():
        if not s.llm_key:
            return "fail", "no key: set ENGRAMIX_LLM_API_KEY or OPENAI_API_KEY", None
        if probe:
            s.llm().complete(Request("probe", "", "ping", json=False, max_tokens=1))
        return "ok", f"{s.llm_model} at {s.llm_url}", None

    def embeddings():
        if not s.embedding_key:
            return "warn", "no key: search goes by words alone", None
        e = s.embedder()
        if probe:
            e.embed(["probe"])
        return "ok", f"{s.embedding_model} at {s.embedding_url}", e.dim if probe else None

    def schema():
        store = MemoryStore(spark, f"{s.root}/store")
        return "ok", f"schema {store.manifest()['schema']} of {SCHEMA_VERSION}", store

    def dimension():
        if store is None:
            return "fail", "the store can't be read", None
        have = [r[0] for r in store.table("chunk_vectors").select("dim").distinct().limit(10).collect()]
        if not have or live is None:
            return ("ok", "no vectors yet", None) if not have else ("warn", f"vectors of {have}; the model was not asked", None)
        return ("ok" if have == [live] else "fail"), f"vectors of {have}, the model gives {live}", None

    def names():
        bad = [f"{r['check']}: {r['n']}" for r in service.doctor(store.table).filter("NOT ok").collect()]
        return ("warn" if bad else "ok"), "; ".join(bad) or "all checks hold", None

    check("root", root)
    check("model", model)
    live = check("embeddings", embeddings)
    store = check("schema", schema)
    check("dimension", dimension)
    check("tables", names)
    return out
