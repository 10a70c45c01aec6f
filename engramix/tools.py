"""The memory as seven tools for agents, and a server of the Model Context Protocol over standard input and output.

Messages are JSON-RPC 2.0, one per line. `call` is the whole of it; `serve` only carries lines.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from typing import TextIO

from engramix.memory import Memory
from engramix.vocabulary import ROLES

PROTOCOL = "2024-11-05"
TOOLS: dict[str, tuple[Callable, str, dict[str, dict], tuple[str, ...]]] = {}
TEXT = {"type": "string"}


def tool(about: str, required: tuple[str, ...] = (), **members: dict):
    def put(f):
        TOOLS[f.__name__] = (f, about, members, required)
        return f

    return put


def _turns(memory: Memory, rows: list[tuple]):
    return memory.spark.createDataFrame(rows, "session_id string, pos int, role string, content string")


@tool("Log a whole conversation, then consolidate it unless dream is false.", ("session_id", "messages"), session_id=TEXT, messages={"type": "string", "description": "JSON array of {role, content}"}, dream={"type": "boolean"})
def memory_capture(memory: Memory, as_of: str, session_id: str, messages: str, dream: bool = True) -> str:
    payload = memory.spark.createDataFrame([(session_id, messages)], "session_id string, raw string")
    logged, errors = memory.capture(payload, as_of)
    if errors:
        return f"error: messages must be a JSON array ({errors[0]})"
    memory.open_session(session_id, as_of)
    memory.close_session(session_id, as_of)
    said = f"logged {logged} turns of session {session_id!r}"
    return said if not dream else f"{said}; {_cycle(memory, as_of, [session_id])}"


@tool("Log one turn of a conversation.", ("session_id", "role", "content"), session_id=TEXT, role={"type": "string", "enum": list(ROLES)}, content=TEXT)
def memory_log(memory: Memory, as_of: str, session_id: str, role: str, content: str) -> str:
    if role not in ROLES:
        return f"error: role must be one of {', '.join(ROLES)}"
    memory.log(_turns(memory, [(session_id, 0, role, content)]), as_of)
    return "logged"


@tool("Consolidate what was logged: facts, profile, decay.")
def memory_dream(memory: Memory, as_of: str) -> str:
    return _cycle(memory, as_of, None)


def _cycle(memory: Memory, as_of: str, sessions: list[str] | None) -> str:
    report = memory.dream(as_of, sessions)
    if report.skipped:
        return "skipped: another cycle is running"
    c = report.counts
    return f"consolidated {c['chunks_processed']} of {c['chunks_seen']} chunks, {c['triples']} triples, {c['markers']} markers"


@tool("Facts and past passages that bear on a message.", ("message",), message=TEXT)
def memory_augment(memory: Memory, as_of: str, message: str) -> str:
    context = memory.augment(message, as_of)
    facts = [f"- {r['s']} {r['p']} {r['o']} (conf {r['conf']:.2f}, +{r['pos']}/-{r['neg']})" for r in context.facts.collect()]
    said = [f"[{r['session_id']}] {r['text'][:300]}" for r in context.passages.collect()]
    parts = (["Known facts:\n" + "\n".join(facts)] if facts else []) + (["From past conversations:\n" + "\n".join(said)] if said else [])
    return "\n\n".join(parts)


@tool("The user's profile and the project's insights.")
def memory_profile(memory: Memory, as_of: str) -> str:
    parts = [f"=== {title} ===\n{text.strip()}" for title, name in (("USER PROFILE", "USER.md"), ("PROJECT INSIGHTS", "MEMORY.md")) if (text := memory.note(name)).strip()]
    return "\n\n".join(parts) or "Neither a profile nor insights yet."


@tool("Make a surface name stand for a canonical one.", ("surface", "canonical"), surface=TEXT, canonical=TEXT)
def memory_alias(memory: Memory, as_of: str, surface: str, canonical: str) -> str:
    memory.add_alias(surface, canonical)
    return f"alias registered: {surface!r} -> {canonical!r}"


@tool("Retract a fact that is wrong.", ("subject", "predicate", "object"), subject=TEXT, predicate=TEXT, object=TEXT)
def memory_retract(memory: Memory, as_of: str, subject: str, predicate: str, object: str) -> str:
    return "retracted" if memory.retract(subject, predicate, object, as_of) else "no matching active edge"


def listing() -> list[dict]:
    return [{"name": n, "description": about, "inputSchema": {"type": "object", "properties": members, "required": list(required)}} for n, (_, about, members, required) in TOOLS.items()]


def call(memory: Memory, name: str, arguments: dict, as_of: str) -> str:
    f, _, members, required = TOOLS[name]
    if (missing := [k for k in required if k not in arguments]) or (unknown := [k for k in arguments if k not in members]):
        raise TypeError(f"{name}: missing {missing}" if missing else f"{name}: unknown {unknown}")
    return f(memory, as_of, **arguments)


def answer(memory: Memory, message: dict, as_of: str) -> dict | None:
    """The response to one JSON-RPC message; None for a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "engramix", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": listing()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    if params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"no tool {params.get('name')}"}}
    try:
        text, failed = call(memory, params["name"], params.get("arguments") or {}, as_of), False
    except Exception as e:  # a tool's failure is an answer, not the end of the server
        text, failed = f"{type(e).__name__}: {e}"[:500], True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(memory: Memory, source: TextIO = sys.stdin, sink: TextIO = sys.stdout, now: Callable[[], str] | None = None) -> None:
    """Answer lines until the input ends."""
    now = now or (lambda: datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            out = answer(memory, message, now()) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        if out is not None:
            sink.write(json.dumps(out) + "\n")
            sink.flush()
