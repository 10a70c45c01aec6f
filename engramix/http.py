"""The memory as an HTTP service on the standard library. `answer` is the whole of it; `serve` only carries bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone
from email import policy
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from engramix.memory import Memory
from engramix.operators import ingest
from engramix.plans import service
from engramix.vocabulary import ROLES


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


ROUTES: list[tuple[str, re.Pattern, int, Callable]] = []
WORKSPACE = "/v3/workspaces/{w}"


def route(method: str, path: str, status: int = 200):
    def put(f):
        ROUTES.append((method, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + r"/?\Z"), status, f))
        return f

    return put


def answer(memory: Memory, method: str, path: str, body: dict | list | None, as_of: str) -> tuple[int, dict | list]:
    """Status and JSON answer of one request."""
    url = urlsplit(path)
    query = {k: v[-1] for k, v in parse_qs(url.query).items()}
    for verb, pattern, status, f in ROUTES:
        m = pattern.match(url.path)
        if verb == method and m:
            try:
                return status, f(memory, body or {}, query, as_of, **{k: unquote(v) for k, v in m.groupdict().items()})
            except Refused as r:
                return r.status, {"detail": str(r)}
            except (KeyError, TypeError, ValueError) as e:
                return 422, {"detail": f"{type(e).__name__}: {e}"}
    return 404, {"detail": "no such path"}


def _frame(memory: Memory, rows: list, schema: str):
    return memory.spark.createDataFrame(rows, schema)


def _thing(name: str, w: str | None, as_of: str, body: dict, **more) -> dict:
    out = {"id": name, "metadata": body.get("metadata") or {}, "configuration": body.get("configuration") or {}, "created_at": as_of}
    return out | ({"workspace_id": w} if w else {}) | more


def _facts(context) -> list[dict]:
    return [{"subject": r["s"], "predicate": r["p"], "object": r["o"], "confidence": r["conf"], "score": r["score"], "why_retrieved": r["why"].split(",") if r["why"] else []} for r in context.facts.collect()]


@route("GET", "/health")
def health(memory, body, query, as_of):
    return {"status": "ok", "version": memory.store.manifest()["version"]}


@route("POST", "/v3/workspaces", 201)
def create_workspace(memory, body, query, as_of):
    memory.open_session(f"ws:{body['id']}", as_of)
    return _thing(body["id"], None, as_of, body)


@route("GET", WORKSPACE)
def get_workspace(memory, body, query, as_of, w):
    return _thing(w, None, as_of, {})


@route("GET", WORKSPACE + "/conflicts")
def conflicts(memory, body, query, as_of, w):
    limit = int(query.get("limit", 100))
    rows = service.conflict_report(memory.store.table("edges")).orderBy("kind", "fact1", "fact2").limit(limit).collect()
    return {"conflicts": [r.asDict() for r in rows]}


def _register(memory, w, pairs, as_of):
    rows = [(i, w, p, m.get("role"), json.dumps(m)) for i, (p, m) in enumerate(pairs)]
    if any(r[3] not in (None, *ROLES) for r in rows):
        raise ValueError("unknown role")
    memory.register_peers(_frame(memory, rows, "pos int, workspace_id string, id string, role string, metadata string"), as_of)


def _peer(memory, w, p):
    row = memory.store.table("peers").filter((F.col("workspace_id") == w) & (F.col("id") == p)).first()
    if row is None:
        raise Refused(404, "no such peer")
    return row


@route("POST", WORKSPACE + "/peers", 201)
def create_peer(memory, body, query, as_of, w):
    _register(memory, w, [(body["id"], body.get("metadata") or {})], as_of)
    return _thing(body["id"], w, as_of, body)


@route("GET", WORKSPACE + "/peers/{p}")
def get_peer(memory, body, query, as_of, w, p):
    return _thing(p, w, str(_peer(memory, w, p)["registered_at"]), {"metadata": json.loads(_peer(memory, w, p)["metadata"] or "{}")})


@route("POST", WORKSPACE + "/sessions", 201)
def create_session(memory, body, query, as_of, w):
    memory.open_session(body["id"], as_of)
    if body.get("peer_names"):
        _register(memory, w, [(p, m if isinstance(m, dict) else {}) for p, m in body["peer_names"].items()], as_of)
    return _thing(body["id"], w, as_of, body, is_active=True)


@route("GET", WORKSPACE + "/sessions/{s}")
def get_session(memory, body, query, as_of, w, s):
    row = memory.store.table("sessions").filter(F.col("session_id") == s).first()
    if row is None:
        raise Refused(404, "no such session")
    return _thing(s, w, str(row["started_at"]), {}, is_active=row["ended_at"] is None)


@route("POST", WORKSPACE + "/sessions/{s}/messages", 201)
def add_messages(memory, body, query, as_of, w, s):
    rows = [(s, i, m["peer_id"], m["content"]) for i, m in enumerate(body["messages"])]
    if rows:
        memory.add_messages(_frame(memory, rows, "session_id string, pos int, peer_id string, content string"), w, as_of)
    return {"added": len(rows)}


@route("POST", WORKSPACE + "/sessions/{s}/messages/upload", 201)
def upload_file(memory, body, query, as_of, w, s):
    """A file as one message of a peer: the form fields peer_id and file; bytes that are no UTF-8 become replacement characters."""
    memory.add_messages(_frame(memory, [(s, 0, body["peer_id"], body["file"])], "session_id string, pos int, peer_id string, content string"), w, as_of)
    return {"added": 1}


def form(content_type: str, data: bytes) -> dict[str, str]:
    """The fields of a multipart form, files as their text."""
    message = BytesParser(policy=policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + data)
    if not message.is_multipart():
        raise ValueError("the body is no form")
    fields = {p.get_param("name", header="content-disposition"): p.get_payload(decode=True) for p in message.iter_parts()}
    return {k: v.decode("utf-8", "replace") for k, v in fields.items() if k}


@route("POST", WORKSPACE + "/sessions/{s}/messages/list")
def list_messages(memory, body, query, as_of, w, s):
    number, size = int(body.get("page", 1)), int(body.get("size", 50))
    rows, total, pages = service.message_page(memory.store.table("messages"), s, number, size)
    items = [{"id": f"msg_{r['id']}", "content": r["content"], "peer_id": r["peer_id"] or r["role"], "session_id": s, "workspace_id": w, "metadata": {}, "created_at": str(r["created_at"]), "token_count": r["token_count"]} for r in rows.collect()]
    return {"items": items, "total": total, "page": number, "size": size, "pages": pages}


@route("POST", WORKSPACE + "/sessions/{s}/search")
def search(memory, body, query, as_of, w, s):
    """Over the whole memory; the session only names who asks."""
    return [r.asDict() for r in service.search(memory.augment(body["query"], as_of), int(body.get("limit", 10))).collect()]


@route("GET", WORKSPACE + "/sessions/{s}/context")
def session_context(memory, body, query, as_of, w, s):
    text, last, roles = service.session_context(memory.store.table("sessions"), memory.store.table("messages"), s, memory.note("MEMORY.md"))
    said = [{"id": f"msg_{r['id']}", "role": r["role"], "content": r["content"]} for r in last.collect()]
    return {"id": s, "summary": {"content": text, "summary_type": "short"} if text else None, "messages": said, "peers": roles, "peer_representation": memory.note("USER.md")}


@route("POST", WORKSPACE + "/sessions/{s}/peers")
def add_peers(memory, body, query, as_of, w, s):
    found = ingest.parsed_peers(_frame(memory, [(w, json.dumps(body))], "workspace_id string, raw string"))
    memory.register_peers(found, as_of)
    return {"added": found.count()}


@route("GET", WORKSPACE + "/sessions/{s}/peers/{p}/config")
def peer_config(memory, body, query, as_of, w, s, p):
    row = ingest.peer_config(memory.store.table("peers").filter((F.col("workspace_id") == w) & (F.col("id") == p))).first()
    return {"observe_me": row["observe_me"] if row else True, "observe_others": row["observe_others"] if row else True}


@route("GET", WORKSPACE + "/peers/{p}/card")
def peer_card(memory, body, query, as_of, w, p):
    return {"peer_card": [x for x in memory.note("USER.md").splitlines() if x.startswith("- ")]}


@route("GET", WORKSPACE + "/peers/{p}/context")
def peer_context(memory, body, query, as_of, w, p):
    out = {"id": p, "workspace_id": w, "representation": memory.note("USER.md"), "results": []}
    if query.get("search_query"):
        found = service.peer_context(memory.augment(query["search_query"], as_of), memory.store.table("messages"), memory.store.table("chunks"))
        out["results"] = [{"role": r["role"], "content": r["content"]} for r in found.collect()]
    return out


@route("POST", WORKSPACE + "/peers/{p}/representation")
def representation(memory, body, query, as_of, w, p):
    memory.put_note("USER.md", str(body.get("content", "")))
    return {"id": p, "workspace_id": w, "content": body.get("content", ""), "updated_at": as_of}


@route("POST", WORKSPACE + "/peers/{p}/chat")
def chat(memory, body, query, as_of, w, p):
    asked = body.get("queries") or [body.get("query", "")]
    contexts = [(q, memory.augment(q, as_of)) for q in asked]
    return {"content": "\n\n".join(service.chat(c) for _, c in contexts), "results": [{"query": q, "facts": _facts(c)} for q, c in contexts]}


def serve(memory: Memory, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self):
            size = int(self.headers.get("Content-Length") or 0)
            try:
                data, kind = self.rfile.read(size), self.headers.get("Content-Type") or ""
                body = (form(kind, data) if kind.startswith("multipart/") else json.loads(data)) if size else None
                now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
                status, out = answer(memory, self.command, self.path, body, now)
            except ValueError:
                status, out = 400, {"detail": "the body is neither JSON nor a form"}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _run

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
