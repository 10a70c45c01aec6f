"""Decay on partial mentions, reason codes, the text index, the lock, start-up, tools, forms and hosted models."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from engramix import http, startup, tools
from engramix.clients import Request, StubEmbedder, StubLLM, embed
from engramix.functions import text as T
from engramix.hosted import HostedEmbedder, HostedLLM
from engramix.memory import Memory
from engramix.operators import graph, index, retrieval
from engramix.plans import augment
from engramix.sources.store import SCHEMAS, MemoryStore

NOW = "2024-05-01 00:00:00"


def edges(spark, *rows):
    """(s, p, o, pos, neg, days ago)"""
    return spark.createDataFrame(rows, "s string, p string, o string, pos long, neg long, days int").selectExpr("s", "p", "o", "pos", "neg", *[f"timestamp_ntz'{NOW}' - make_dt_interval(days) AS {c}" for c in ("first_seen", "last_seen", "last_reinforced")], "'active' AS status", "false AS derived")


def test_decay_sees_mentions_beside_evidence_that_mentions_nothing(spark):
    e = edges(spark, ("a", "uses", "b", 1, 0, 90), ("c", "uses", "d", 1, 0, 90))
    chunks = spark.sql(f"select * from values ('c1'), ('c2'), ('c3') t(chunk_id)").selectExpr("chunk_id", f"timestamp_ntz'{NOW}' - interval 1 day AS created_at")
    ev = spark.createDataFrame([("a", "uses", "b", "c1", 1), ("c", "uses", "d", "c3", 1)], "s string, p string, o string, chunk_id string, polarity int")
    mentions = spark.createDataFrame([("c2", "a"), ("c3", "c"), ("c3", "d")], "chunk_id string, entity string")
    got = {r["s"]: r["neg"] for r in graph.decay(e, mentions, chunks, ev, NOW).collect()}
    assert got == {"a": 1, "c": 0}


def test_reason_codes(spark):
    e = edges(spark, ("atta_van_west", "prefers", "dutch", 3, 0, 1), ("medflow", "part_of", "atta_projects", 3, 0, 1), ("medflow", "uses", "uv", 3, 0, 40))
    none = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS} | {"edges": e, "aliases": spark.createDataFrame([("atta", "atta_van_west")], SCHEMAS["aliases"])}
    facts = {r["o"]: r for r in augment.augment(none.__getitem__, "tell me about atta", NOW).facts.collect()}
    direct, overlap = facts["dutch"]["why"].split(","), facts["atta_projects"]["why"].split(",")
    assert direct == ["fallback:entity_anchored", "recency_1d", "entity_match"]
    assert overlap == ["fallback:entity_anchored:overlap", "overlap_via:atta", "recency_1d", "entity_match"]
    assert facts["atta_projects"]["score"] == pytest.approx(facts["dutch"]["score"] / 2)
    seeded = augment.augment(none.__getitem__, "hello there", NOW).facts.collect()
    assert {r["why"] for r in seeded} == {"fallback:recency,recency_1d", "fallback:recency"}


def test_index_finds_what_a_scan_finds(spark):
    texts = ["Deployments are deployed daily", "nothing", "we deploy; deploying déployé", "", None, "passwords and a password"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for query in ("deployment passwords", "zebra", ""):
        scan = [(r["id"], round(r["score"], 9)) for r in retrieval.bm25(docs, T.search_words(query), 5, stemmed=True).collect()]
        found = [(r["id"], round(r["score"], 9)) for r in index.bm25_indexed(index.postings(docs, "id"), index.lengths(docs, "id"), "id", query, 5).collect()]
        assert scan == found


def test_a_cycle_keeps_the_index_in_step(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "s"), StubLLM(), notes=str(tmp_path))
    m.log(spark.createDataFrame([("s", 0, "user", "I prefer tabs over spaces in every file")], "session_id string, pos int, role string, content string"), NOW)
    m.dream(NOW)
    m.log(spark.createDataFrame([("s", 0, "user", "We use uv for all python tooling today")], "session_id string, pos int, role string, content string"), NOW)
    m.dream(NOW)
    ids = {r["chunk_id"] for r in m.store.table("chunks").collect()}
    assert len(ids) == 2 and {r["chunk_id"] for r in m.store.table("lengths").collect()} == ids == {r["chunk_id"] for r in m.store.table("postings").collect()}
    assert m.store.table("lengths").count() == 2
    assert ["tabs" in r["text"] for r in m.augment("which spaces?", NOW).passages.collect()] == [True]


def test_lock_goes_to_one_and_is_kept_by_renewal(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    assert s.acquire("a", 0) and s.renew("a", 250) and not s.acquire("b", 400) and s.acquire("b", 600)
    assert not s.renew("a", 601) and s.renew("b", 602)
    s.release("a")
    assert not s.acquire("c", 603) and s.clear_lock() and not s.clear_lock()
    won = []
    runs = [threading.Thread(target=lambda k=k: won.append(k) if MemoryStore(spark, str(tmp_path)).acquire(k) else None) for k in "defg"]
    [t.start() for t in runs]
    [t.join() for t in runs]
    assert len(won) == 1


def test_failed_embeddings_cost_their_batch_only(spark):
    class Picky(StubEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().embed(texts)

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(8)], "id int, text string").coalesce(1)
    assert {r["id"] for r in embed(rows, Picky(), "text", at_a_time=2).collect()} == {0, 1, 4, 5, 6, 7}


def test_vectors_are_made_anew_for_another_dimension(spark, tmp_path):
    m = Memory(spark, str(tmp_path), StubLLM({"lasting facts": json.dumps([{"subject": "a", "predicate": "uses", "object": "b"}])}), StubEmbedder(16))
    m.log(spark.createDataFrame([("s", 0, "user", "We use uv for all python tooling now.")], "session_id string, pos int, role string, content string"), NOW)
    for dim in (16, 8):
        m.embedder = StubEmbedder(dim)
        m.dream(NOW)
        for name in ("chunk_vectors", "edge_vectors"):
            assert [(r["dim"], len(r["v"])) for r in m.store.table(name).collect()] == [(dim, dim)]


def test_tools_over_lines(spark, tmp_path):
    llm = StubLLM({"lasting facts": json.dumps([{"subject": "local_dev", "predicate": "uses", "object": "uv"}])})
    m = Memory(spark, str(tmp_path / "s"), llm, notes=str(tmp_path))
    turns = json.dumps([{"role": "user", "content": "We use uv for all python tooling now."}, {"role": "assistant", "content": "Fine."}, {"role": "weird", "content": "x"}, {"role": "user", "content": ""}])
    ask = lambda i, name, **args: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    lines = [
        json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}),
        json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"}), ask(2, "memory_capture", session_id="a", messages=turns), ask(3, "memory_augment", message="what about uv?"),
        ask(4, "memory_capture", session_id="a", messages="not json"), ask(5, "memory_alias", surface="UV tool", canonical="uv"), ask(6, "memory_retract", subject="local_dev", predicate="uses", object="uv tool"),
        ask(7, "memory_retract", subject="x", predicate="uses", object="y"), ask(8, "memory_log", session_id="b", role="user", content="hi"), ask(9, "nothing"), ask(10, "memory_profile"), ask(11, "memory_log"), "{", ask(12, "memory_dream"),
    ]
    out = io.StringIO()
    tools.serve(m, lines, out, lambda: NOW)
    got = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    text = lambda i: got[i]["result"]["content"][0]["text"]
    assert len(got[1]["result"]["tools"]) == 7 and got[0]["result"]["capabilities"] == {"tools": {}}
    assert text(2).startswith("logged 2 turns of session 'a'; consolidated 1 of 1 chunks, 1 triples") and "local_dev uses uv" in text(3)
    assert text(4).startswith("error:") and text(6) == "retracted" and text(7) == "no matching active edge" and text(8) == "logged"
    assert "error" in got[9] and text(10) and got[11]["result"]["isError"] and got[None]["error"]["code"] == -32700 and "consolidated" in text(12)


def test_uploaded_form(spark, tmp_path):
    m = Memory(spark, str(tmp_path), StubLLM())
    body = http.form("multipart/form-data; boundary=b", b'--b\r\nContent-Disposition: form-data; name="peer_id"\r\n\r\nagent-7\r\n--b\r\nContent-Disposition: form-data; name="file"; filename="n.md"\r\n\r\nline\xff\r\n--b--\r\n')
    assert http.answer(m, "POST", "/v3/workspaces/w/sessions/s/messages/upload", body, NOW) == (201, {"added": 1})
    assert [(r["role"], r["content"]) for r in m.store.table("messages").collect()] == [("assistant", "line�")]


@pytest.fixture
def endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/v1/embeddings":
                out = {"data": [{"index": i, "embedding": [len(t), 1, 0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                out = {"choices": [{"message": {"content": f"{body['model']}:{body['messages'][1]['content']}:{self.headers['Authorization']}"}}]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_hosted_models_and_startup(spark, tmp_path, endpoint):
    assert HostedLLM("k", endpoint, "m").complete(Request("triples", "s", "u")) == "m:u:Bearer k"
    e = HostedEmbedder("k", endpoint, "m")
    assert e.embed(["a", "bbb"]) == [[1.0, 1.0, 0.0], [3.0, 1.0, 0.0]] and e.dim == 3
    env = {"ENGRAMIX_ROOT": str(tmp_path), "OPENAI_API_KEY": "k", "ENGRAMIX_LLM_BASE_URL": endpoint, "ENGRAMIX_EMBEDDING_BASE_URL": endpoint}
    s = startup.Settings.resolve(env)
    assert s.embedding_key == "k" and startup.Settings.resolve({}).llm_key is None
    with pytest.raises(RuntimeError, match="no key"):
        startup.build(spark, startup.Settings.resolve({"ENGRAMIX_ROOT": str(tmp_path)}))
    MemoryStore(spark, f"{tmp_path}/store").acquire("crashed")
    m = startup.build(spark, s)
    assert m.store.acquire("now") and m.embedder is not None
    startup.set_instance(m)
    assert startup.instance(spark) is m
    startup.set_instance(None)
    assert {c: state for c, state, _ in startup.preflight(spark, s)} == {"root": "ok", "model": "ok", "embeddings": "ok", "schema": "ok", "dimension": "ok", "tables": "ok"}
    off = startup.Settings.resolve({"ENGRAMIX_ROOT": str(tmp_path)})
    assert {c: state for c, state, _ in startup.preflight(spark, off)} == {"root": "ok", "model": "fail", "embeddings": "warn", "schema": "ok", "dimension": "ok", "tables": "ok"}
