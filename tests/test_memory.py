"""The store, ingestion, a whole dream cycle and what is asked of it afterwards."""

import json

import pytest
from pyspark.sql import functions as F

from engramix import clients
from engramix.functions import stem
from engramix.functions.ranking import numbered
from engramix.memory import Memory
from engramix.operators import ingest, narrative, retrieval
from engramix.plans import service
from engramix.plans.dream import Config
from engramix.sources import store as stores
from engramix.streaming.sessions import chunk_stream

T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("sensibiliti", "sensibl"), ("filing", "file"), ("is", "is")])
def test_stem(word, root):
    assert stem.stem(word) == root


def test_stem_keeps_the_opening():
    for w in ("possibilities", "happily", "organizations", "relativity", "analyses", "skies", "abilities", "dying", "operational", "apologies", "hoped", "rating"):
        s = stem.stem(w)
        assert w.startswith(s[: max(1, len(s) - 2)])


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "She was Deploying things"), (2, "deployment déployed"), (3, "nothing"), (4, None), (5, "")], "id long, text string")
    assert {r["id"] for r in retrieval.bm25(docs, "deploys", 5, stemmed=True).collect()} == {1, 2}
    assert retrieval.bm25(docs, "??", 5, stemmed=True).count() == 0 and retrieval.bm25(docs, "??", 5).count() == 0


def test_stemmed_search_against_brute_force(spark):
    import math
    import re

    texts = ["Deployments were connected", "a connection to passwords and passwords", "no words here", "Déployment, déployé: CONNECT!", "and and and", "deploy"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bags = [[stem.stem(w) for w in re.findall(r"[^\W_]+", stem.plain(t))] for t in texts]
    mean, want = sum(map(len, bags)) / len(bags), {}
    for t in stem.terms("deployments and connected passwords"):
        df = sum(t in b for b in bags)
        for i, b in enumerate(bags):
            if (tf := b.count(t)):
                want[i] = want.get(i, 0) - math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, "deployments and connected passwords", 100, stemmed=True).collect()}
    assert got == pytest.approx(want)


def test_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = [r["n"] for r in numbered(df, "n", "k", "id", start=5).orderBy("k", "id").collect()]
    assert got == list(range(5, 1005))
    assert numbered(df.limit(0), "n", "k").count() == 0


def test_store_commits_whole_versions(spark, tmp_path):
    s = stores.MemoryStore(spark, str(tmp_path / "m"))
    one = spark.createDataFrame([("a", "b")], "alias string, canonical string")
    assert s.commit(append={"aliases": one}) == 1 and s.commit(append={"aliases": one}) == 2
    assert (s.table("aliases").count(), s.table("aliases", 1).count(), s.table("edges").count()) == (2, 1, 0)
    s.compact("aliases")
    assert s.vacuum() == 2 and s.table("aliases").count() == 2
    assert s.acquire("x", 0) and not s.acquire("y", 10) and s.acquire("y", 1000)
    s.release("x")
    assert not s.acquire("z", 1001)
    other = stores.MemoryStore(spark, str(tmp_path / "m"))
    behind = other.manifest()
    s.commit(append={"aliases": one})
    other.manifest = lambda version=None: behind
    with pytest.raises(stores.Conflict):
        other.commit(append={"aliases": one})


def test_a_newer_schema_is_refused(spark, tmp_path, monkeypatch):
    stores.MemoryStore(spark, str(tmp_path)).commit()
    monkeypatch.setattr(stores, "SCHEMA_VERSION", 5)
    with pytest.raises(RuntimeError):
        stores.MemoryStore(spark, str(tmp_path))


def test_capture_drops_what_is_no_turn(spark):
    raw = json.dumps([{"role": "user", "content": "a"}, {"role": "robot", "content": "b"}, {"role": "user", "content": " "}, {"role": "tool", "content": "c"}, {"role": "user", "content": 5}, 7])
    turns, errors = ingest.captured_turns(spark.createDataFrame([("s", raw), ("t", "{"), ("u", "{}"), ("v", None)], "session_id string, raw string"))
    assert sorted(r["content"] for r in turns.collect()) == ["a", "c"]
    assert sorted(r["error"] for r in errors.collect()) == ["invalid JSON", "invalid JSON", "not a JSON array"]


def test_unknown_roles_fail(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    turns = spark.createDataFrame([("s", 1, "robot", "x")], "session_id string, pos int, role string, content string")
    with pytest.raises(Exception, match="unknown role"):
        m.log(turns, T1)
    assert m.store.versions() == []


def test_peers(spark):
    none = spark.createDataFrame([], stores.SCHEMAS["peers"])
    bodies = spark.createDataFrame([("w", '{"agent-1": {"observe_me": false}, "user-2": {"role": "tool"}}'), ("w", '["bot-3", {"id": "x"}]')], "workspace_id string, raw string")
    peers = ingest.register_peers(none, ingest.parsed_peers(bodies), T1)
    assert {r["id"]: r["role"] for r in peers.collect()} == {"agent-1": "assistant", "user-2": "tool", "bot-3": "assistant", "x": "user"}
    assert {r["id"]: r["observe_me"] for r in ingest.peer_config(peers).collect()} == {"agent-1": False, "user-2": True, "bot-3": True, "x": True}
    turns = spark.createDataFrame([("s", 1, "user-2", "hi"), ("s", 2, "agent-9", "yo")], "session_id string, pos int, peer_id string, content string")
    assert [r["role"] for r in ingest.resolved_roles(turns, peers, "w").orderBy("pos").collect()] == ["tool", "assistant"]


def test_upload_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"ok \xff")
    m = Memory(spark, str(tmp_path / "m"))
    assert m.upload(str(tmp_path / "f.txt"), "s", T1) == 1
    assert m.store.table("messages").first()["content"] == "ok �"


def test_embedding_cache_asks_once():
    asked = []

    class Inner(clients.StubEmbedder):
        def embed(self, texts):
            asked.append(list(texts))
            return super().embed(texts)

    e = clients.CachedEmbedder(Inner(), size=2)
    e.embed(["a", "a", "b"])
    e.embed(["a"])
    e.embed(["c"])
    e.embed(["b"])
    assert asked == [["a", "b"], ["c"], ["b"]]
    with pytest.raises(LookupError):
        clients.StubLLM(default=None).complete(clients.Request("x", "", ""))


def test_session_text_is_cut(spark):
    m = spark.createDataFrame([("s", i, "user", "x" * 10) for i in range(5)], "session_id string, id long, role string, content string")
    text = narrative.session_text(m, 25).first()["text"]
    assert text == ("user: " + "x" * 10 + "\n") + "user: xx" and len(text) == 25


TRIPLES = json.dumps([
    {"subject": "Billing Service", "predicate": "depends_on", "object": "Postgres", "subject_type": "service"},
    {"subject": "Postgres", "predicate": "depends_on", "object": "Local Disk"}, {"subject": "x", "predicate": "eats", "object": "y"},
])
FIXTURES = {
    "lasting facts": TRIPLES, "own ways of working": json.dumps([{"kind": "preference", "statement": "likes pnpm"}]),
    "name the episodes": json.dumps([{"title": "Deploying", "summary": "They deployed billing", "outcome": "ok", "key_entities": ["billing"]}, {"title": "", "summary": "x"}]),
    "Sum it up": '"A talk about billing and databases."', "procedures that could": json.dumps([{"name": "Deploy", "steps": [{"order": 2, "action": "push"}, {"order": 1, "action": "build"}]}]),
}


@pytest.fixture(scope="module")
def dreamt(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("memory")
    m = Memory(spark, str(root / "m"), clients.StubLLM(FIXTURES), clients.StubEmbedder(), str(root / "notes"))
    rows = [("s1", 1, "assistant", "Shall I use npm?"), ("s1", 2, "user", "No, actually the Billing Service depends on Postgres."), ("s1", 3, "user", "ok")]
    m.log(spark.createDataFrame(rows, "session_id string, pos int, role string, content string"), T1)
    return m, m.dream(T2)


def test_dream_cycle(spark, dreamt):
    m, report = dreamt
    t = m.store.table
    assert (report.counts["chunks_processed"], report.counts["triples"], report.counts["derived"]) == (1, 2, 1)
    assert {(r["s"], r["o"], r["derived"]) for r in t("edges").collect()} == {("billing_service", "postgres", False), ("postgres", "local_disk", False), ("billing_service", "local_disk", True)}
    assert t("sessions").first()["summary"] == "A talk about billing and databases."
    assert [r["title"] for r in t("episodes").collect()] == ["Deploying"]
    assert [s["action"] for s in t("procedures").first()["steps"]] == ["build", "push"]
    assert {r["entity"] for r in t("mentions").collect()} == {"billing_service", "postgres", "local_disk"}
    assert t("edge_vectors").count() == 3 and t("chunk_vectors").first()["dim"] == 16
    assert "likes pnpm" in m.note("USER.md")


def test_augment_and_service(spark, dreamt):
    m, _ = dreamt
    c = m.augment("what does the Billing Service depend on", T2)
    assert c.routed == ["depends_on"]
    assert {r["entity"] for r in c.entities.filter("via = 'matched'").collect()} == {"billing_service"}
    assert c.passages.count() == 1 and c.passages.first()["score_kind"] == "rrf"
    assert c.episodes.count() == 1 and c.facts.count() == 3
    kinds = [r["kind"] for r in service.search(c, 10).collect()]
    assert kinds == ["fact"] * 3 + ["passage"] and service.search(c, 2).count() == 2
    assert [r["role"] for r in service.peer_context(c, m.store.table("messages"), m.store.table("chunks")).collect()][0] == "assistant"
    assert "billing_service depends on postgres" in service.chat(c)
    text, last, roles = service.session_context(m.store.table("sessions"), m.store.table("messages"), "s1")
    assert text.startswith("A talk") and last.count() == 3 and roles == ["assistant", "user"]
    rows, total, pages = service.message_page(m.store.table("messages"), "s1", 1, 2)
    assert (rows.count(), total, pages) == (2, 3, 2)
    assert all(r["ok"] for r in service.doctor(m.store.table, 16).collect())


def test_a_second_cycle_adds_nothing_and_corrections_hold(spark, dreamt):
    m, _ = dreamt
    again = m.dream(T2)
    assert again.counts["chunks_processed"] == 0 and m.store.table("edges").filter("NOT derived").agg(F.max("pos")).first()[0] == 1
    assert m.retract("Billing Service", "depends_on", "postgres", T2) and not m.retract("Billing Service", "depends_on", "postgres", T2)
    assert m.store.table("feedback").first()["s"] == "Billing Service"
    m.merge("postgresql", "postgres")
    assert m.store.table("edges").filter("s = 'postgres' OR o = 'postgres'").count() == 0
    m.store.acquire("someone")
    assert m.dream(T2).skipped
    m.store.release("someone")
    assert m.recent_runs().count() == 3


def test_failed_answers_come_again(spark, tmp_path):
    class Broken:
        def complete(self, request):
            raise TimeoutError("slow")

    m = Memory(spark, str(tmp_path / "m"), Broken())
    m.log(spark.createDataFrame([("s", 1, "user", "I prefer uv over pip")], "session_id string, pos int, role string, content string"), T1)
    assert m.dream(T2).counts["chunks_processed"] == 0
    m.llm = clients.StubLLM(FIXTURES)
    assert m.dream(T2, config=Config(budget=1)).counts["chunks_processed"] == 1


def test_chunk_stream_carries_state(spark, tmp_path):
    schema = "session_id string, id long, role string, content string, created_at timestamp"
    at = F.expr("timestamp'2024-01-01 00:00:00'")
    put = lambda rows: spark.createDataFrame(rows, "session_id string, id long, role string, content string").withColumn("created_at", at).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("s", 1, "assistant", "Use npm.")])
    got = []
    stream = chunk_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = lambda: stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    put([("s", 2, "user", "No, actually pnpm.")])
    run()
    assert [(r["start_message_id"], r["text"]) for r in got] == [(1, "assistant: Use npm.\nuser: No, actually pnpm.")]


def test_a_followed_stream_counts_once(spark, tmp_path):
    schema = "session_id string, pos int, role string, content string"
    m = Memory(spark, str(tmp_path / "m"), clients.StubLLM(FIXTURES))
    spark.createDataFrame([("s", 1, "user", "We use Postgres for the Billing Service.")], schema).write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    m.follow(turns, "chat", str(tmp_path / "c"), lambda: T2, None).awaitTermination(180)
    assert m.store.table("messages").count() == 1 and m.store.table("edges").count() == 3
    batch = spark.createDataFrame([("s", 1, "user", "x")], schema)
    assert m.log(batch, T2, ("chat", 0)) == 0 and m.store.table("messages").count() == 1


def test_http(spark, dreamt):
    import threading
    import urllib.request

    from engramix import http

    m, _ = dreamt
    ask = lambda verb, path, body=None: http.answer(m, verb, path, body, T2)
    w = "/v3/workspaces/w"
    assert ask("POST", "/v3/workspaces", {"id": "w"})[0] == 201
    assert ask("POST", w + "/peers", {"id": "agent-7"})[0] == 201
    assert ask("GET", w + "/peers/agent-7")[0] == 200 and ask("GET", w + "/peers/nobody")[0] == 404
    assert ask("POST", w + "/sessions", {"id": "web"})[0] == 201 and ask("GET", w + "/sessions/none")[0] == 404
    assert ask("POST", w + "/sessions/web/messages", {"messages": [{"peer_id": "agent-7", "content": "hi"}, {"peer_id": "user-1", "content": "hello there"}]}) == (201, {"added": 2})
    page = ask("POST", w + "/sessions/web/messages/list", {"page": 2, "size": 1})[1]
    assert (page["total"], page["pages"], page["items"][0]["token_count"]) == (2, 2, 2)
    assert ask("POST", w + "/sessions/web/messages/list", {"size": 0})[0] == 422
    assert ask("POST", w + "/sessions/web/peers", {"peers": [{"id": "z", "metadata": {"observe_me": False}}]})[1] == {"added": 1}
    assert ask("GET", w + "/sessions/web/peers/z/config")[1] == {"observe_me": False, "observe_others": True}
    assert len(ask("POST", w + "/sessions/web/search", {"query": "where is the local disk", "limit": 5})[1]) >= 1
    assert ask("GET", w + "/sessions/web/context")[1]["peers"] == ["assistant", "user"]
    assert ask("GET", w + "/peers/z/context?search_query=local%20disk")[1]["results"]
    assert ask("POST", w + "/peers/z/chat", {"query": "local disk"})[1]["results"][0]["facts"]
    assert ask("GET", w + "/conflicts")[1] == {"conflicts": []}
    assert ask("POST", w + "/peers/z/representation", {"content": "likes tea"})[0] == 200 and m.note("USER.md") == "likes tea"
    assert ask("GET", "/nowhere")[0] == 404
    server = http.serve(m, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=60) as r:
        assert json.load(r)["status"] == "ok"
    server.shutdown()
