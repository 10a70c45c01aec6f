"""The store under several writers: nothing is lost, nothing is seen half, one holds the lock; and what a cycle writes."""

import json
import os
import random
import threading

import pytest

from engramix import clients
from engramix.memory import Memory
from engramix.functions.ranking import first_rows
from engramix.operators import chunking, consolidation, graph
from engramix.sources import store as stores
from engramix.sources.store import Conflict, MemoryStore

NOW = "2024-05-01 00:00:00"
EDGE = "s string, p string, o string, pos long, neg long, status string, last_seen string"
TURN = "session_id string, pos int, role string, content string"


def run_all(jobs):
    threads = [threading.Thread(target=j) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]


def test_one_of_many_creates_and_content_is_whole(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    for k in range(50):
        path, won, seen = f"{tmp_path}/_log/{k}", [], []
        text = str(k) * 10_000

        def read():
            for _ in range(20):
                if os.path.exists(path):
                    seen.append(open(path).read())

        run_all([lambda i=i: won.append(i) if s._create(path, text) else None for i in range(6)] + [read])
        assert len(won) == 1 and set(seen) <= {text}
    assert not [n for n in os.listdir(tmp_path / "_log") if n.startswith(".")]


def test_lock_goes_to_one_of_many_each_time(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    for k in range(15):
        won = []
        run_all([lambda n=n: won.append(n) if MemoryStore(spark, str(tmp_path)).acquire(n, 1000 * k) else None for n in "defgh"])
        assert len(won) == 1


def test_a_late_taker_of_the_lock_fails(spark, tmp_path):
    x, y = MemoryStore(spark, str(tmp_path)), MemoryStore(spark, str(tmp_path))
    old = x.manifest()
    assert y.acquire("y", 10) and y.renew("y", 20)
    real, late = x.manifest, [old]
    x.manifest = lambda version=None: late.pop() if late else real(version)  # it looked before y did
    assert not x.acquire("x", 30) and y.renew("y", 40)
    with pytest.raises(Conflict, match="no longer"):
        x.commit(holder="x")


def test_deltas_are_merged_on_read_and_folded(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    df = lambda *rows: spark.createDataFrame(rows, "alias string, canonical string")
    want, r = {}, random.Random(1)
    for k in range(12):
        put = {f"k{r.randint(0, 9)}": f"v{k}" for _ in range(3)}
        gone = {f"k{r.randint(0, 9)}" for _ in range(2)} - put.keys()
        s.commit(put={"aliases": df(*put.items())}, delete={"aliases": df(*[(g, None) for g in gone])} if gone else None)
        want = {a: b for a, b in (want | put).items() if a not in gone}
        assert dict(map(tuple, s.table("aliases").collect())) == want
        if k == 4:
            s.fold("aliases")
        if k == 8:
            s.compact("aliases")
            assert s.manifest()["deltas"]["aliases"] == []
        assert dict(map(tuple, s.table("aliases").collect())) == want
    seen = s.manifest()
    s.commit(put={"aliases": df(("new", "x"))})
    assert s._swap("aliases", seen, [s._write("aliases", s._state("aliases", seen))], []) and dict(map(tuple, s.table("aliases").collect())) == want | {"new": "x"}
    assert s.tidy(most=0) == ["aliases"] and dict(map(tuple, s.table("aliases").collect())) == want | {"new": "x"}
    with pytest.raises(Conflict):
        s._swap("aliases", seen, [], [])


def test_writers_on_one_version_merge_cell_by_cell(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    df = lambda *rows: spark.createDataFrame(rows, EDGE)
    at = lambda d: f"2024-01-0{d} 00:00:00"
    v = s.commit(put={"edges": df(("a", "uses", "b", 1, 0, "active", at(1)), ("c", "uses", "d", 1, 0, "active", at(1)), ("e", "uses", "f", 1, 0, "active", at(1)), ("g", "uses", "h", 1, 0, "active", at(1)))})
    s.commit(put={"edges": df(("a", "uses", "b", 1, 2, "retracted", at(1)), ("x", "uses", "y", 5, 0, "active", at(3)), ("g", "uses", "h", 2, 0, "active", at(1)))}, delete={"edges": df(("c", "uses", "d", 0, 0, "", at(1)))})
    s.commit(put={"edges": df(("a", "uses", "b", 4, 0, "active", at(2)), ("c", "uses", "d", 9, 0, "active", at(2)), ("e", "uses", "f", 2, 0, "active", at(2)), ("x", "uses", "y", 1, 1, "active", at(2)))}, delete={"edges": df(("g", "uses", "h", 0, 0, "", at(1)))}, base=v)
    got = {r["s"]: (r["pos"], r["neg"], r["status"], str(r["last_seen"])[:10]) for r in s.table("edges").collect()}
    assert got == {"a": (4, 2, "retracted", "2024-01-02"), "e": (2, 0, "active", "2024-01-02"), "x": (6, 1, "active", "2024-01-03"), "g": (2, 0, "active", "2024-01-01")}
    with pytest.raises(Conflict):
        s.commit(put={"edges": df(("e", "uses", "f", 0, 0, "", at(1)))}, base=v, unchanged=["edges"])
    with pytest.raises(Conflict):
        s.commit(replace={"edges": df()}, base=v)


def test_concurrent_logs_and_counters_lose_nothing(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.store.commit(put={"edges": spark.createDataFrame([("a", "uses", "b", 0, 0, "active", NOW)], EDGE)})
    base = m.store.manifest()["version"]
    one = spark.createDataFrame([("a", "uses", "b", 1, 0, "active", NOW)], EDGE)
    run_all([lambda k=k: m.log(spark.createDataFrame([(f"s{k}", i, "user", "x") for i in range(3)], TURN), NOW) for k in range(4)] + [lambda: MemoryStore(spark, str(tmp_path / "m")).commit(put={"edges": one}, base=base) for _ in range(3)])
    ids = [r["id"] for r in m.store.table("messages").collect()]
    assert sorted(ids) == list(range(1, 13)) and m.store.table("sessions").count() == 4 and m.store.table("edges").first()["pos"] == 3


TRIPLES = json.dumps([{"subject": "billing", "predicate": "uses", "object": "postgres"}, {"subject": "shop", "predicate": "uses", "object": "redis"}])




def test_what_others_write_during_a_cycle_survives(spark, tmp_path, monkeypatch):
    m = Memory(spark, str(tmp_path / "m"), clients.StubLLM({"lasting facts": TRIPLES}), clients.StubEmbedder())
    turn = lambda s, text: m.log(spark.createDataFrame([(s, 0, "user", text)], TURN), NOW)
    turn("a", "I prefer that the billing service uses postgres.")
    m.dream(NOW)
    turn("b", "I prefer that the shop uses redis these days.")
    real, reader = consolidation.retired_chunks, []

    def meanwhile(*args):
        m.add_alias("Pg", "postgres")
        m.open_session("late", NOW)
        turn("late", "hello there")
        assert m.retract("billing", "uses", "postgres", NOW)
        reader.append((m.store.table("edges").count(), m.store.table("chunks").count()))
        return real(*args)

    monkeypatch.setattr(consolidation, "retired_chunks", meanwhile)
    m.dream(NOW)
    t = m.store.table
    assert reader == [(2, 1)] and t("chunks").count() == 2
    assert {r["alias"]: r["canonical"] for r in t("aliases").collect()}["pg"] == "postgres"
    assert {r["session_id"] for r in t("sessions").collect()} == {"a", "b", "late"} and t("messages").count() == 3
    edges = {r["s"]: (r["status"], r["pos"]) for r in t("edges").collect()}
    assert edges == {"billing": ("retracted", 2), "shop": ("active", 2)} and t("feedback").count() == 1


def test_a_cycle_that_lost_its_lock_commits_nothing(spark, tmp_path, monkeypatch):
    m = Memory(spark, str(tmp_path / "m"), clients.StubLLM({"lasting facts": TRIPLES}))
    m.log(spark.createDataFrame([("a", 0, "user", "I prefer that billing uses postgres.")], TURN), NOW)
    real = consolidation.retired_chunks
    monkeypatch.setattr(consolidation, "retired_chunks", lambda *a: (m.store.clear_lock(), m.store.acquire("other"), real(*a))[-1])
    with pytest.raises(Conflict):
        m.dream(NOW)
    assert m.store.table("edges").count() == 0 and not m.store.acquire("third")


def folder_bytes(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_cycle_writes_what_it_brings(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), clients.StubLLM({"lasting facts": TRIPLES}))
    r = random.Random(2)
    old = [(f"s{k}", 0, "user", "I prefer " + " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))) for k in range(200)]
    m.log(spark.createDataFrame(old, TURN), NOW)
    m.dream(NOW)
    first = folder_bytes(tmp_path / "m")
    m.log(spark.createDataFrame([("new", 0, "user", "I prefer short ones.")], TURN), NOW)
    before = folder_bytes(tmp_path / "m")
    m.dream(NOW, config=stores_config())
    wrote = sum(n for p, n in folder_bytes(tmp_path / "m").items() if p not in before)
    held = sum(n for p, n in first.items() if "/chunks/" in p or "/postings/" in p or "/messages/" in p)
    assert wrote < held / 2, (wrote, held)


def stores_config():
    from engramix.plans.dream import Config

    return Config(budget=1000)


def test_first_rows_equal_a_sort(spark):
    r = random.Random(3)
    for kind, value in (("long", lambda: r.choice([r.randint(-(1 << 62), 1 << 62), r.randint(0, 5)])), ("string", lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 4))))):
        rows = [(r.choice([None, f"2024-01-0{r.randint(1, 4)} 00:00:0{r.randint(0, 2)}"]), r.choice([None, value()])) for _ in range(300)]
        df = spark.createDataFrame(rows, f"at string, id {kind}").selectExpr("cast(at as timestamp_ntz) AS at", "id").repartition(5)
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] if x[1] is not None else 0))
        for n in (0, 1, 7, 60, 150, 299, 300, 400):
            got = sorted(map(str, ((str(x["at"]) if x["at"] else None, x["id"]) for x in first_rows(df, n, "at", "id").collect())))
            assert got == sorted(map(str, order[:n])), (kind, n)


def test_only_local_folders_and_hdfs(spark, monkeypatch):
    with pytest.raises(Exception):
        MemoryStore(spark, "viewfs://nowhere/x")
    assert stores.KEYS.keys() | {"feedback", "dream_runs"} == stores.SCHEMAS.keys()


def test_pages_of_a_session(spark):
    r = random.Random(4)
    rows = [(i * 7, r.choice("ab"), f"m{i}") for i in range(97)]
    df = spark.createDataFrame(rows, "id long, session_id string, content string").repartition(3)
    mine = sorted(x for x in rows if x[1] == "a")
    got, after = [], None
    for n in range(1, len(mine) // 10 + 3):
        page = [tuple(x) for x in chunking.page(df, "a", n, 10).collect()]
        assert page == mine[10 * n - 10 : 10 * n] == [tuple(x) for x in chunking.page_after(df, "a", after, 10).collect()]
        got += page
        after = page[-1][0] if page else after
    assert got == mine and chunking.page(df, "nobody", 1, 10).count() == 0


def test_competing_objects_of_a_hot_subject_meet_once(spark):
    r = random.Random(5)
    rows = [("hot", "runs_on", f"o{i}", r.randint(0, 3), 1, "active", False) for i in range(150)] + [("s", "runs_on", "x", 1, 0, "active", False), ("s", "runs_on", "y", 1, 0, "active", False), ("lone", "runs_on", "x", 1, 0, "active", False), ("s", "runs_on", "old", 1, 0, "retracted", False)]
    df = spark.createDataFrame(rows, "s string, p string, o string, pos long, neg long, status string, derived boolean")
    one = {tuple(x) for x in graph.competing_objects(df).collect()}
    many = [tuple(x) for x in graph.competing_objects(df, piece=20).collect()]
    assert len(many) == len(set(many)) == 150 * 149 // 2 + 1 and set(many) == one
    assert all(x[3] < x[5] for x in many)


def test_updated_closure_equals_the_full_one(spark):
    r = random.Random(6)
    nodes = "abcdefgh"
    draw = lambda: {(x, y): (r.randint(1, 9), r.randint(0, 3)) for x in nodes for y in nodes if x != y and r.random() < 0.2}
    for _ in range(4):
        old = draw()
        new = {k: v for k, v in old.items() if r.random() < 0.8} | dict(list(draw().items())[:3])
        df = lambda e: spark.createDataFrame([(*k, *v) for k, v in e.items()], "s string, o string, pos long, neg long")
        update = lambda a, b: graph.updated_closure(graph.transitive(df(a)), graph.hops(df(a), 0.15), graph.hops(df(b), 0.15))
        got = update(old, new)
        rows = lambda x: sorted((a, b, round(c, 9)) for a, b, c in x.select("s", "o", "conf").collect())
        assert rows(got) == rows(graph.transitive(df(new)))
    assert rows(update(old, old)) == rows(graph.transitive(df(old)))


def test_cycles_keep_the_closure_in_step(spark, tmp_path):
    say = lambda *pairs: clients.StubLLM({"lasting facts": json.dumps([{"subject": a, "predicate": "depends_on", "object": b} for a, b in pairs])})
    m = Memory(spark, str(tmp_path / "m"), say("ab"))
    for k, pairs in enumerate([("ab", "bc"), ("cd",)]):
        m.llm = say(*pairs)
        m.log(spark.createDataFrame([(f"s{k}", 0, "user", f"I prefer to know what depends on what, {k}.")], TURN), NOW)
        if k:
            assert m.retract("a", "depends_on", "b", NOW)  # no cycle has seen this yet
        m.dream(NOW)
    rows = lambda x: sorted((a, b, round(c, 9)) for a, b, c in x.select("s", "o", "conf").collect())
    assert rows(m.store.table("closure")) == rows(graph.transitive(graph.dependencies(m.store.table("edges")))) != []
    assert {(r["s"], r["o"]) for r in m.store.table("edges").filter("derived").collect()} == {("b", "d")}
