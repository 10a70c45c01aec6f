"""Golden cases of the memory operators, on small frames."""

import pytest
from pyspark.sql import functions as F

from engramix.functions import text as T
from engramix.operators import chunking, consolidation, extraction, graph, retrieval
from engramix.vocabulary import PREDICATES, ROUTES

EDGE = "s string, p string, o string, pos long, neg long, first_seen timestamp_ntz, last_seen timestamp_ntz, last_reinforced timestamp_ntz, status string, derived boolean"


def edges(spark, *rows):
    df = spark.createDataFrame([(*r[:5], "active", False) for r in rows], "s string, p string, o string, pos long, neg long, status string, derived boolean")
    at = F.expr("timestamp_ntz'2024-01-01'")
    return df.withColumns({"first_seen": at, "last_seen": at, "last_reinforced": at})


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "name"), [
    ("The Docker (container)", "docker"), ("Local Dev Environment", "local_dev_environment"), ("Postgres 18", "postgres_18"), ("Café", "cafe"),
    ("de café-server", "cafe_server"), ("MedFlow", "med_flow"), ("FastAPI", "fast_api"), ("JSONParser", "json_parser"), ("XMLHttpRequest", "xml_http_request"), ("API", "api"), ("ﬁle ½", "file_1_2"),
])
def test_normalize(spark, raw, name):
    got = one(spark, raw, T.normalize)
    assert got == name or (raw == "ﬁle ½" and got == "file_12")
    assert one(spark, got, T.normalize) == got


def test_salience_and_roles(spark):
    assert one(spark, "Nee, gebruik uv.", T.salience_reason) == "correction_or_preference_trigger"
    assert one(spark, "We deployed the new build today.", T.salience_reason) == "long_user_turn"
    assert one(spark, "ok", T.salience_reason) is None
    assert [one(spark, p, T.infer_role) for p in ("user-123", "agent-main", "telegram-12345", "ai-bot", "x")] == ["user", "assistant", "user", "assistant", "user"]


def test_routing(spark):
    assert {p for _, ps in ROUTES for p in ps} <= set(PREDICATES)
    assert one(spark, "what does alpha depend on", T.route_predicates) == ["depends_on"]
    assert set(one(spark, "what technologies does it use", T.route_predicates)) == {"runs_on", "uses"}
    assert one(spark, "plain", T.route_predicates) == []


def test_chunks_carry_the_assistant_turn(spark):
    m = spark.createDataFrame([("s", 1, "assistant", "Use npm."), ("s", 2, "user", "No, actually pnpm."), ("s", 3, "user", "ok"), ("s", 4, "user", "a" * 30)], "session_id string, id long, role string, content string").withColumn("created_at", F.lit(0))
    got = chunking.salient_chunks(m).orderBy("end_message_id").collect()
    assert [(r["start_message_id"], r["end_message_id"]) for r in got] == [(1, 2), (1, 4)]
    assert got[0]["text"] == "assistant: Use npm.\nuser: No, actually pnpm."


def test_conflicts(spark):
    e = edges(spark, ("a", "runs_on", "py2", 1, 0), ("a", "runs_on", "py3", 1, 0), ("t", "prefers", "docker", 1, 0), ("t", "rejects", "docker", 1, 0), ("a", "uses", "x", 1, 0), ("a", "uses", "y", 1, 0))
    assert sorted(r["kind"] for r in graph.conflicts(e).collect()) == ["competing_object", "opposing_predicate"]
    assert graph.conflicts(e.withColumn("status", F.lit("retracted"))).count() == 0


def test_retraction_rule(spark):
    e = edges(spark, ("a", "uses", "x", 0, 2), ("a", "uses", "y", 1, 4), ("a", "uses", "z", 2, 4))
    assert {r["o"]: r["status"] for r in graph.auto_retract(e).collect()} == {"x": "retracted", "y": "retracted", "z": "active"}
    m = graph.manual_retract(e, "a", "uses", "z", "2024-02-01")
    assert m.filter("o = 'z'").first()["neg"] == 5
    assert graph.manual_retract(m, "a", "uses", "z", "2024-02-01").filter("o = 'z'").first()["neg"] == 5


def test_upsert_merges_and_revives(spark):
    e = edges(spark, ("a", "uses", "x", 1, 0)).withColumn("status", F.lit("retracted"))
    t = spark.createDataFrame([("a", "uses", "x", 7, 1), ("a", "uses", "new", 7, -1)], "s string, p string, o string, chunk_id long, polarity int").withColumn("ts", F.expr("timestamp_ntz'2024-03-01'"))
    got = {r["o"]: r for r in graph.upsert(e, t).collect()}
    assert (got["x"]["pos"], got["x"]["status"]) == (2, "active")
    assert (got["new"]["neg"], got["new"]["last_reinforced"] is not None) == (1, True)


def test_merge_adds_up(spark):
    e = edges(spark, ("local_dev", "uses", "docker_ce", 2, 0), ("local_dev", "uses", "docker", 3, 0))
    assert [r["pos"] for r in graph.merge_canonical(e, "docker", "docker_ce").collect()] == [5]


def test_closure_prunes_and_survives_cycles(spark):
    chain = [(a, b, 1, 0) for a, b in zip("abcdef", "bcdefg")]
    got = {(r["s"], r["o"]): r["conf"] for r in graph.transitive(spark.createDataFrame(chain, "s string, o string, pos long, neg long")).collect()}
    assert got["a", "c"] == pytest.approx(4 / 9) and ("a", "e") in got and ("a", "f") not in got
    loop = spark.createDataFrame([("a", "b", 1, 0), ("b", "a", 1, 0)], "s string, o string, pos long, neg long")
    assert ("a", "a") in {(r["s"], r["o"]) for r in graph.transitive(loop).collect()}


def test_fusion_and_gate(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    assert retrieval.rrf(a, a, 5).first()["score"] == pytest.approx(2 / 61)
    assert retrieval.should_rerank([1], [2], [(1, 0.03), (2, 0.02)])
    assert not retrieval.should_rerank([1], [1], [(1, 0.03), (2, 0.02)])


def test_recency_fallback_and_overlap_weight(spark):
    e = edges(spark, ("a", "uses", "x", 1, 0), ("b", "uses", "y", 1, 0))
    none = spark.createDataFrame([], "entity string")
    assert retrieval.graph_facts(e, none, [], "2024-01-03 00:00:00").count() == 2
    direct = retrieval.graph_facts(e, spark.createDataFrame([("a",)], "entity string"), [], "2024-01-03 00:00:00").first()
    half = retrieval.graph_facts(e, none, [], "2024-01-03 00:00:00", overlap=spark.createDataFrame([("a", "a")], "entity string, via string")).first()
    assert half["score"] == pytest.approx(direct["score"] / 2) and "recency_2d" in direct["why"]


def test_validation(spark):
    raw = '[{"subject":"a","predicate":"uses","object":"b"},{"subject":"a","predicate":"consumes","object":"b"},{"subject":"a","predicate":"uses","object":"b","polarity":99},5]'
    df = spark.createDataFrame([("c", raw), ("d", "nope"), ("e", "{}"), ("f", None)], "chunk_id string, raw string")
    assert [(r["subject"], r["polarity"]) for r in extraction.validate_triples(df).collect()] == [("a", 1)]


def test_markdown_section(tmp_path):
    path = str(tmp_path / "m.md")
    assert consolidation.read_section(path, "x") is None
    consolidation.write_section(path, "x", "one", "# Top")
    consolidation.write_section(path, "y", "two")
    consolidation.write_section(path, "x", "three")
    assert (consolidation.read_section(path, "x"), consolidation.read_section(path, "y")) == ("three", "two")
    assert open(path).read().startswith("# Top")
