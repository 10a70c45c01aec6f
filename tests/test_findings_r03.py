"""What a review of round 3 found, each as a small case that failed before."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from engramix.functions import text as T
from engramix.operators import chunking, extraction, graph, narrative, vectors
from engramix.plans import catalog_memory as catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables absent")
def test_narrative_upsert_matches_its_sql(spark):
    want = duckdb.sql(catalog.ORACLES["narrative_upsert"].replace("FROM supplier", f"FROM '{DIR}/supplier.parquet'")).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["narrative_upsert"](spark, DIR).select("s_suppkey", "title").collect()]
    assert sorted(got) == sorted(want) and {t for _, t in got} == {"old", "new"}


def test_a_text_cut_just_behind_a_line_keeps_its_line_break(spark):
    m = spark.createDataFrame([("s", i, "user", "x" * 10) for i in range(3)], "session_id string, id long, role string, content string")
    line = "user: " + "x" * 10
    assert [narrative.session_text(m, n).first()["text"] for n in (16, 17, 18)] == [line, line + "\n", line + "\nu"]


def test_chunks_by_length_alone(spark, tmp_path):
    """What a turn says is no reason there, and a short one stays out."""
    said = ["No, actually use the other one of the two.", "no, use uv", "A turn without any phrase, but long."]
    rows = [(1, i, "user", t) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("salient_chunks", "chunk_ids", "baseline_chunks", "persist_chunks"):
        want = con.execute(catalog.ORACLES[name])
        cols = [c[0] for c in want.description]
        assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()) == sorted(want.fetchall()), name
    m = spark.createDataFrame([("s", i, "user", t) for _, i, _, t in rows], "session_id string, id long, role string, content string").withColumn("created_at", F.lit(0))
    assert {r[0] for r in chunking.salient_chunks(m).select("salience_reason").collect()} == {"correction_or_preference_trigger", "long_user_turn"}


def test_ageing_reads_the_edges_once_and_counts_large_chunks_too(spark, tmp_path):
    """Chunk c1 mentions more names than have their pairs formed; the edge a-b is its evidence, a-d is not."""
    edges = [("a", "uses", "b"), ("a", "uses", "d"), ("a", "uses", "z"), ("k1", "uses", "k1")]
    old = F.expr("timestamp_ntz'2023-01-01'")
    spark.createDataFrame([(*e, 1, 0, "active", False) for e in edges], "s string, p string, o string, pos long, neg long, status string, derived boolean").withColumns({c: old for c in ("first_seen", "last_seen", "last_reinforced")}).write.parquet(str(tmp_path / "edges"))
    e = spark.read.parquet(str(tmp_path / "edges"))
    names = ["a", "b", "d", *[f"k{i}" for i in range(graph.PAIRED)]]
    m = spark.createDataFrame([("c1", n) for n in names] + [("c2", "a"), ("c2", "z")], "chunk_id string, entity string")
    c = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01'"))
    ev = spark.createDataFrame([("a", "uses", "b", "c1"), ("a", "uses", "z", "c2")], "s string, p string, o string, chunk_id string")
    pos, neg = (f(e, m, c, ev, "2024-01-02 00:00:00") for f in (graph.reinforce, graph.decay))
    assert {(r["s"], r["o"]): r["pos"] for r in pos.collect()} == {("a", "b"): 1, ("a", "d"): 2, ("a", "z"): 1, ("k1", "k1"): 2}
    assert {(r["s"], r["o"]): r["neg"] for r in neg.collect()} == {("a", "b"): 1, ("a", "d"): 1, ("a", "z"): 1, ("k1", "k1"): 1}
    few = m.filter("chunk_id = 'c2'")
    for f in (graph.reinforce, graph.decay):
        plan = f(e, few, c, ev, "2024-01-02 00:00:00")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1, plan


def test_names_are_normalised_as_by_the_whole_chain_and_soon(spark):
    names = ["a", "a_b", "the_x", "the x", "a__b", "_a", "a_", "a\n", "", "café", "cafe\u0301", "MedFlow (x)", "Ａｂ", "ﬁle ½", "日本", None]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = df.select(T.normalize(F.col("x")), T._normalized(F.col("x"))).collect()
    assert all(a == b for a, b in got) and got[2][0] == "the_x" and got[7][0] == "a" and got[-1][0] is None
    many = spark.range(0, 20_000, 1, 1).select(F.concat(F.lit("Small Ring Brand#"), F.col("id").cast("string")).alias("x"))
    began = time.time()
    many.select(T.normalize(F.col("x"))).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 15


def test_a_stub_vector_hashes_its_text_once(spark):
    v = spark.range(3).select(extraction.stub_embedding(F.col("id").cast("string")).alias("v"))
    assert v._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 and len(r["v"]) == 16 for r in v.collect())


def test_few_distances_are_held_at_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))})
    parts = list(vectors._slices([batch], 1732))
    assert max(len(p) for p in parts) * 1732 <= vectors.ROOM and [x for p in parts for x in p.column(0).to_pylist()] == list(range(10_000))
