"""Inverted lists against brute force: the exact mode, recall of the other, hot cells and odd vectors."""

import numpy as np
import pytest

from engramix import clients
from engramix.memory import Memory
from engramix.operators import retrieval
from engramix.operators import vectors as V
from engramix.plans.dream import Config


def frame(spark, x, extra=()):
    return spark.createDataFrame([*[(i, [float(c) for c in row]) for i, row in enumerate(x)], *extra], "id long, v array<float>")


def brute(x, q, k, cosine=False):
    x, q = np.asarray(x, np.float32).astype(float), np.asarray(q, np.float32).astype(float)
    if cosine:
        x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    d = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    return {j: sorted(range(len(x)), key=lambda i: (round(d[j, i], 12), i))[:k] for j in range(len(q))}


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.mark.parametrize("cosine", [False, True])
def test_exact_equals_brute_force(spark, cosine):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.3, (80, 8)) for c in r.normal(0, 3, (6, 8))] + [np.ones((150, 8))])  # a hot group of copies
    q = np.concatenate([x[::37], r.normal(0, 5, (5, 8))])
    df, asked = frame(spark, x), frame(spark, q).withColumnRenamed("id", "qid")
    m = V.fit(df, 8, cells=20, cosine=cosine)
    idx = V.index(df, m).cache()
    assert idx.count() == len(x)
    for piece in (10_000, 40):
        assert found(V.search(idx, asked, m, 7, probes=1, exact=True, piece=piece)) == brute(x, q, 7, cosine)
    near = found(V.search(idx, asked, m, 7, probes=V.probes_for(idx, asked, m, 7)))
    want = brute(x, q, 7, cosine)
    assert sum(len(set(near[j]) & set(want[j])) for j in want) >= 0.9 * 7 * len(want)


def test_odd_vectors(spark):
    x = np.eye(4)
    df = frame(spark, x, [(10, None), (11, []), (12, [1.0, 2.0]), (13, [1.0, None, 0.0, 0.0]), (14, [1.0, 0.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.0, 0.0])])
    m = V.fit(df, 4, cells=3)
    idx = V.index(df, m)
    assert sorted(r["id"] for r in idx.collect()) == [0, 1, 2, 3, 14, 14]
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0]), (2, None)], "qid long, v array<float>")
    got = V.search(idx, asked, m, 10, exact=True).collect()
    assert {r["qid"] for r in got} == {0} and [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 14, 14, 1, 2, 3]
    none = V.fit(df.limit(0), 4)
    assert V.search(V.index(df.limit(0), none), asked, none, 3, exact=True).collect() == []


def test_cells_are_fitted_anew_as_vectors_double(spark):
    r = np.random.default_rng(3)
    kind = "chunk_id string, v array<double>, model string, dim int, cell int, r double"
    held, cells, fitted = spark.createDataFrame([], kind), spark.createDataFrame([], "model string, cell int, centre array<double>, fitted_on long"), []
    for name, n in (("a", 5), ("b", 7), ("c", 5), ("d", 12)):
        new = spark.createDataFrame([(f"{name}{i}", r.normal(0, 1, 4).tolist(), "m", 4) for i in range(n)], "chunk_id string, v array<double>, model string, dim int")
        put, made = V.kept_index(held, new, cells, "m", 4, index_from=10)
        rows = held.join(put.select("chunk_id"), "chunk_id", "left_anti").unionByName(put.select(*[c for c in held.columns if c in put.columns]), allowMissingColumns=True).collect()
        held = spark.createDataFrame(rows, kind)
        cells = cells if made is None else spark.createDataFrame(made.collect(), cells.schema)
        fitted.append(cells.agg({"fitted_on": "max"}).first()[0])
        assert held.filter("cell IS NULL OR r IS NULL").count() == (5 if name == "a" else 0)
    assert fitted == [None, 12, 12, 29] and held.count() == 29
    q = r.normal(0, 1, 4).tolist()
    found = lambda df: [(x["id"], round(x["score"], 9)) for x in df.collect()]
    assert found(V.nearest_kept(held, cells, q, 6)) == found(retrieval.knn(held.selectExpr("chunk_id AS id", "v"), q, 6))
    assert V.nearest_kept(held, cells, [1.0], 6) is None


def test_a_store_keeps_its_vectors_in_cells(spark, tmp_path):
    m = Memory(spark, str(tmp_path), clients.StubLLM(), clients.StubEmbedder(8))
    m.log(spark.createDataFrame([(f"a{i}", 0, "user", f"I prefer number {i} over all others") for i in range(12)], "session_id string, pos int, role string, content string"), "2024-05-01 00:00:00")
    m.dream("2024-05-02 00:00:00", config=Config(index_from=10))
    assert m.store.table("cells").first()["fitted_on"] == 12 and m.store.table("chunk_vectors").filter("cell IS NOT NULL").count() == 12
    assert m.augment("number 3", "2024-05-02 00:00:00").passages.count() == 5
