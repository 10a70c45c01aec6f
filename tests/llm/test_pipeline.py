"""The pipeline stage by stage against brute force, and operators 2 and 6 on tables of odd shapes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from engramix.llm import mixing, sharding, toxicity
from engramix.llm.common import cut

from test_operators import DOC, brute_components, docs, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
BAD = ["idiot", "worthless", "scum"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    items = [prose(700 + i, 25) for i in range(3)]
    rows, toxic = [], {}
    for i in range(240):
        w = prose(i, r.randint(20, 90)).split()
        if i % 6 == 0:
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w)))
        toxic[i] = int(i % 6 == 0)
    rows += [(300 + k, rows[7][1]) for k in range(12)] + [(7, rows[7][1]), (320, rows[8][1] + " tail"), (None, rows[9][1]), (None, None), (330, ""), (331, None)]
    rows += [(340, rows[10][1] + " " + items[0] + " " + rows[11][1]), (341, items[1] + " few words"), (342, items[2][:60])]
    d = tmp_path_factory.mktemp("corpus")
    full = [(i, t, "en", ("a", "b", "c", None)[(i or 0) % 4], len(t or ""), "x", "y") for i, t in rows]
    spark.createDataFrame(full, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic[i]) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_stages(spark, corpus):
    d, items = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    df = start
    for name in names:
        before = df
        df = cut(stages[name](spark, df, d))
        steps[name] = before, df
        if name != "sharding":
            assert df.columns == start.columns

    before, after = (key(x.collect()) for x in steps["toxicity"])
    clean = [x for x in before if not any(b in (x[1] or "") for b in BAD)]
    assert after == clean and len(before) - len(clean) == 40

    before, after = ([r.asDict() for r in x.collect()] for x in steps["ngram_join"])
    groups = {}
    rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    for r, (n, c) in zip(rows, brute_components([r["text"] for r in rows]), strict=True):
        if n:
            groups.setdefault(c, []).append((r["doc_id"], r["text"]))
    want = [g[0] for g in groups.values()] + [(r["doc_id"], r["text"]) for r in rows if not (r["text"] or "").strip()]
    assert key(after) == sorted(want, key=str)

    before, after = ([r.asDict() for r in x.collect()] for x in steps["decontamination"])
    left = {r["doc_id"]: r["text"] for r in after}
    windows = {" ".join(w[i : i + 10]) for w in map(str.split, items) for i in range(len(w) - 9)}
    for r in before:
        t = r["text"] or ""
        if any(x in t for x in windows):
            assert r["doc_id"] not in left or not any(x in left[r["doc_id"]] for x in windows)
        elif r["doc_id"] is not None:
            assert left[r["doc_id"]] == r["text"]
    assert 341 not in left and 340 in left and items[0].split()[0] not in left[340].split()[:1]
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"])

    before, after = ([r.asDict() for r in x.collect()] for x in steps["mixing"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = {k: key(after).count(k) / key(before).count(k) for k in key(before)}
    assert all(v <= 2 for v in times.values()) and set(key(after)) <= set(key(before))
    assert all(times[r["doc_id"], r["text"]] == 1 for r in before if not size(r["text"]))
    sources = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r["text"]) for r in before if r["source"] == s) for s in sources}
    goals = mixing.water_fill([float(total[s]) for s in sources], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))], 1.5 * sum(total.values()), 2.0)
    for s, goal in zip(sources, goals, strict=True):
        assert sum(size(r["text"]) for r in after if r["source"] == s) == pytest.approx(goal, abs=25)

    before, after = steps["sharding"]
    assert key(before.collect()) == key(after.collect())
    out = after.toPandas()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = corpus_pipeline.run(spark, d).toPandas()
    assert sorted(map(str, again[["doc_id", "text", "shard", "slot"]].values.tolist())) == sorted(map(str, out[["doc_id", "text", "shard", "slot"]].values.tolist()))


def test_pipeline_of_empty_tables_and_one_class(spark, corpus, tmp_path):
    d, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    df = spark.read.parquet(f"{d}/documents.parquet")
    only = spark.createDataFrame([(i, 1) for i in range(0, 200, 6)], "doc_id long, toxic int")
    for labels in (only, only.limit(0), only.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(df, labels)
        assert toxicity.drop_toxic(df, model).count() == df.count()
        assert all(r["score"] < 0.5 for r in toxicity.score(df, model).collect())


def test_toxicity_edges(spark):
    texts = [None, "", " \n", "!!!", *[f"{prose(i, 30)} {'idiot' if i % 3 == 0 else 'good'} {prose(90 + i, 20)}" for i in range(120)]]
    df = docs(spark, texts).selectExpr("*", "1 as score", "2 as _id", "3 as _y", "4 as _t").unionByName(docs(spark, texts[:6]).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "size", "shard", "1 as score", "2 as _id", "3 as _y", "4 as _t"))
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(4, 124)] + [(4, 0), (5, None), (None, 1), (9999, 1), (7, 7)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model)
    assert got.count() == df.count() and got.columns == ["doc_id", "score"]
    left = toxicity.drop_toxic(df, model)
    assert left.columns == df.columns and not any("idiot" in (r["text"] or "") for r in left.collect())
    assert left.filter("text is null or text in ('', ' \n', '!!!')").count() == 8
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0


def test_mixing_on_clashing_columns(spark):
    texts = [prose(i, 20) for i in range(30)]
    df = docs(spark, texts, ["s", None, "t"] * 10).selectExpr("*", "1 as docs", "2 as _s", "3 as taken", "4 as _copies", "5 as _row", "6 as w").unionByName(docs(spark, texts[:3]).selectExpr("*", "1 as docs", "2 as _s", "3 as taken", "4 as _copies", "5 as _row", "6 as w"))
    got = mixing.mix(df)
    assert got.count() == 33 and set(df.columns) <= set(got.columns) and {r["docs"] for r in got.collect()} == {1} and {r["_copies"] for r in got.collect()} == {4}
    assert mixing.mixed_rows(df).columns == df.columns and mixing.mixed_rows(df.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id) as source")
    out = mixing.mix(many).agg(F.sum("target"), F.sum("taken"), F.count("*")).first()
    assert out[2] == 3000 and out[0] == pytest.approx(13500) and abs(out[1] - 13500) <= 3 * 3000


def test_sharding_keeps_clashing_columns(spark):
    df = docs(spark, ["a", "a", None]).selectExpr("*", "1 as _size", "2 as _part")
    got = sharding.shard(df, shards=2)
    assert {(r["_size"], r["_part"]) for r in got.collect()} == {(1, 2)} and got.count() == 3
