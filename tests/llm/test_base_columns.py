"""Columns that SQL or a few lines of Python give exactly, over a whole table of the driver."""

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from engramix.llm import mixing, quality, registry, secrets_crf

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables absent")
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df, *columns):
    return sorted(tuple(r) for r in df[list(columns)].itertuples(index=False, name=None))


BASE_SPANS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 1 AS k, 'assign' AS kind, 8 AS least, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v, string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT doc_id, 2, 'access', 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 3, 'hex', 32, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
), f AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m),
s AS (SELECT doc_id, k, kind, list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s, length(m[i]) AS n FROM f WHERE length(v[i]) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k), '')) AS base_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


def test_secrets_base(spark):
    larger = DIR.replace("0.001", "0.01")  # the smallest table holds no secrets
    got = registry.QUERIES["op1_secret_scan"](spark, larger).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{larger}/documents.parquet'")
    want = con.sql(BASE_SPANS).df()
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    assert rows(got, *cols) == rows(want, *cols) and got["n_assign"].sum() > 0


def test_secrets_do_not_depend_on_the_order(spark):
    """Words that share all but one fact (letters without case, other digits), met in every order."""
    words = ["abé", "ab中", "ab²", "éa:", "aé:", "abcdefabcdefabcd", "AKIAxyz", "Straße", "STRASSE", "aaaab"]
    crf = secrets_crf.train()
    want = {w: secrets_crf.Crf(crf.weights, crf.trans) for w in words}
    alone = {w: c.rows[c.table[w]].tolist() for w, c in want.items()}
    for order in (words, words[::-1]):
        c = secrets_crf.Crf(crf.weights, crf.trans)
        for w in order:
            c.table[w]
        assert {w: c.rows[c.table[w]].tolist() for w in words} == alone
    texts = [(i, f"password is {w} x{i}Kq9ZmP2vL8tR4w next {w}") for i, w in enumerate(words * 5)]
    df = spark.createDataFrame([*texts, (None, None), (3, texts[3][1])], "doc_id long, text string").selectExpr("*", "1 as spans")
    first = sorted(map(repr, secrets_crf.scan(df.coalesce(1)).collect()))
    assert first == sorted(map(repr, secrets_crf.scan(df.repartition(7, F.rand(3))).collect())) and len(first) == 52
    assert secrets_crf.scan(df.limit(0)).count() == 0


def test_mixing_base(spark, con):
    got = registry.QUERIES["op2_mixing_sources"](spark, DIR).toPandas()
    want = con.sql(rf"SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents)").df()
    assert rows(got, "doc_id", "size", "source_size") == rows(want, "doc_id", "size", "source_size")
    sources = want.groupby("source", dropna=False)["size"].sum()
    names = sorted(sources.index, key=lambda s: (not isinstance(s, str), s if isinstance(s, str) else ""))
    goals = mixing.water_fill([float(sources[n]) for n in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * float(sources.sum()), 2.0)
    both = got.merge(want[["doc_id", "source"]], on="doc_id")
    for n, t in zip(names, goals, strict=True):
        assert both[both["source"] == n]["target"].tolist() == pytest.approx([t] * int((both["source"] == n).sum()))
    assert sum(goals) == pytest.approx(1.5 * float(sources.sum()))


def test_bytes_folds_and_checksums(spark, con):
    docs = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    tokens = registry.QUERIES["op5_token_counts"](spark, DIR).toPandas()
    assert rows(tokens, "doc_id", "n_bytes") == sorted((i, len(t.encode())) for i, t in docs.items())
    assert (tokens["over_limit"] == (tokens["n_tokens"] > 4096)).all()
    toxic = registry.QUERIES["op6_toxicity"](spark, DIR).toPandas()
    assert rows(toxic, "doc_id", "held_out") == sorted((i, zlib.crc32(str(i).encode()) % 5 == 0) for i in docs)
    assert toxic["score"].between(0, 1).all() and (toxic["predicted"] == (toxic["score"] >= 0.5)).all()
    labels = dict(con.sql("SELECT doc_id, toxic FROM labels").fetchall())
    held = toxic[toxic["held_out"] & toxic["doc_id"].isin(labels)]
    assert (held["predicted"] == held["doc_id"].map(labels)).mean() >= 0.9
    shards = registry.QUERIES["op10_sharding"](spark, DIR).toPandas()
    assert rows(shards, "doc_id", "size", "text_crc32") == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items())
    assert set(shards["law"]) == {"bytes"} and shards["grown_shard"].isna().all() and shards["shard"].between(0, 23).all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in shards.groupby("shard"))


def brute_quality(texts):
    """(base columns, class counts, common-word counts) of each text."""
    out = []
    for t in texts:
        w = re.findall(WORD, t)
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = "".join(w)
        import unicodedata

        def kind(ch):
            cat = unicodedata.category(ch)
            return 0 if cat == "Ll" else 1 if cat == "Lu" else 2 if cat in ("Lo", "Lt", "Lm") or cat[0] == "M" else 3 if cat[0] == "N" else 4 if ch in ".,;:!?'\"()-" else 5

        kinds = Counter(map(kind, chars))
        common = Counter(x.lower() for x in w)
        out.append(((len(w), len(chars), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)), [kinds[k] for k in range(6)], [common[x] for x in quality.COMMON_WORDS]))
    return out


def js(p, q):
    div = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        div += ((a * math.log2(a / m) if a else 0.0) + (b * math.log2(b / m) if b else 0.0)) / 2
    return math.sqrt(max(0.0, div))


def test_quality_against_brute_force(spark, con):
    docs = con.sql("SELECT doc_id, lang, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    got = registry.QUERIES["op9_quality_rules"](spark, DIR).toPandas().set_index("doc_id")
    brute = brute_quality([t for _, _, t in docs])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    refs = {}
    for (_, lang, _), (base, classes, common) in zip(docs, brute, strict=True):
        if not (base[0] < 10 or 100 * base[4] > 20 * base[0]):
            r = refs.setdefault(lang, [0, 0, [0] * 6, [0] * len(common)])
            r[0], r[1] = r[0] + base[0], r[1] + base[1]
            r[2], r[3] = [x + y for x, y in zip(r[2], classes)], [x + y for x, y in zip(r[3], common)]
    for (i, lang, _), (base, classes, common) in zip(docs, brute, strict=True):
        row = got.loc[i]
        assert tuple(row[cols]) == base
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert row["base_failed"] == failed
        n, c, ref_classes, ref_common = refs[lang]
        verdict = not failed
        if base[1] >= 100:
            d = js([x / base[1] for x in classes], [x / c for x in ref_classes])
            assert row["class_distance"] == pytest.approx(d, abs=1e-6)
            verdict &= d <= 0.35
        if base[0] >= 50:
            full = lambda counts, total: [x / total for x in [*counts, total - sum(counts)]]
            d = js(full(common, base[0]), full(ref_common, n))
            assert row["word_distance"] == pytest.approx(d, abs=1e-6)
            share = sum(ref_common) / n
            blank = js([0.0, 1.0], [share, 1 - share])
            if base[0] * share >= 6 and abs(d - 0.95 * blank) > 1e-6:
                verdict &= d <= 0.95 * blank
        assert row["kept"] == verdict


def test_quality_on_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c " * 30, "en", 7)], "doc_id long, text string, lang string, n long")
    wide = df.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(("_words", "_at", "_pos", "_p", "_lang", "_row", "_classes", "n_words", "kept"))])
    got = quality.rules(wide).first()
    assert (got["n_words"], got["_words"], got["_pos"], got["_row"], got["n"]) == (90, 0, 2, 5, 7)
    assert quality.rules(df.limit(0)).count() == 0 and quality.rules(df.withColumn("lang", F.lit(None).cast("string"))).count() == 1
