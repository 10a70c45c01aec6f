"""Results that must not depend on how much one automaton, range or block holds."""

import random

from pyspark.sql import functions as F

from engramix.llm import decontamination, ngram_join, secrets_crf, sharding

from test_operators import DOC, docs, prose


def bench_and_rows(spark):
    items = [prose(500 + i, 30) for i in range(6)] + ["two words here"]
    bench = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(items)] + [(9, None), (0, items[0])], "item_id long, text string")
    rows = [
        (7, items[0] + " " + prose(1, 50)), (7, items[1] + " " + items[2]), (None, items[3] + " " + prose(2, 40)), (None, "clean text"), (None, None),
        (1, prose(3, 10) + " " + items[4] + " " + prose(4, 10) + " " + items[5] + " " + prose(5, 45)), (2, "x two words here " + prose(6, 20)), (2, ""),
        # the halves of an item meet once the item between them is cut out
        (3, prose(7, 40) + " " + " ".join(items[0].split()[:9]) + " " + items[1] + " " + " ".join(items[0].split()[9:18]) + " " + prose(8, 30)),
    ]
    return bench, spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOC)


def test_decontamination_is_the_same_by_any_number_of_automata(spark):
    bench, df = bench_and_rows(spark)
    one = list(decontamination.automata(bench))
    assert len(one) == 1 and len(list(decontamination.automata(bench, max_words=20))) > 5
    want = None
    for most in (decontamination.MAX_WORDS, 90):
        got = sorted(map(repr, decontamination.contamination(df, bench, max_words=most).collect()))
        clean = sorted(map(repr, decontamination.decontaminate(df, bench, max_words=most).collect()))
        assert len(got) == 9 and want in (None, (got, clean))
        want = (got, clean)
    assert not any(r["contaminated"] for r in decontamination.contamination(decontamination.decontaminate(df, bench, max_words=90), bench).collect())


def test_decontamination_of_empty_tables_and_clashing_columns(spark):
    bench, df = bench_and_rows(spark)
    wide = df.selectExpr("*", "n_chars as spans", "text as _spans", "1 as items", "2 as n_words", "3 as _n_words")
    for most in (decontamination.MAX_WORDS, 150):
        out = decontamination.decontaminate(wide, bench, max_words=most)
        assert out.columns == wide.columns and out.count() == decontamination.decontaminate(df, bench).count()
        assert decontamination.contamination(wide, bench, max_words=most).count() == 9
        assert decontamination.decontaminate(df.limit(0), bench, max_words=most).count() == 0
    assert decontamination.decontaminate(df, bench.limit(0)).count() == 9
    assert not any(r["n_hit"] for r in decontamination.contamination(df, bench.limit(0)).collect())


def test_automaton_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        words = [b"a", b"b", b"c"][: r.randint(1, 3)]
        items = [(str(k), [r.choice(words) for _ in range(r.randint(1, 14))]) for k in range(r.randint(1, 5))]
        window = r.randint(2, 5)
        a = decontamination.SuffixAutomaton(sorted(items), window)
        for _ in range(10):
            doc = [r.choice([*words, b"z"] if r.random() < 0.1 else words) for _ in range(r.randint(0, 25))]
            hit, which = set(), set()
            for k, x in items:
                n = min(window, len(x))
                for i in range(len(x) - n + 1):
                    for j in range(len(doc) - n + 1):
                        if doc[j : j + n] == x[i : i + n]:
                            hit |= set(range(j, j + n))
                            which.add(k)
            spans, found = a.hits(doc)
            assert {p for s, e in spans for p in range(s, e)} == hit and {a.ids[k] for k in found} == which


def test_shards_and_slots_do_not_depend_on_ranges(spark):
    texts = [None, "", *[prose(i, 30) for i in range(300)], *["same text"] * 300, *["other"] * 60]
    df = docs(spark, texts).unionByName(docs(spark, ["again", "again", None]))
    wide = df.selectExpr("*", "1 as _k1", "2 as _part", "'z' as law", "0 as slot", "1 as _row")
    want = None
    for most in (10**9, 200, 15):
        got = sharding.shard(wide, shards=5, rows_per_range=most)
        assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "_k1" in got.columns
        rows = sorted((str(r["doc_id"]), r["text"] or "", r["size"], r["shard"], r["slot"]) for r in got.collect())
        if want is None:
            want = rows
        # rows equal in id and text may swap their slots
        assert rows == want
    assert len(want) == len(texts) + 3


def test_hot_signatures_and_units_of_a_large_group(spark, monkeypatch):
    """One template in many sizes and copies: hot signatures are chained by pieces, the group is cut by size and by bytes."""
    from test_operators import brute_components

    from engramix.llm import ngram_join

    monkeypatch.setattr(ngram_join, "_hot", lambda sigs: list(range(0, ngram_join.BUCKETS, 2)))
    r = random.Random(12)
    base = prose(900, 400).split()
    texts = []
    for _ in range(140):
        w = base[: r.choice([30, 60, 120, 200, 300, 390])]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("pqrst")
        texts.append(" ".join(w))
    texts += texts[:20]
    want = brute_components(texts)
    for block in (2**25, 60_000, 12_000):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_components(docs(spark, texts), block=block).collect()}
        assert got == dict(enumerate(want))
    placed = ngram_join._placed(spark.range(4000).selectExpr("cast(cast(id as string) as binary) as cid", "7L as grp", "20 + id as n"), 10**6)
    rows = placed.collect()
    units = {(x["bi"], x["bj"]) for x in rows}
    own = {int(x["cid"]): x["block"] for x in rows}
    met = {b: set() for b in units}
    for x in rows:
        met[x["bi"], x["bj"]].add(int(x["cid"]))
    for a in range(0, 4000, 37):  # every pair whose sizes allow a link meets
        for b in range(a, min(4000, int((20 + a) / 0.85) - 19)):
            key = tuple(sorted((own[a], own[b])))
            assert a in met[key] and b in met[key]


def test_sets_come_once_a_class_and_null_ids_link(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:199], "other"]
    rows = [(i, " ".join(words), "c") for i in range(50)] + [(77, " ".join(near), "c")]
    df = spark.createDataFrame(rows, "id long, text string, TH string").repartition(6)
    wanted = df.select(F.xxhash64("text").alias("th")).distinct()
    assert ngram_join._sets(df, wanted).count() == 2
    mixed = spark.createDataFrame([(None, " ".join(near), 1), (3, " ".join(words), 1), (2, " ".join(words), 1), (2, " ".join(words), 2), (None, "lone text with five words", 1), (None, None, 1)], "doc_id long, text string, cid int")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.ngram_components(mixed).collect())
    assert got == sorted([("None", "2"), ("3", "2"), ("2", "2"), ("2", "2"), ("None", "None"), ("None", "None")])


def test_secrets_of_any_length_by_whole_tokens():
    crf = secrets_crf.train()
    long = "ghp_" + "aB3x9Q" * 200
    for text in (f"token is {long} here", f"see {long}"):
        spans = secrets_crf.crf_spans(text, crf, [])
        assert [text[s:e] for s, e, _ in spans] == [long]
    r = random.Random(4)
    for _ in range(200):
        cuts = sorted(r.sample(range(80), 2 * r.randint(0, 9)))
        spans = [(a, b, 3) for a, b in zip(cuts[::2], cuts[1::2])]  # of one reading, so apart from each other
        base = sorted((s, s + r.randint(1, 9), 0) for s in r.sample(range(80), r.randint(0, 9)))
        assert secrets_crf.apart(spans, base) == [x for x in spans if not any(a < x[1] and x[0] < b for a, b, _ in base)]
