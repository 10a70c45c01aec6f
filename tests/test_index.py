"""Pruned search equals a scan and reads less; the index of notes stays in step as notes come, change and go."""

import random

from engramix.functions import text as T
from engramix.operators import index, retrieval


def rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def test_pruned_equals_a_scan_and_reads_less(spark):
    r = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "")], "id int, text string").cache()
    sizes = index.lengths(docs, "id").cache()
    at = index.placed(index.postings(docs, "id"), sizes, "id").cache()
    maxima = index.blocks(at).cache()
    read = total = 0
    for query in ("word3 word200", "word1 word2 word5", "word250", "nothing here", "word299 word0"):
        got, some, every = index.pruned(at, maxima, sizes, "id", index.S.terms(query), 5)
        assert rows(got) == rows(retrieval.bm25(docs, T.search_words(query), 5, stemmed=True)), query
        read, total = read + some, total + every
    assert 0 < read < total / 3


def test_notes_stay_in_step(spark):
    note = "id string, text string"
    held, maxima, sizes = (spark.createDataFrame([], s) for s in ("kind string, term string, id string, tf int, dl int, bucket int", "kind string, term string, bucket int, tf int, dl int, n long", "kind string, id string, dl int"))
    state, r = {}, random.Random(6)
    keys = {"note_postings": ["kind", "term", "id"], "note_lengths": ["kind", "id"], "note_blocks": ["kind", "term", "bucket"]}
    tables = {"note_postings": held, "note_blocks": maxima, "note_lengths": sizes}
    for _ in range(3):
        new = {f"e{r.randint(0, 5)}": " ".join(r.choices(["deploy", "deployed", "billing", "rain", "x"], k=r.randint(0, 6))) for _ in range(3)}
        put, delete = index.note_changes("episode", spark.createDataFrame(list(new.items()), note), tables["note_postings"], tables["note_blocks"])
        for n, key in keys.items():
            left = tables[n].join(put[n].select(*key), key, "left_anti")
            left = left.join(delete[n].select(*key), key, "left_anti") if n in delete else left
            tables[n] = spark.createDataFrame(left.unionByName(put[n].select(left.columns)).collect(), tables[n].schema)
        state |= new
        docs = spark.createDataFrame(list(state.items()), note)
        want = index.blocks(index.placed(index.postings(docs, "id"), index.lengths(docs, "id"), "id")).select("term", "bucket", "tf", "dl", "n")
        assert sorted(map(tuple, tables["note_blocks"].select("term", "bucket", "tf", "dl", "n").collect())) == sorted(map(tuple, want.collect()))
        got = index.search_notes("episode", tables["note_postings"], tables["note_blocks"], tables["note_lengths"], "deployment of billing", 3)
        assert rows(got) == rows(retrieval.bm25(docs, T.search_words("deployment of billing"), 3, stemmed=True))
    assert index.search_notes("procedure", *(tables[n] for n in ("note_postings", "note_blocks", "note_lengths")), "x", 3) is None
