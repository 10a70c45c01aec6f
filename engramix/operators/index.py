"""A posting list for text search: which texts hold a stem, how often, and how long each text is.

Texts are indexed once, when they come in; a search reads the postings of its own terms only. Kept
sorted by term, so files and row groups of other terms are skipped by their statistics.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from engramix.functions import stem as S
from engramix.sources.checkpoint import cut


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(S.stem)


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, key and tf of texts; each distinct word is stemmed once, whatever the texts it stands in."""
    words = docs.select(key, F.explode(F.regexp_extract_all(S.folded(F.col(text)), F.lit(S.WORD), 0)).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    # asking for a count too lets both sides read the texts' words once
    stems = words.groupBy("w").agg(F.max("n").alias("most")).filter("most > 0").select("w", _stem("w").alias("term"))
    return words.join(stems, "w").groupBy("term", key).agg(F.sum("n").cast("int").alias("tf"))


def lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the number of words of every text, empty ones included."""
    return docs.select(key, S.length(F.col(text)).cast("int").alias("dl"))


def bm25_indexed(posted: DataFrame, sizes: DataFrame, key: str, query: str, top_k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score (negative, lower is better), as retrieval.bm25 gives them stemmed, from an index."""
    terms = S.terms(query)
    if not terms:
        return sizes.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    mine = cut(posted.filter(F.col("term").isin(terms)))
    seen = {r["term"]: r["d"] for r in mine.groupBy("term").agg(F.count(F.lit(1)).alias("d")).collect()}  # one row per query term
    if not seen:
        return sizes.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    d = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])[F.col("term")]
    idf = F.ln(1 + (F.lit(stats["n"]) - d + 0.5) / (d + 0.5))
    t = F.col("tf").cast("double")
    part = idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"])))
    return mine.join(sizes, key).groupBy(F.col(key).alias("id")).agg((-F.sum(part)).alias("score")).orderBy(F.round("score", 9), "id").limit(top_k)


# ---- block maxima: which postings can't matter to the best few
BUCKETS = 4096  # of the ids; a block is a term's postings in one


def placed(posted: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Postings with the length of their text (unless they have it) and the bucket of its id."""
    return (posted if "dl" in posted.columns else posted.join(sizes, key)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def blocks(of: DataFrame, *more: str) -> DataFrame:
    """term, bucket, n, and what bounds the block's scores: its largest tf and least dl. more: further columns that tell indexes apart."""
    return of.groupBy(*more, "term", "bucket").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count(F.lit(1)).alias("n"))


def pruned(at: DataFrame, maxima: DataFrame, sizes: DataFrame, key: str, terms: list[str], top_k: int, k1: float = 1.2, b: float = 0.75, first: int = 4) -> tuple[DataFrame, int, int]:
    """id and score (negative, lower is better) of the top_k texts for terms, ties by id; and how many postings that read, of how many.

    A bucket's bound is the sum over the terms of what its block can score at most. The buckets with
    the highest bounds are scored first, until they hold `first` * top_k postings; of the rest only
    those whose bound reaches the top_k-th score so far. The driver sees one row a bucket.
    """
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    score = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(stats["avgdl"] or 1.0)))
    mine = maxima.filter(F.col("term").isin(terms))
    seen = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    if not seen or top_k < 1:
        return sizes.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0), 0, sum(seen.values())
    d = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])[F.col("term")]
    idf = F.ln(1 + (F.lit(stats["n"]) - d + 0.5) / (d + 0.5))
    part = idf * score(F.col("tf").cast("double"), F.col("dl"))
    order = sorted(((r["bound"], r["bucket"], r["n"]) for r in mine.groupBy("bucket").agg(F.sum(part).alias("bound"), F.sum("n").alias("n")).collect()), reverse=True)
    postings_of = at.filter(F.col("term").isin(terms))

    def scored(some: list[int]) -> DataFrame:
        return postings_of.filter(F.col("bucket").isin(some)).groupBy(F.col(key).alias("id")).agg((-F.sum(part)).alias("score"))

    head, read = [], 0
    for _, bucket, n in order:
        head.append(bucket)
        read += n
        if read >= first * top_k:
            break
    best = scored(head).orderBy(F.round("score", 9), "id").limit(top_k)
    found = best.collect()  # top_k rows
    floor = -found[-1]["score"] - 1e-9 if len(found) == top_k else 0.0
    more = [(bucket, n) for bound, bucket, n in order[len(head) :] if bound >= floor]
    if more:
        read += sum(n for _, n in more)
        best = best.unionByName(scored([x for x, _ in more])).orderBy(F.round("score", 9), "id").limit(top_k)
    return best, read, sum(seen.values())


def note_changes(kind: str, new: DataFrame, held: DataFrame, maxima: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What to put into and to delete from the index of notes (episodes or procedures) as texts (id, text) come or change.

    held: its postings (kind, term, id, tf, dl, bucket); maxima: its blocks. Blocks that gain or lose a posting are made anew.
    """
    new = cut(new.dropDuplicates(["id"]))
    sizes = lengths(new, "id").withColumn("kind", F.lit(kind))
    fresh = cut(placed(postings(new, "id"), sizes.drop("kind"), "id").withColumn("kind", F.lit(kind)).select("kind", "term", "id", "tf", "dl", "bucket"))
    mine = held.filter(F.col("kind") == kind)
    old = cut(mine.join(new.select("id"), "id", "left_semi"))
    gone = old.join(fresh.select("term", "id"), ["term", "id"], "left_anti")
    touched = fresh.select("term", "bucket").unionByName(old.select("term", "bucket")).distinct()
    after = mine.join(touched, ["term", "bucket"], "left_semi").join(new.select("id"), "id", "left_anti").select(fresh.columns).unionByName(fresh)
    made = cut(blocks(after, "kind"))
    left = maxima.filter(F.col("kind") == kind).join(touched, ["term", "bucket"], "left_semi").join(made, ["term", "bucket"], "left_anti")
    return {"note_postings": fresh, "note_lengths": sizes, "note_blocks": made}, {"note_postings": gone, "note_blocks": left}


def search_notes(kind: str, held: DataFrame, maxima: DataFrame, sizes: DataFrame, query: str, top_k: int) -> DataFrame | None:
    """id and score of the best notes of a kind from their index; None where it has none."""
    of = lambda df: df.filter(F.col("kind") == kind)
    if of(sizes).isEmpty():
        return None
    return pruned(of(held), of(maxima), of(sizes), "id", S.terms(query), top_k)[0]
