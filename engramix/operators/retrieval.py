"""Search: BM25, exact vector search, rank fusion, rerank gate, entity matching and the hybrid graph ranker."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import stem as S
from engramix.functions import text as T
from engramix.functions.text import confidence
from engramix.sources.checkpoint import cut
from engramix.vocabulary import DEFAULTS

KEY = ["s", "p", "o"]


def bm25(docs: DataFrame, query: str | list[str], top_k: int, k1: float = 1.2, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """id and score (negative, lower is better) of the best documents; docs has id and text.

    Only the query's terms are counted in each text, so no posting of another word is ever made.
    stemmed matches words by Porter stem over all scripts; else terms are runs of a-z and 0-9, two or more.
    """
    words = query if isinstance(query, list) else T.search_words(query)
    if stemmed:
        terms = S.terms(" ".join(words))
        if terms:
            tf = docs.select("id", S.length(F.col("text")).alias("dl"), S.counts(F.col("text"), terms).alias("n"))
            tf = tf.select("id", "dl", *[F.col("n")[i].alias(f"t{i}") for i in range(len(terms))])
    else:
        terms = sorted({t for t in words if re.fullmatch("[a-z0-9]{2,}", t)})
        low = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("w"))
        # counts of the analyser's tokens (runs of a-z and 0-9, two or more) without building arrays of them
        at = lambda t: F.regexp_count("w", F.lit(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"))
        tf = low.select("id", F.regexp_count("w", F.lit("[a-z0-9]{2,}")).alias("dl"), *[at(t).alias(f"t{i}") for i, t in enumerate(terms)])
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    tf = cut(tf)  # a few numbers per document, read by both the statistics and the scores, so texts are scanned once
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        t = F.col(f"t{i}").cast("double")
        score = score + F.when(t > 0, idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    any_hit = F.lit(False)
    for i in range(len(terms)):
        any_hit = any_hit | (F.col(f"t{i}") > 0)
    return tf.filter(any_hit).join(F.broadcast(stats)).select("id", (-score).alias("score")).orderBy("score", "id").limit(top_k)


def _fold(a: Column, b: Column, step) -> Column:
    return F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    dot = _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    norm = lambda v: F.sqrt(_fold(v, v, lambda x, y: x.cast("double") * y.cast("double")))
    size = norm(a) * norm(b)
    return dot / F.when(size == 0, 1.0).otherwise(size)


def knn(vectors: DataFrame, query: list[float], top_k: int) -> DataFrame:
    """id and 1 / (1 + distance) of the nearest vectors of the query's dimension; vectors has id and v."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.filter(F.size("v") == len(query)).select("id", (1 / (1 + l2(F.col("v"), q))).alias("score")).orderBy(F.col("score").desc(), "id").limit(top_k)


def cosine_knn(vectors: DataFrame, query: list[float], top_k: int, max_scan: int = DEFAULTS["embedding_max_scan"], floor: bool = False) -> DataFrame:
    """Exact cosine over the newest max_scan vectors (id, v, created_at); floor clamps at 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scan = vectors.filter(F.size("v") == len(query)).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max_scan)
    c = cosine(F.col("v"), q)
    return scan.select("id", (F.greatest(F.lit(0.0), c) if floor else c).alias("score")).orderBy(F.col("score").desc(), "id").limit(top_k)


def cosine_edges(edges: DataFrame, vectors: DataFrame, query: list[float], top_k: int, max_scan: int = DEFAULTS["embedding_max_scan"]) -> DataFrame:
    """s, p, o, sem: cosine, not below 0, of the active edges last seen whose text has a vector (edge_text, v) of the query's dimension."""
    e = edges.filter("status = 'active'").select(*KEY, "last_seen", F.concat_ws(" ", *KEY).alias("edge_text"))
    newest = e.join(vectors.select("edge_text", "v"), "edge_text").orderBy(F.col("last_seen").desc_nulls_last(), *KEY).limit(max_scan)
    q = F.array(*[F.lit(float(x)) for x in query])
    sem = F.greatest(F.lit(0.0), cosine(F.col("v"), q))
    return newest.filter(F.size("v") == len(query)).select(*KEY, sem.alias("sem")).orderBy(F.col("sem").desc(), *KEY).limit(top_k)


def rrf(first: DataFrame, second: DataFrame, top_k: int, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank from 1); ties go to the first list's hits."""
    both = first.select("id", "rank", F.lit(0).alias("src")).unionByName(second.select("id", "rank", F.lit(1).alias("src")))
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("src").alias("src")).orderBy(F.col("score").desc(), "src", "id").limit(top_k)


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """Adds rank to a short list of hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def should_rerank(first: list, second: list, fused: list[tuple[object, float]], threshold: float = DEFAULTS["rerank_ambiguity"]) -> bool:
    """The two lists disagree at the top and the fused scores are close."""
    if not first or not second or first[0] == second[0] or len(fused) < 2 or fused[0][1] <= 0:
        return False
    return 1 - fused[1][1] / fused[0][1] <= threshold


def rerank(hits: DataFrame, ratings: DataFrame, top_k: int) -> DataFrame:
    """Order by rating * 100 + score; a missing rating is 3."""
    return hits.join(ratings, "id", "left").withColumn("score", F.coalesce("relevance", F.lit(3)) * 100 + F.col("score")).drop("relevance").orderBy(F.col("score").desc(), "id").limit(top_k)


def match_entities(candidates: DataFrame, aliases: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Canonicals that candidates (column c) name: by alias, as a subject, or as an object that looks like an entity. Status is not looked at."""
    c = candidates.select("c").distinct()
    by_alias = aliases.join(c, aliases["alias"] == c["c"], "left_semi").select("canonical")
    subjects = edges.join(c, edges["s"] == c["c"], "left_semi").select(F.col("s").alias("canonical")).distinct()
    objects = edges.join(c, edges["o"] == c["c"], "left_semi").groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    shaped = objects.join(edges.select(F.col("s").alias("o")).unionByName(types.select(F.col("entity").alias("o"))).distinct().withColumn("shape", F.lit(True)), "o", "left")
    return by_alias.unionByName(subjects).unionByName(shaped.filter("shape OR n > 1").select(F.col("o").alias("canonical"))).distinct()


def type_expansion(matched: DataFrame, types: DataFrame, most: int = 10) -> DataFrame:
    """Other entities of the matched entities' types, at most `most` pairs."""
    mine = types.join(matched.select(F.col("canonical").alias("entity")), "entity", "left_semi").select("type").distinct()
    return types.join(mine, "type", "left_semi").join(matched.select(F.col("canonical").alias("entity")), "entity", "left_anti").select("entity", "type").orderBy("entity", "type").limit(most)


def token_overlap(matched: DataFrame, canonicals: DataFrame, common: int = DEFAULTS["overlap_threshold"], most: int = DEFAULTS["overlap_max"]) -> DataFrame:
    """For each matched name of several `_`-parts, names that share a part held by at most `common` names."""
    parts = canonicals.select("canonical", F.explode(F.array_distinct(F.split("canonical", "_"))).alias("part")).filter("part != ''")
    rare = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= common).select("part")
    mine = matched.select(F.col("canonical").alias("source"), F.posexplode(F.split("canonical", "_")).alias("pos", "part"), F.size(F.split("canonical", "_")).alias("k")).filter("k > 1").drop("k")
    hits = mine.join(rare, "part").join(parts, "part").join(matched.select("canonical"), "canonical", "left_anti")
    first = hits.groupBy("source", "canonical").agg(F.min(F.struct("pos", "part")).alias("via"))
    w = Window.partitionBy("source").orderBy("via.pos", "canonical")
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("source", "canonical", F.col("via.part").alias("via"))


def days_since(col: Column, as_of: str) -> Column:
    """Fractional days from a time to as_of."""
    secs = F.expr(f"timestamp_ntz'{as_of}'").cast("timestamp").cast("double") - col.cast("timestamp").cast("double")
    return secs / 86400.0


def graph_facts(
    edges: DataFrame, entities: DataFrame, routed: list[str], as_of: str, semantic: DataFrame | None = None, overlap: DataFrame | None = None, types: DataFrame | None = None,
    top_k: int = DEFAULTS["graph_top_k"], per_entity: int = DEFAULTS["graph_top_k_per_entity"], per_predicate: int = DEFAULTS["graph_predicate_top_k"],
) -> DataFrame:
    """The hybrid ranker: candidates from entities, meaning and routed predicates, scored with reasons.

    entities: column entity; overlap: entity and via (those reached by shared name parts, and the part);
    types: entity and type (entities reached by their type); semantic: s, p, o, sem. why lists the
    reasons, joined by commas.
    Without routed predicates the fallback rules hold: overlap-only edges count half, semantic ones by
    their similarity, and with no candidate at all the latest edges are taken.
    """
    active = edges.filter("status = 'active'").withColumn("conf", confidence(F.col("pos"), F.col("neg")))
    names = entities.select("entity", F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("type"))
    if overlap is not None:
        names = names.unionByName(overlap.select("entity", "via"), allowMissingColumns=True)
    if types is not None:
        names = names.unionByName(types.select("entity", "type"), allowMissingColumns=True)
    # an entity that a part reached is anchored by that part alone, whatever else names it
    names = names.groupBy("entity").agg(F.collect_set("via").alias("vias"), F.collect_set("type").alias("types"))
    ends = active.select("*", F.explode(F.array_distinct(F.array("s", "o"))).alias("entity")).join(names, "entity")
    w = Window.partitionBy("entity").orderBy(F.col("conf").desc(), F.col("last_reinforced").desc_nulls_last(), *KEY)
    of_entity = ends.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_entity).select(*KEY, F.lit(True).alias("ent"), (F.size("vias") == 0).alias("direct"), F.lit(0.0).alias("sem"), F.lit(False).alias("seed"), "vias", "types")
    parts = [of_entity]
    none = F.lit(False)
    if semantic is not None:
        parts.append(semantic.select(*KEY, none.alias("ent"), none.alias("direct"), "sem", none.alias("seed")))
    if routed:
        hit = active.filter(F.col("p").isin(*routed)).orderBy(F.col("conf").desc(), F.col("last_seen").desc_nulls_last(), *KEY).limit(per_predicate)
        parts.append(hit.select(*KEY, none.alias("ent"), none.alias("direct"), F.lit(0.0).alias("sem"), none.alias("seed")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    if not routed and semantic is None and found.isEmpty():
        seed = recency_seed(edges, top_k).select(*KEY, none.alias("ent"), none.alias("direct"), F.lit(0.0).alias("sem"), F.lit(True).alias("seed"))
        found = found.limit(0).unionByName(seed, allowMissingColumns=True)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    grouped = found.groupBy(*KEY).agg(F.max("ent").alias("ent"), F.max("direct").alias("direct"), F.max("sem").alias("sem"), F.max("seed").alias("seed"), every("vias"), every("types"))
    full = grouped.join(active.select(*KEY, "pos", "neg", "conf", "last_seen", "derived"), KEY)
    days = days_since(F.col("last_seen"), as_of)
    r = F.exp(-F.coalesce(days, F.lit(0.0)) / DEFAULTS["recency_days"])
    cr = F.col("conf") * r
    meant = F.col("sem") > 0
    if routed:
        score = cr * F.when(meant, F.col("sem")).otherwise(1.0) * F.when(F.col("p").isin(*routed), DEFAULTS["predicate_boost"]).otherwise(1.0)
    else:
        score = F.when(F.col("ent") & F.col("direct"), cr).when(F.col("ent"), DEFAULTS["overlap_weight"] * cr).when(meant, F.col("sem") * cr).otherwise(cr)
    said = lambda cond, *codes: F.when(cond, F.array(*codes)).otherwise(F.array().cast("array<string>"))
    each = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    by_part = F.lit(not routed) & F.col("ent") & ~F.col("direct")
    no_route = F.lit(not routed)
    why = F.concat(
        said(by_part, F.lit("fallback:entity_anchored:overlap")), F.when(by_part, each("overlap_via:", "vias")).otherwise(F.array().cast("array<string>")),
        said(no_route & F.col("ent") & F.col("direct"), F.lit("fallback:entity_anchored")),
        said(no_route & ~F.col("ent") & meant, F.lit("fallback:semantic")), said(no_route & ~F.col("ent") & ~meant, F.lit("fallback:recency")),
        said(meant, F.format_string("semantic_%.2f", "sem")),
        said(F.col("p").isin(*routed) if routed else F.lit(False), F.concat(F.lit("predicate:"), F.col("p"))),
        each("entity_type:", "types"),
        said(F.coalesce(days, F.lit(0.0)) <= DEFAULTS["recent_days"], F.concat(F.lit("recency_"), F.bround(F.coalesce(days, F.lit(0.0))).cast("int").cast("string"), F.lit("d"))),
        said(F.col("ent"), F.lit("entity_match")),
    )
    return full.select(*KEY, "pos", "neg", "conf", score.alias("score"), F.array_join(why, ",").alias("why"), "derived").orderBy(F.round("score", 9).desc(), *KEY).limit(top_k)


def recency_seed(edges: DataFrame, limit: int = DEFAULTS["graph_top_k"]) -> DataFrame:
    return edges.filter("status = 'active'").orderBy(F.col("last_seen").desc_nulls_last(), *KEY).limit(limit)
