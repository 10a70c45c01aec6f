"""The full answer to one user message: passages, episodes, procedures, entities and graph facts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix import prompts
from engramix.clients import LLM, Embedder, Request
from engramix.functions import text as T
from engramix.operators import index, narrative, retrieval
from engramix.operators import vectors as inverted
from engramix.vocabulary import DEFAULTS


@dataclass
class Context:
    """Every member but the texts and routed is a short DataFrame."""

    passages: DataFrame  # chunk_id, session_id, text, score, score_kind
    facts: DataFrame  # s, p, o, pos, neg, conf, score, why
    episodes: DataFrame
    procedures: DataFrame
    entities: DataFrame  # entity, via (matched, type, overlap)
    routed: list[str]
    user_md: str = ""
    memory_md: str = ""


def _rated(query: str, hits: list, llm: LLM) -> list[tuple[str, int]]:
    """(id, relevance) by the model; empty where its answer is no array."""
    listing = "\n".join(f"[{i}] {h['text'][:400]}" for i, h in enumerate(hits))
    try:
        found = json.loads(llm.complete(Request("rerank", prompts.RERANK, f"Query: {query}\n\n{listing}")))
    except ValueError:
        return []
    if not isinstance(found, list):
        return []
    out = {}
    for x in found:
        if isinstance(x, dict) and isinstance(x.get("index"), int) and isinstance(x.get("relevance"), (int, float)) and 0 <= x["index"] < len(hits):
            out[hits[x["index"]]["id"]] = int(x["relevance"])
    return list(out.items())


def passages(chunks: DataFrame, vectors: DataFrame, message: str, embedder: Embedder | None, llm: LLM | None, top_k: int = DEFAULTS["fts_top_k"], posted: DataFrame | None = None, sizes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The best chunks: BM25 alone, or fused with the nearest vectors and, where both lists disagree closely, rated by the model.

    posted and sizes are the text index, cells that of the vectors; without one all texts or vectors are scanned.
    """
    spark = chunks.sparkSession
    if posted is None or sizes is None or sizes.isEmpty():
        hits = retrieval.bm25(chunks.select(F.col("chunk_id").alias("id"), "text"), message, top_k, stemmed=True)
    else:
        hits = index.bm25_indexed(posted, sizes, "chunk_id", " ".join(T.search_words(message)), top_k)
    kind = "bm25"
    if embedder is not None:
        q = embedder.embed([message])[0]
        mine = vectors.filter(F.col("model") == embedder.model)
        near = None if cells is None else inverted.nearest_kept(mine, cells.filter(F.col("model") == embedder.model), q, top_k)
        if near is None:
            near = retrieval.knn(mine.select(F.col("chunk_id").alias("id"), "v"), q, top_k)
        first, second = [r["id"] for r in hits.collect()], [r["id"] for r in near.collect()]  # top_k rows each
        ranks = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
        hits, kind = retrieval.rrf(ranks(first), ranks(second), top_k).select("id", "score"), "rrf"
        top = [(r["id"], r["score"]) for r in hits.collect()]
        if llm is not None and retrieval.should_rerank(first, second, top):
            texts = {r["chunk_id"]: r["text"] for r in chunks.filter(F.col("chunk_id").isin([i for i, _ in top])).select("chunk_id", "text").collect()}
            rated = _rated(message, [{"id": i, "text": texts.get(i) or ""} for i, _ in top], llm)
            if rated:
                hits = retrieval.rerank(hits, spark.createDataFrame(rated, "id string, relevance int"), top_k)
        return hits.join(chunks, hits["id"] == chunks["chunk_id"]).select("chunk_id", "session_id", "text", "score", F.lit(kind).alias("score_kind")).orderBy(F.col("score").desc(), "chunk_id")
    return hits.join(chunks, hits["id"] == chunks["chunk_id"]).select("chunk_id", "session_id", "text", "score", F.lit(kind).alias("score_kind")).orderBy("score", "chunk_id")


def expanded_entities(message: str, aliases: DataFrame, edges: DataFrame, types: DataFrame, common: int, most: int) -> DataFrame:
    """entity, how (matched, type, overlap), type and via: names of the message, others of their types, others that share a rare part (via) of a matched name. An entity may come in several ways."""
    asked = edges.sparkSession.createDataFrame([(message,)], "m string").select(F.explode(T.entity_candidates(F.col("m"))).alias("c"))
    matched = retrieval.match_entities(asked, aliases, edges, types)
    names = edges.filter("status = 'active'").select(F.explode(F.array("s", "o")).alias("canonical")).distinct()
    overlap = retrieval.token_overlap(matched, names, common, most).select(F.col("canonical").alias("entity"), F.lit("overlap").alias("how"), "via")
    by_type = retrieval.type_expansion(matched, types).select("entity", F.lit("type").alias("how"), "type")
    out = matched.select(F.col("canonical").alias("entity"), F.lit("matched").alias("how"))
    return out.unionByName(by_type, allowMissingColumns=True).unionByName(overlap, allowMissingColumns=True).distinct()


def semantic_edges(edges: DataFrame, vectors: DataFrame, q: list[float], top_k: int = DEFAULTS["graph_semantic_top_k"]) -> DataFrame:
    """s, p, o, sem of the active edges whose text lies nearest, over all of them; retrieval.cosine_edges scans the newest only."""
    e = edges.filter("status = 'active'").select("s", "p", "o", F.concat_ws(" ", "s", "p", "o").alias("id"))
    near = retrieval.knn(vectors.join(e, vectors["edge_text"] == e["id"], "left_semi").select(F.col("edge_text").alias("id"), "v"), q, top_k)
    return near.join(e, "id").select("s", "p", "o", F.col("score").alias("sem"))


def augment(tables, message: str, as_of: str, embedder: Embedder | None = None, llm: LLM | None = None, user_md: str = "", memory_md: str = "") -> Context:
    """tables: a function from a table's name to its DataFrame (MemoryStore.table)."""
    edges = tables("edges")
    names = expanded_entities(message, tables("aliases"), edges, tables("types"), DEFAULTS["overlap_threshold"], DEFAULTS["overlap_max"]).cache()
    routed = edges.sparkSession.createDataFrame([(message,)], "m string").select(T.route_predicates(F.col("m"))).first()[0]
    direct, over, typed = names.filter("how = 'matched'"), names.filter("how = 'overlap'"), names.filter("how = 'type'")
    semantic = None
    if embedder is not None and (routed or names.isEmpty()):  # with names and no route, names decide alone
        q = embedder.embed([message])[0]
        semantic = semantic_edges(edges, tables("edge_vectors").filter((F.col("model") == embedder.model) & (F.col("dim") == len(q))), q)
        semantic = None if semantic.isEmpty() else semantic
    noted = lambda kind: index.search_notes(kind, tables("note_postings"), tables("note_blocks"), tables("note_lengths"), " ".join(T.search_words(message)), DEFAULTS["fts_top_k"])
    return Context(
        passages(tables("chunks"), tables("chunk_vectors"), message, embedder, llm, posted=tables("postings"), sizes=tables("lengths"), cells=tables("cells")), retrieval.graph_facts(edges, direct, routed, as_of, semantic, over, typed),
        narrative.episode_search(tables("episodes"), message, DEFAULTS["fts_top_k"], hits=noted("episode")), narrative.procedure_search(tables("procedures"), message, DEFAULTS["fts_top_k"], hits=noted("procedure")),
        names.groupBy("entity").agg(F.min(F.array_position(F.array(F.lit("matched"), F.lit("type"), F.lit("overlap")), F.col("how"))).alias("k")).select("entity", F.element_at(F.array(F.lit("matched"), F.lit("type"), F.lit("overlap")), F.col("k").cast("int")).alias("via")), routed, user_md, memory_md,
    )
