"""What a service layer answers with, as DataFrames: search, context, peer context, chat, health checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions.text import token_count
from engramix.operators import chunking, graph
from engramix.plans.augment import Context

FACT = lambda: F.concat_ws(" ", "s", "p", "o")


def message_page(messages: DataFrame, session: str, number: int, size: int) -> tuple[DataFrame, int, int]:
    """A page with token counts, the session's total and the number of pages."""
    rows = chunking.page(messages, session, number, size).withColumn("token_count", token_count(F.col("content")))
    total = messages.filter(F.col("session_id") == session).count()
    return rows, total, -(-total // size)


def search(context: Context, limit: int = 10) -> DataFrame:
    """kind, rank and content: facts first, then passages, cut at limit."""
    facts = context.facts.select(F.lit("fact").alias("kind"), F.lit(0).alias("section"), F.row_number().over(Window.orderBy(F.col("score").desc(), "s", "p", "o")).alias("rank"), FACT().alias("content"))
    return _sections(facts, _passages(context, 1, 600)).limit(limit)


def _passages(context: Context, section: int, width: int) -> DataFrame:
    better = F.when(F.col("score_kind") == "bm25", -F.col("score")).otherwise(F.col("score"))
    return context.passages.select(F.lit("passage").alias("kind"), F.lit(section).alias("section"), F.row_number().over(Window.orderBy(better.desc(), "chunk_id")).alias("rank"), F.left("text", F.lit(width)).alias("content"))


def _sections(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "rank").select("kind", "rank", "content")


def peer_context(context: Context, messages: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Passages with the role of the message they start at, then facts."""
    start = context.passages.join(chunks.select("chunk_id", "start_message_id"), "chunk_id").join(messages.select(F.col("id").alias("start_message_id"), "role"), "start_message_id", "left")
    better = F.when(F.col("score_kind") == "bm25", -F.col("score")).otherwise(F.col("score"))
    a = start.select(F.lit(0).alias("section"), F.row_number().over(Window.orderBy(better.desc(), "chunk_id")).alias("rank"), F.coalesce("role", F.lit("user")).alias("role"), F.left("text", F.lit(600)).alias("content"))
    b = context.facts.select(F.lit(1).alias("section"), F.row_number().over(Window.orderBy(F.col("score").desc(), "s", "p", "o")).alias("rank"), F.lit(None).cast("string").alias("role"), FACT().alias("content"))
    return a.unionByName(b).orderBy("section", "rank").limit(limit)


def session_context(sessions: DataFrame, messages: DataFrame, session: str, memory_md: str = "", n: int = 20) -> tuple[str, DataFrame, list[str]]:
    """The session's summary (else the memory notes), its last messages, and their roles as they first appear."""
    row = sessions.filter(F.col("session_id") == session).select("summary").first()
    last = chunking.recent(messages, session, n)
    roles = list(dict.fromkeys(r["role"] for r in last.select("role", "id").orderBy("id").collect()))
    return (row["summary"] if row and row["summary"] else memory_md), last, roles


def chat(context: Context) -> str:
    """Facts and passages of a message as prose lines; both lists are short by construction."""
    facts = [f"{r['s']} {r['p'].replace('_', ' ')} {r['o']} (confidence {r['conf']:.2f})" for r in context.facts.collect()]
    said = [r["content"] for r in _sections(_passages(context, 0, 300)).collect()]
    parts = (["Known facts:", *[f"- {x}" for x in facts]] if facts else []) + (["From past conversations:", *[f"- {x}" for x in said]] if said else [])
    return "\n".join(parts) or "Nothing is known about this yet."


def conflict_report(edges: DataFrame) -> DataFrame:
    """One row per conflict with its two facts as text."""
    c = graph.conflicts(edges)
    return c.select("kind", F.concat_ws(" ", "s", "p1", "o1").alias("fact1"), "conf1", F.concat_ws(" ", "s", "p2", "o2").alias("fact2"), "conf2")


def doctor(tables, dim: int | None = None) -> DataFrame:
    """Health checks over the tables: name, n and ok. A store with no row in one of them still gets every check."""
    edges, vectors = tables("edges"), tables("chunk_vectors")
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    drift = graph.canonical_drift(edges, tables("aliases"), tables("types"))
    parts = [count(drift.filter(F.col("place") == p), f"drift_{p}") for p in ("subject", "object", "alias", "type")]
    parts.append(count(vectors.filter(F.size("v") != (F.lit(dim) if dim else F.col("dim"))), "wrong_dimension"))
    parts.append(count(edges.filter("pos < 0 OR neg < 0"), "negative_support"))
    parts.append(count(tables("evidence").join(tables("chunks"), "chunk_id", "left_anti"), "evidence_without_chunk"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("n") == 0)


