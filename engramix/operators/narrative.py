"""Episodes, procedures and summaries of sessions: validation of model answers, and search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.operators.extraction import items, procedure_steps, string_member
from engramix.operators.retrieval import bm25

STRINGS = lambda path: F.coalesce(F.expr(f"filter(try_variant_get(item, '$.{path}', 'array<string>'), x -> trim(x) <> '')"), F.array().cast("array<string>"))


def session_text(messages: DataFrame, most: int) -> DataFrame:
    """session_id and the conversation as one text, role by role in order, cut at `most` characters as model prompts are."""
    line = F.concat("role", F.lit(": "), "content")
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.char_length(line) + 1).over(w), F.lit(0))
    # lines that begin beyond the cut never reach the group's buffer; one that begins just there still brings its line break
    kept = messages.select("session_id", "id", line.alias("line"), before.alias("before")).filter(F.col("before") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("session_id").agg(F.left(text, F.lit(most)).alias("text"))


def validate_episodes(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Episodes with a title and a summary, numbered within their session: id `session@n`."""
    out = items(answers, raw).select("session_id", "n", string_member("title").alias("title"), string_member("summary").alias("summary"), string_member("outcome").alias("outcome"), STRINGS("key_entities").alias("key_entities"))
    good = out.filter("title is not null and summary is not null")
    k = F.row_number().over(Window.partitionBy("session_id").orderBy("n")) - 1
    return good.select(F.concat_ws("@", "session_id", k.cast("string")).alias("episode_id"), "session_id", "title", "summary", "outcome", "key_entities")


def validate_procedures(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Procedures with a name and valid steps, numbered within their session: id `session@procN`."""
    out = procedure_steps(answers, raw)
    k = F.row_number().over(Window.partitionBy("session_id").orderBy("n")) - 1
    return out.select(F.concat(F.col("session_id"), F.lit("@proc"), k.cast("string")).alias("procedure_id"), "session_id", "name", "description", "steps", "triggers", "entities")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; columns that one side lacks are null there."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def clean_summary(raw):
    """A summary without blanks and quotes around it, at most 500 characters; null under 10."""
    x = F.regexp_replace(F.trim(raw), r"""^["'\s]+|["'\s]+$""", "")
    return F.when(F.char_length(x) >= 10, F.left(x, F.lit(500)))


def episode_texts(episodes: DataFrame) -> DataFrame:
    return episodes.select(F.col("episode_id").alias("id"), F.concat_ws("\n", "title", "summary").alias("text"))


def procedure_texts(procedures: DataFrame) -> DataFrame:
    return procedures.select(F.col("procedure_id").alias("id"), F.concat_ws("\n", "name", "description", F.to_json("steps")).alias("text"))


def episode_search(episodes: DataFrame, query: str, top_k: int, stemmed: bool = True, hits: DataFrame | None = None) -> DataFrame:
    """The episodes whose title and summary fit best; summary cut for display. hits: id and score where an index found them."""
    hits = bm25(episode_texts(episodes), query, top_k, stemmed=stemmed) if hits is None else hits
    return hits.join(episodes, hits["id"] == episodes["episode_id"]).select("episode_id", "session_id", "title", F.left("summary", F.lit(300)).alias("summary"), "outcome", "score").orderBy("score", "episode_id")


def procedure_search(procedures: DataFrame, query: str, top_k: int, stemmed: bool = True, hits: DataFrame | None = None) -> DataFrame:
    """The procedures whose name, description and steps (as JSON) fit best."""
    hits = bm25(procedure_texts(procedures), query, top_k, stemmed=stemmed) if hits is None else hits
    return hits.join(procedures, hits["id"] == procedures["procedure_id"]).select("procedure_id", "session_id", "name", "description", "steps", "score").orderBy("score", "procedure_id")
