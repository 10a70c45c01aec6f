"""From messages to chunks: carried assistant turns, salience, baseline picks and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions.ranking import nth

from engramix.functions import text as T


def salient_chunks(messages: DataFrame, min_chars: int = 30, triggers: bool = True) -> DataFrame:
    """One chunk per user turn worth extraction, together with the last assistant turn before it in the session.

    Without triggers a turn counts by its length alone, whatever it says.
    """
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    spoken = F.last(F.when(F.col("role") == "assistant", F.struct("id", "content")), ignorenulls=True).over(w)
    rows = messages.withColumn("said", spoken).filter(F.col("role") == "user").withColumn("salience_reason", T.salience_reason(F.col("content"), min_chars, triggers)).filter("salience_reason is not null")
    start = F.coalesce(F.col("said.id"), F.col("id"))
    return rows.select(
        T.chunk_id(F.col("session_id"), start, F.col("id")).alias("chunk_id"), "session_id", start.alias("start_message_id"), F.col("id").alias("end_message_id"), "salience_reason",
        F.concat_ws("\n", F.concat(F.lit("assistant: "), F.col("said.content")), F.concat(F.lit("user: "), F.col("content"))).alias("text"), "created_at",
    )


def persist_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those of new whose id is not there yet (one row each)."""
    return old.unionByName(new.dropDuplicates(["chunk_id"]).join(old.select("chunk_id"), "chunk_id", "left_anti"))


def baseline_chunks(chunks: DataFrame, processed: DataFrame, version: str, limit: int = 10) -> DataFrame:
    """Per session the newest chunks not processed under this prompt version."""
    done = processed.filter(F.col("prompt_version") == version).select("chunk_id")
    w = Window.partitionBy("session_id").orderBy(F.col("end_message_id").desc())
    return chunks.join(done, "chunk_id", "left_anti").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def budgeted_chunks(chunks: DataFrame, processed: DataFrame, sessions: DataFrame, version: str, budget: int = 50) -> DataFrame:
    """The first chunks of the cycle, sessions by start; processed ones cost nothing. A top-k, so no global window."""
    done = processed.filter(F.col("prompt_version") == version).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti").join(sessions.select("session_id", "started_at"), "session_id").orderBy("started_at", "session_id", "end_message_id").limit(budget)


def page(messages: DataFrame, session: str, number: int, size: int) -> DataFrame:
    """A page of a session's messages by id.

    Its first and last id are found by counting ids, of which no row is sorted or moved; then only
    what lies between them is read, which file statistics of ids and sessions tell apart.
    """
    if size < 1 or number < 1:
        raise ValueError("size and page start at 1")
    mine = messages.filter(F.col("session_id") == session)
    ids = mine.select("id")
    total, before = ids.count(), (number - 1) * size
    if before >= total:
        return mine.limit(0)
    low = nth(ids, before + 1, "id")[0][0] if before else None
    high = nth(ids, before + size, "id")[0][0] if before + size < total else None
    for bound in ([F.col("id") >= low] if low is not None else []) + ([F.col("id") <= high] if high is not None else []):
        mine = mine.filter(bound)
    return mine.orderBy("id").limit(size)


def page_after(messages: DataFrame, session: str, after: int | None, size: int) -> DataFrame:
    """The next `size` messages of a session behind an id (None: from its first), for readers that go on from page to page."""
    mine = messages.filter(F.col("session_id") == session)
    return (mine if after is None else mine.filter(F.col("id") > after)).orderBy("id").limit(size)


def recent(messages: DataFrame, session: str, n: int = 20) -> DataFrame:
    return messages.filter(F.col("session_id") == session).orderBy(F.col("id").desc()).limit(n).orderBy("id")
