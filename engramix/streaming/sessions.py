"""Streaming forms: carried assistant turns per session, and dream cycles over micro-batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramix.vocabulary import CORRECTION, PREFERENCE


def session_activity(events: DataFrame, gap: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    """Sessions of each user by event time; with a watermark on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def dream_stream(messages: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, cooldown: str | None = "60 seconds") -> StreamingQuery:
    """Run cycle(batch, batch_id) at most once per cooldown (None: over what is there, then stop); the checkpoint makes each batch count once and one writer hold it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            cycle(batch, batch_id)

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**({"processingTime": cooldown} if cooldown else {"availableNow": True})).start()


CHUNK = "chunk_id string, session_id string, start_message_id long, end_message_id long, salience_reason string, text string, created_at timestamp"


def chunk_stream(messages: DataFrame, min_chars: int = 30) -> DataFrame:
    """Chunks of a message stream: the last assistant turn of each session is its state, carried over batches.

    Messages of a session are taken in id order within a batch; the state is one turn per session.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("id")
        out = []
        for r in rows.itertuples(index=False):
            if r.role == "assistant":
                said = (int(r.id), r.content)
            elif r.role == "user" and (reason := _reason(r.content, min_chars)):
                start = said[0] if said else int(r.id)
                text = (f"assistant: {said[1]}\n" if said else "") + f"user: {r.content}"
                name = "chk_" + hashlib.sha1(f"{key[0]}:{start}:{r.id}".encode()).hexdigest()
                out.append((name, key[0], start, int(r.id), reason, text, r.created_at))
        if said:
            state.update(said)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])

    typed = messages.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return typed.groupBy("session_id").applyInPandasWithState(step, CHUNK, "id long, content string", "append", GroupStateTimeout.NoTimeout)


def _reason(content: str, min_chars: int) -> str | None:
    if re.search(CORRECTION, content, re.I) or re.search(PREFERENCE, content, re.I):
        return "correction_or_preference_trigger"
    return "long_user_turn" if len(content) >= min_chars else None
