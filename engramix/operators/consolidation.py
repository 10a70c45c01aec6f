"""Consolidation and retention: insights, profile entries, pruning of old chunks."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions.ranking import first_rows
from engramix.functions.text import confidence
from engramix.sources.checkpoint import cut
from engramix.vocabulary import DEFAULTS, MARKER_PROFILE



def _base():
    return (F.col("status") == "active") & ~F.col("derived")


def dependency_hubs(edges: DataFrame, least: float = 0.6, subjects: int = 2, limit: int | None = DEFAULTS["insights_max"]) -> DataFrame:
    out = edges.filter(_base() & (F.col("p") == "depends_on") & (confidence(F.col("pos"), F.col("neg")) > least)).groupBy("o").agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("subjects"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= subjects)
    return out.orderBy(F.col("n").desc(), "o").limit(limit) if limit else out


def strong_preferences(edges: DataFrame, least: float = 0.7, limit: int = DEFAULTS["insights_max"]) -> DataFrame:
    return edges.filter(_base() & F.col("p").isin("prefers", "rejects", "avoids") & (confidence(F.col("pos"), F.col("neg")) > least)).orderBy(F.col("pos").desc(), F.col("last_reinforced").desc_nulls_last(), "s", "p", "o").limit(limit)


def contradictions(edges: DataFrame, limit: int = 5) -> DataFrame:
    return edges.filter(_base() & (F.col("pos") >= 1) & (F.col("neg") >= 1)).orderBy((F.col("pos") + F.col("neg")).desc(), "s", "p", "o").limit(limit)


def insights(edges: DataFrame, limit: int = DEFAULTS["insights_max"]) -> DataFrame:
    """section, rank and line of the insight list: hubs, then preferences, then contradictions, cut at limit."""
    a = dependency_hubs(edges).select(F.lit(1).alias("section"), F.struct(-F.col("n"), F.col("o")).cast("string").alias("k"), F.row_number().over(Window.orderBy(F.col("n").desc(), "o")).alias("rank"), F.concat(F.col("o"), F.lit(" <- "), F.col("subjects")).alias("line")).drop("k")
    fact = F.concat_ws(" ", "s", "p", "o")
    b = strong_preferences(edges).select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy(F.col("pos").desc(), F.col("last_reinforced").desc_nulls_last(), "s", "p", "o")).alias("rank"), F.concat(fact, F.lit(" (evidence "), F.col("pos"), F.lit("/"), F.col("pos") + F.col("neg"), F.lit(")")).alias("line"))
    c = contradictions(edges).select(F.lit(3).alias("section"), F.row_number().over(Window.orderBy((F.col("pos") + F.col("neg")).desc(), "s", "p", "o")).alias("rank"), F.concat(fact, F.lit(" (+"), F.col("pos"), F.lit(" / -"), F.col("neg"), F.lit(")")).alias("line"))
    return a.unionByName(b).unionByName(c).orderBy("section", "rank").limit(limit)


def consolidate_profile(profile: DataFrame, markers: DataFrame, as_of: str, most: int = DEFAULTS["profile_max"]) -> DataFrame:
    """profile (kind, text, pos, neg, first_seen, last_updated) with pending markers (id, kind, statement) merged, the weakest beyond `most` dropped."""
    kind = F.create_map(*[F.lit(x) for kv in MARKER_PROFILE.items() for x in kv])
    now = F.expr(f"timestamp_ntz'{as_of}'")
    new = markers.groupBy(F.col("statement").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min_by("kind", "id").alias("first_kind"))
    merged = profile.join(new, "text", "full_outer").select(
        F.coalesce("kind", kind[F.col("first_kind")]).alias("kind"), "text", (F.coalesce("pos", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("pos"),
        F.coalesce("neg", F.lit(0)).cast("long").alias("neg"), F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("n").isNotNull(), now).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    return merged.orderBy(F.col("pos").desc(), F.col("last_updated").desc(), "text").limit(most)


def retired_chunks(chunks: DataFrame, evidence: DataFrame, edges: DataFrame, as_of: str, most: int = DEFAULTS["max_chunks"], days: int = DEFAULTS["retention_days"]) -> DataFrame:
    """Ids of the chunks that go: over capacity, the oldest that are neither recent nor evidence of an active edge."""
    excess = chunks.count() - most
    ids = chunks.select("chunk_id")
    if excess <= 0:
        return ids.limit(0)
    active = evidence.join(edges.filter("status = 'active'").select("s", "p", "o"), ["s", "p", "o"], "left_semi").select("chunk_id").distinct()
    old = cut(chunks.filter(F.col("created_at") < F.expr(f"timestamp_ntz'{as_of}' - make_dt_interval({days})")).select("created_at", "chunk_id").join(active, "chunk_id", "left_anti"))
    return first_rows(old, excess, "created_at", "chunk_id").select("chunk_id")


def prune_chunks(chunks: DataFrame, evidence: DataFrame, edges: DataFrame, as_of: str, most: int = DEFAULTS["max_chunks"], days: int = DEFAULTS["retention_days"]) -> DataFrame:
    """Chunks that stay: all but the retired ones."""
    return chunks.join(retired_chunks(chunks, evidence, edges, as_of, most, days), "chunk_id", "left_anti")


def _marks(section: str) -> re.Pattern:
    name = re.escape(section)
    return re.compile(rf"<!-- {name}:begin -->\n(.*?)\n?<!-- {name}:end -->", re.S)


def read_section(path: str, section: str) -> str | None:
    """The managed part of a Markdown file, None where there is none."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        m = _marks(section).search(f.read())
    return m[1] if m else None


def write_section(path: str, section: str, content: str, header: str = "") -> None:
    """Replace or append the managed part; the file is swapped in one step."""
    body = f"<!-- {section}:begin -->\n{content}\n<!-- {section}:end -->"
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    pattern = _marks(section)
    text = pattern.sub(lambda _: body, text, count=1) if pattern.search(text) else (text.rstrip("\n") + "\n\n" if text else f"{header}\n\n" if header else "") + body + "\n"
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)
