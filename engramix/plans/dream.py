"""One dream cycle: from new messages to a consolidated graph, written as a single commit.

Model calls are made once per chunk or session and their answers are written before anything reads
them twice. What fails is left out of the ledger and so comes again in the next cycle.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix import prompts
from engramix.clients import LLM, Embedder, ask, embed
from engramix.operators import chunking, consolidation, extraction, graph, index, ingest, narrative
from engramix.operators import vectors as nearest
from engramix.sources.checkpoint import cut
from engramix.sources.store import STALE_SECONDS, Conflict, MemoryStore
from engramix.vocabulary import DEFAULTS

VERSION = "v1"  # of the prompts; a new one makes every chunk due again
KEY = ["s", "p", "o"]


@dataclass(frozen=True)
class Config:
    min_chars: int = DEFAULTS["salience_min_chars"]
    budget: int = DEFAULTS["dream_budget"]
    max_chunks: int = DEFAULTS["max_chunks"]
    retention_days: int = DEFAULTS["retention_days"]
    window_days: int = DEFAULTS["decay_window"]
    retract_below: float = DEFAULTS["retract_threshold"]
    negatives: int = 10
    index_from: int = 10_000  # vectors, before they are put into cells
    prompt_version: str = VERSION


@dataclass
class Report:
    run_id: str
    skipped: bool = False
    counts: dict[str, int] = field(default_factory=dict)


def negative_examples(feedback: DataFrame, most: int) -> list[tuple[str, str, str]]:
    rows = feedback.orderBy(F.col("created_at").desc(), *KEY).limit(most).collect()
    return [(r["s"], r["p"], r["o"]) for r in rows]


def canonical_triples(found: DataFrame, aliases: DataFrame, as_of: str) -> DataFrame:
    """Validated triples with canonical ends."""
    named = ingest.resolve(ingest.resolve(found, "subject", aliases, "s"), "object", aliases, "o")
    return named.filter("s <> '' AND o <> ''").select(
        "s", F.col("predicate").alias("p"), "o", "chunk_id", "polarity", F.col("subject").alias("surface_s"), F.col("object").alias("surface_o"),
        "value_text", "value_numeric", "value_unit", "temporal_scope", ingest.at(as_of).alias("ts"),
    )


def new_aliases(aliases: DataFrame, triples: DataFrame) -> DataFrame:
    """All aliases with each surface's normal form put to its canonical."""
    surface = triples.select(F.explode(F.array(F.struct(F.col("surface_s").alias("x"), F.col("s").alias("canonical")), F.struct(F.col("surface_o").alias("x"), F.col("o").alias("canonical")))).alias("r")).select("r.*")
    put = surface.select(graph.normalize(F.col("x")).alias("alias"), "canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return aliases.join(put, "alias", "left_anti").unionByName(put)


def new_types(types: DataFrame, hints: DataFrame, aliases: DataFrame) -> DataFrame:
    """All types; a hinted (entity, type) that is there already stays as it is."""
    named = ingest.resolve(hints, "surface", aliases, "entity").filter("entity <> ''").groupBy("entity", "type").agg(F.min("chunk_id").alias("chunk_id"))
    fresh = named.join(types.select("entity", "type"), ["entity", "type"], "left_anti").withColumn("confidence", F.lit(1.0))
    return types.unionByName(fresh)


def merged_evidence(old: DataFrame, triples: DataFrame) -> DataFrame:
    """One row per edge, chunk and polarity; an older row stays."""
    fresh = triples.dropDuplicates([*KEY, "chunk_id", "polarity"]).join(old.select(*KEY, "chunk_id", "polarity"), [*KEY, "chunk_id", "polarity"], "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What makes new of old, both with one row a key: the rows that came or differ, and the keys that went."""
    cols = [f for f in old.schema if f.name not in key]
    was = old.select(*key, F.struct(*[f.name for f in cols]).alias("_old"))
    now = new.select(*key, F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in cols]).alias("_new"))
    both = cut(was.join(now, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))))
    return both.filter("_new IS NOT NULL").select(*key, "_new.*"), both.filter("_new IS NULL").select(*key)


def dream(store: MemoryStore, llm: LLM, as_of: str, embedder: Embedder | None = None, sessions: list[str] | None = None, config: Config = Config()) -> Report:
    """Run a cycle. A held lock makes it a recorded skip; an error is recorded and raised again."""
    run_id = uuid.uuid4().hex
    spark = store.spark

    def record(**values) -> DataFrame:
        cols = {"run_id": run_id, "skipped": False, "error": None, **values}
        row = spark.range(1).select(ingest.at(as_of).alias("started_at"), *[F.lit(v).alias(k) for k, v in cols.items()])
        return row

    if not store.acquire(run_id):
        store.commit(append={"dream_runs": record(skipped=True)})
        return Report(run_id, skipped=True)
    ended = threading.Event()

    def renew() -> None:
        while not ended.wait(STALE_SECONDS / 5) and store.renew(run_id):
            pass

    threading.Thread(target=renew, daemon=True).start()
    try:
        version = store.manifest()["version"]
        counts, put, delete, append = _cycle(store, version, llm, as_of, embedder, sessions, config)
        # what others wrote since is kept: see MemoryStore.commit
        store.commit(put=put, delete=delete, append=append | {"dream_runs": record(**counts)}, base=version, holder=run_id)
        with contextlib.suppress(Conflict):  # another process compacts
            store.tidy()
        return Report(run_id, counts=counts)
    except Conflict:
        raise
    except Exception as e:
        store.commit(append={"dream_runs": record(error=f"{type(e).__name__}: {e}"[:500])})
        raise
    finally:
        ended.set()
        store.release(run_id)


def mention_backfill(mentions: DataFrame, chunks: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """mentions, and where there are none those of all chunks: a store that kept chunks before it kept mentions."""
    return mentions if not mentions.isEmpty() else ingest.mention_index(chunks, aliases, edges)


def index_changes(chunks: DataFrame, posted: DataFrame, sizes: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What to put into the text index and to delete from it, so that it holds exactly chunks (chunk_id, text). Texts that it holds are not read again."""
    new = cut(chunks.select("chunk_id", "text").join(sizes.select("chunk_id"), "chunk_id", "left_anti"))
    gone = cut(sizes.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
    put = {"postings": index.postings(new, "chunk_id"), "lengths": index.lengths(new, "chunk_id")}
    return put, {} if gone.isEmpty() else {"postings": posted.join(gone, "chunk_id", "left_semi"), "lengths": gone}


def _cycle(store: MemoryStore, version: int, llm: LLM, as_of: str, embedder: Embedder | None, ids: list[str] | None, config: Config):
    """Counts, and what to put, delete and append. All of it is new or changed rows: a cycle writes no more of the store than it brings."""
    table = lambda name: store.table(name, version)  # noqa: E731  every read of a cycle sees one version
    sessions, messages, aliases, old_edges = table("sessions"), table("messages"), table("aliases"), table("edges")
    if ids is not None:
        sessions = sessions.filter(F.col("session_id").isin(ids))
    mine = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    without = lambda df, other, *key: df.join(other.select(*key), list(key), "left_anti")

    # phase 1: chunks, then facts and markers of those that are due
    salient, done = chunking.salient_chunks(mine, config.min_chars), table("processed")
    new_chunks = cut(without(salient, table("chunks"), "chunk_id").select(table("chunks").columns))
    chunks = table("chunks").unionByName(new_chunks)
    # the baseline picks of a session are among these, as both ask for the same length of a turn
    due = cut(chunking.budgeted_chunks(salient, done, sessions, config.prompt_version, config.budget).select(salient.columns))
    feedback = table("feedback")
    warned = prompts.triples_with(negative_examples(feedback, config.negatives))
    answers = cut(ask(due.select("chunk_id", "text"), llm, {"triples": (warned, True), "markers": (prompts.MARKERS, True)}))
    good = answers.filter("failed IS NULL")
    processed = good.select("chunk_id", F.lit(config.prompt_version).alias("prompt_version"))
    triples = cut(canonical_triples(extraction.validate_triples(good.select("chunk_id", "triples"), "triples"), aliases, as_of))
    hints = extraction.entity_type_hints(good.select("chunk_id", "triples"), "triples")
    named = cut(new_aliases(aliases, triples))
    types = changes(table("types"), new_types(table("types"), hints, named), ["entity", "type"])
    new_evidence = cut(without(merged_evidence(table("evidence"), triples), table("evidence"), *KEY, "chunk_id", "polarity"))
    evidence = table("evidence").unionByName(new_evidence)
    edges = cut(graph.upsert(old_edges, triples))
    found = ingest.mention_index(salient, named, edges).unionByName(triples.select("chunk_id", F.explode(F.array("s", "o")).alias("entity")))
    if table("mentions").isEmpty():
        found = found.unionByName(mention_backfill(table("mentions"), chunks, named, edges))
    new_mentions = cut(without(found.distinct(), table("mentions"), "chunk_id", "entity"))
    mentions = table("mentions").unionByName(new_mentions)
    raw_markers = cut(extraction.validate_markers(good.select("chunk_id", "markers"), "markers").select(F.concat_ws("#", "chunk_id", F.lpad(F.col("n").cast("string"), 6, "0")).alias("id"), "kind", "statement", "chunk_id", ingest.at(as_of).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("consolidated_at")))

    # sessions with chunks of this cycle: episodes and summary, then procedures from the episodes
    active = due.select("session_id").distinct()
    texts = narrative.session_text(mine.join(active, "session_id", "left_semi"), 8000)
    told = cut(ask(texts, llm, {"episodes": (prompts.EPISODES, True), "summary": (prompts.SUMMARY, False)}))
    ok = told.filter("failed IS NULL")
    new_episodes = cut(narrative.validate_episodes(ok.select("session_id", F.col("episodes").alias("raw"))).withColumn("created_at", ingest.at(as_of)))
    joined = new_episodes.groupBy("session_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("episode_id", "title", "summary"))), lambda x: F.concat(x["title"], F.lit(": "), x["summary"])), "\n---\n"), F.lit(12000)).alias("text"))
    how = cut(ask(joined, llm, {"procedures": (prompts.PROCEDURES, True)}))
    new_procedures = cut(narrative.validate_procedures(how.filter("failed IS NULL").select("session_id", F.col("procedures").alias("raw"))).withColumn("created_at", ingest.at(as_of)))
    summaries = ok.select("session_id", narrative.clean_summary(F.col("summary")).alias("_summary")).filter("_summary IS NOT NULL")
    told_sessions = table("sessions").join(summaries, "session_id").withColumn("summary", F.col("_summary")).drop("_summary")

    # phase 2: the profile
    pending = cut(table("markers").filter("consolidated_at IS NULL").unionByName(raw_markers))
    profile = (table("profile").limit(0), table("profile").limit(0)) if pending.isEmpty() else changes(table("profile"), consolidation.consolidate_profile(table("profile"), pending, as_of), ["text"])

    # phase 3: the graph ages
    edges = cut(graph.reinforce(edges, mentions, chunks, evidence, as_of, config.window_days))
    edges = cut(graph.decay(edges, mentions, chunks, evidence, as_of, config.window_days))
    wrong = graph.retraction_feedback(edges, evidence).join(chunks.select("chunk_id", "text"), "chunk_id", "left").select("chunk_id", F.left("text", F.lit(600)).alias("snippet"), *KEY, F.lit("auto_retract").alias("kind"), ingest.at(as_of).alias("created_at"))
    before = edges
    edges = graph.auto_retract(edges)
    # the closure at the usual threshold is kept, with the hops that it was made from, as edges may change between cycles
    closure, derived = None, {}
    if config.retract_below == DEFAULTS["retract_threshold"]:
        hops = cut(graph.hops(graph.dependencies(edges), config.retract_below))
        closure = graph.updated_closure(table("closure"), table("closure_hops"), hops, config.retract_below)
        derived = {"closure": changes(table("closure"), closure, ["s", "o"]), "closure_hops": changes(table("closure_hops"), hops, ["s", "o"])}
    edges = cut(graph.inferred_edges(edges, config.retract_below, closure).withColumns({c: F.coalesce(c, ingest.at(as_of)) for c in ("first_seen", "last_seen", "last_reinforced")}))
    retracted = before.filter("status = 'active' AND NOT derived").filter(graph.is_spent()).count()
    moved = changes(old_edges, edges, KEY)
    gone = cut(consolidation.retired_chunks(chunks, evidence, edges, as_of, config.max_chunks, config.retention_days))
    kept = without(chunks, gone, "chunk_id")
    of_gone = lambda df: df.join(gone, "chunk_id", "left_semi")

    texts_put, texts_gone = index_changes(kept, table("postings"), table("lengths"))
    put = {
        "sessions": told_sessions, "chunks": without(new_chunks, gone, "chunk_id"), "processed": without(processed, gone, "chunk_id"), "mentions": without(new_mentions, gone, "chunk_id"),
        "evidence": without(new_evidence, gone, "chunk_id"), "aliases": without(named, aliases, "alias"), "types": types[0], "edges": moved[0], "markers": pending.withColumn("consolidated_at", ingest.at(as_of)),
        "profile": profile[0], "episodes": new_episodes, "procedures": new_procedures, **texts_put, **{n: x[0] for n, x in derived.items()},
    }
    delete = {"edges": moved[1], "profile": profile[1], **texts_gone, **{n: x[1] for n, x in derived.items()}}
    for kind, notes in (("episode", narrative.episode_texts(new_episodes)), ("procedure", narrative.procedure_texts(new_procedures))):
        for side, more in zip((put, delete), index.note_changes(kind, notes, table("note_postings"), table("note_blocks")), strict=True):
            for n, df in more.items():
                side[n] = side[n].unionByName(df) if n in side else df
    if not gone.isEmpty():
        delete |= {"chunks": gone, **{n: of_gone(table(n)) for n in ("processed", "mentions", "evidence", "chunk_vectors")}}
    if embedder is not None:
        # vectors of this model in another dimension than it gives now are made anew
        dim = len(embedder.embed(["dimension"])[0])
        fits = (F.col("model") != embedder.model) | (F.col("dim") == dim)
        vectors = table("chunk_vectors").filter(fits)
        new_vectors = cut(embed(extraction.pending_embeddings(kept.select("chunk_id", "text"), vectors, "chunk_id", embedder.model), embedder, "text"))
        held = without(vectors.filter(F.col("model") == embedder.model), gone, "chunk_id")
        put["chunk_vectors"], cells = nearest.kept_index(held, new_vectors, table("cells"), embedder.model, dim, config.index_from)
        if cells is not None:
            put["cells"], delete["cells"] = cells, without(table("cells").filter(F.col("model") == embedder.model), cells, "model", "cell")
        wanted = edges.filter("status = 'active'").select(F.concat_ws(" ", *KEY).alias("edge_text")).distinct()
        have = table("edge_vectors").filter((F.col("model") == embedder.model) & fits)
        put["edge_vectors"] = cut(embed(without(wanted, have, "edge_text").withColumn("text", F.col("edge_text")), embedder, "text"))
        delete["edge_vectors"] = without(table("edge_vectors"), wanted, "edge_text")
    counts = {
        "chunks_seen": salient.count(), "chunks_processed": good.count(), "triples": triples.count(), "markers": raw_markers.count(), "retracted": retracted,
        "edges": edges.filter("NOT derived").count(), "derived": edges.filter("derived").count(), "profile_entries": table("profile").join(profile[1], "text", "left_anti").select("text").unionByName(profile[0].select("text")).distinct().count(),
    }
    return counts, put, delete, {"feedback": wrong}
