"""The engine's front: one object over a store for logging, dreaming, asking and correcting."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramix.clients import LLM, Embedder
from engramix.operators import chunking, consolidation, graph, ingest
from engramix.plans import augment as answers
from engramix.plans import dream as cycles
from engramix.sources.store import KEYS, Conflict, MemoryStore
from engramix.streaming.sessions import dream_stream

log = logging.getLogger(__name__)

NO_SIGNALS = "_No behavioral signals collected yet._"
NO_INSIGHTS = "_No insights yet — the graph is still warming up._"


class Memory:
    def __init__(self, spark: SparkSession, root: str, llm: LLM | None = None, embedder: Embedder | None = None, notes: str | None = None):
        """notes: a local folder for USER.md and MEMORY.md; without one the two files are not kept."""
        self.spark, self.store, self.llm, self.embedder, self.notes = spark, MemoryStore(spark, root), llm, embedder, notes

    def _change(self, make: Callable[[int], object]):
        """Run make(version), which reads that version and commits on it; once more where others changed meanwhile what it read."""
        for _ in range(9):
            try:
                return make(self.store.manifest()["version"])
            except Conflict:
                continue
        return make(self.store.manifest()["version"])

    # ---- in
    def open_session(self, session: str, as_of: str) -> None:
        ids = self.spark.createDataFrame([(session,)], "session_id string")
        self._change(lambda v: self.store.commit(put={"sessions": ingest.open_sessions(self.store.table("sessions", v), ids, as_of)}, base=v))

    def close_session(self, session: str, as_of: str) -> None:
        ids = self.spark.createDataFrame([(session,)], "session_id string")
        self._change(lambda v: self.store.commit(put={"sessions": ingest.close_sessions(self.store.table("sessions", v).join(ids, "session_id", "left_semi"), ids, as_of)}, base=v))

    def log(self, turns: DataFrame, as_of: str, batch: tuple[str, int] | None = None) -> int:
        """Append turns (session_id, pos, role, content) in one commit, opening sessions as needed; returns how many."""
        if batch and batch[1] <= self.store.done(batch[0]):
            return 0

        def add(v: int) -> int:
            rows = ingest.append_messages(self.store.table("messages", v), turns, as_of)
            new = ingest.open_sessions(self.store.table("sessions", v), turns, as_of)
            self.store.commit(put={"sessions": new}, append={"messages": rows}, batch=batch, base=v, unchanged=["messages"])  # as ids go on from the last
            return rows.count()

        return self._change(add)

    def follow(self, turns: DataFrame, name: str, checkpoint: str, as_of: Callable[[], str], cooldown: str | None = "60 seconds") -> StreamingQuery:
        """Log a stream of turns and dream after each micro-batch, at most once per cooldown (None: once over what is there).

        A cycle that fails is recorded and leaves the turns logged; the next batch tries again.
        """

        def cycle(batch: DataFrame, number: int) -> None:
            now = as_of()
            self.log(batch, now, (name, number))
            if self.llm is not None:
                try:
                    self.dream(now)
                except Exception:  # recorded in dream_runs; ingestion goes on
                    log.exception("dream cycle failed")

        return dream_stream(turns, cycle, checkpoint, cooldown)

    def capture(self, payloads: DataFrame, as_of: str) -> tuple[int, list[str]]:
        """Log JSON conversations (session_id, raw); returns how many turns came in, and errors."""
        turns, errors = ingest.captured_turns(payloads)
        return self.log(turns, as_of), [r["error"] for r in errors.limit(100).collect()]

    def register_peers(self, new: DataFrame, as_of: str) -> None:
        self._change(lambda v: self.store.commit(put={"peers": cycles.changes(self.store.table("peers", v), ingest.register_peers(self.store.table("peers", v), new, as_of), KEYS["peers"])[0]}, base=v, unchanged=["peers"]))

    def add_messages(self, turns: DataFrame, workspace: str, as_of: str) -> int:
        """As log, with the role of each turn's peer_id."""
        return self.log(ingest.resolved_roles(turns, self.store.table("peers"), workspace), as_of)

    def upload(self, path: str, session: str, as_of: str, role: str = "user") -> int:
        return self.log(ingest.uploaded_turns(self.spark, path, session, role), as_of)

    # ---- consolidate
    def dream(self, as_of: str, sessions: list[str] | None = None, config: cycles.Config = cycles.Config()) -> cycles.Report:
        if self.llm is None:
            raise RuntimeError("dreaming needs a model")
        report = cycles.dream(self.store, self.llm, as_of, self.embedder, sessions, config)
        if self.notes and not report.skipped:
            self.write_notes()
        return report

    def write_notes(self) -> None:
        """The managed sections of both files: at most 16 profile entries and 12 insights."""
        os.makedirs(self.notes, exist_ok=True)
        entries = self.store.table("profile").orderBy(F.col("pos").desc(), F.col("last_updated").desc(), "text").limit(16).collect()
        lines = [f"- [{r['kind']}] {r['text']} _(confidence {(r['pos'] + 1) / (r['pos'] + r['neg'] + 2):.2f})_" for r in entries]
        consolidation.write_section(f"{self.notes}/USER.md", "profile", "\n".join(lines) or NO_SIGNALS, "# User")
        found = [f"- {r['line']}" for r in consolidation.insights(self.store.table("edges")).collect()]
        consolidation.write_section(f"{self.notes}/MEMORY.md", "insights", "\n".join(found) or NO_INSIGHTS, "# Memory")

    def note(self, name: str) -> str:
        path = f"{self.notes}/{name}" if self.notes else ""
        if not path or not os.path.exists(path):
            return ""
        with open(path, encoding="utf-8") as f:
            return f.read()

    def put_note(self, name: str, content: str) -> None:
        """Overwrite a note file in one step."""
        if not self.notes:
            raise ValueError("this memory keeps no notes")
        os.makedirs(self.notes, exist_ok=True)
        part = f"{self.notes}/.{name}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(part, f"{self.notes}/{name}")

    # ---- out
    def augment(self, message: str, as_of: str) -> answers.Context:
        version = self.store.manifest()["version"]
        return answers.augment(lambda n: self.store.table(n, version), message, as_of, self.embedder, self.llm, self.note("USER.md"), self.note("MEMORY.md"))

    def conflicts(self) -> DataFrame:
        return graph.conflicts(self.store.table("edges"))

    def messages(self, session: str, page: int = 1, size: int = 50) -> DataFrame:
        return chunking.page(self.store.table("messages"), session, page, size)

    def recent_runs(self, limit: int = 10) -> DataFrame:
        return self.store.table("dream_runs").orderBy(F.col("started_at").desc(), "run_id").limit(limit)

    # ---- correct
    def add_alias(self, surface: str, canonical: str) -> None:
        new = self.spark.createDataFrame([(surface, canonical)], "a string, c string").select(graph.normalize(F.col("a")).alias("alias"), graph.normalize(F.col("c")).alias("canonical"))
        self.store.commit(put={"aliases": new})

    def merge(self, keep: str, drop: str) -> None:
        """Rename a canonical in every table that holds one; what collides adds up."""
        name = lambda c: F.when(F.col(c) == drop, keep).otherwise(F.col(c))
        old_name = self.spark.createDataFrame([(drop, keep)], "alias string, canonical string")

        def rename(v: int) -> None:
            t = lambda n: self.store.table(n, v)
            self._rewrite(v, {
                "edges": graph.merge_canonical(t("edges"), keep, drop), "evidence": t("evidence").withColumn("s", name("s")).withColumn("o", name("o")).dropDuplicates(KEYS["evidence"]),
                "aliases": t("aliases").filter(F.col("alias") != drop).withColumn("canonical", name("canonical")).unionByName(old_name), "mentions": t("mentions").withColumn("entity", name("entity")).distinct(),
                "types": t("types").withColumn("entity", name("entity")).dropDuplicates(["entity", "type"]),
            })

        self._change(rename)

    def _rewrite(self, version: int, tables: dict[str, DataFrame]) -> None:
        """Commit the difference between tables as they were and as they are to be; none of them may have changed meanwhile."""
        moved = {n: cycles.changes(self.store.table(n, version), df, KEYS[n]) for n, df in tables.items()}
        self.store.commit(put={n: x[0] for n, x in moved.items()}, delete={n: x[1] for n, x in moved.items()}, base=version, unchanged=list(tables))

    def retract(self, subject: str, predicate: str, obj: str, as_of: str) -> bool:
        """Retract an active edge given by surface names, keeping its latest supporting texts as feedback; False if there is none."""
        names = self.spark.createDataFrame([(subject, obj)], "a string, b string")
        return self._change(lambda v: self._retract(v, names, subject, predicate, obj, as_of))

    def _retract(self, version: int, names: DataFrame, subject: str, predicate: str, obj: str, as_of: str) -> bool:
        t = lambda n: self.store.table(n, version)
        aliases = t("aliases")
        r = ingest.resolve(ingest.resolve(names, "a", aliases, "s"), "b", aliases, "o").first()
        s, o, edges = r["s"], r["o"], t("edges")
        this = (F.col("s") == s) & (F.col("p") == predicate) & (F.col("o") == o)
        if edges.filter(this & (F.col("status") == "active")).isEmpty():
            return False
        latest = t("evidence").filter(this & (F.col("polarity") == 1)).orderBy(F.col("ts").desc(), "chunk_id").limit(5).select("chunk_id")
        told = latest.join(t("chunks"), "chunk_id").select("chunk_id", F.left("text", F.lit(600)).alias("snippet"), F.lit(subject).alias("s"), F.lit(predicate).alias("p"), F.lit(obj).alias("o"), F.lit("manual_retract").alias("kind"), ingest.at(as_of).alias("created_at"))
        self.store.commit(put={"edges": graph.manual_retract(edges, s, predicate, o, as_of).filter(this)}, append={"feedback": told}, base=version, unchanged=["edges"])
        return True

    def repair_drift(self) -> DataFrame:
        """Put every stored name into its normal form; returns what drifted (place, v, normal) as it was."""
        norm = lambda c: graph.normalize(F.col(c))

        def repair(v: int) -> DataFrame:
            t = lambda n: self.store.table(n, v)
            self._rewrite(v, {
                "edges": graph.repair_drift(t("edges")), "evidence": t("evidence").withColumn("s", norm("s")).withColumn("o", norm("o")).dropDuplicates(KEYS["evidence"]),
                "aliases": t("aliases").select(norm("alias").alias("alias"), norm("canonical").alias("canonical")).groupBy("alias").agg(F.min("canonical").alias("canonical")),
                "mentions": t("mentions").withColumn("entity", norm("entity")).distinct(), "types": t("types").withColumn("entity", norm("entity")).dropDuplicates(["entity", "type"]),
            })
            return graph.canonical_drift(t("edges"), t("aliases"), t("types"))

        return self._change(repair)
