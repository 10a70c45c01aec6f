"""The knowledge graph: upsert, conflicts, merge, drift, reinforcement, decay, retraction, inference.

Edges have s, p, o, pos, neg, first_seen, last_seen, last_reinforced, status, derived. Every
operator that depends on the time takes it as as_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions.text import confidence, normalize
from engramix.sources.checkpoint import cut
from engramix.vocabulary import DEFAULTS, EXCLUSIVE, OPPOSING

KEY = ["s", "p", "o"]
PAIRED = 32  # mentions of a chunk, at most, of which all pairs are formed
NAMES = 500_000  # names mentioned in the window, at most, whose counts go to all executors


def _base() -> Column:
    return (F.col("status") == "active") & ~F.col("derived")


def upsert(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """Merge triples (s, p, o, chunk_id, polarity, ts) into edges.

    Support counts triples. A positive triple revives a retracted edge and renews last_reinforced; an
    edge that starts with negative triples only has its first time there too. Asserting a derived
    edge makes it a base edge.
    """
    new = triples.groupBy(*KEY).agg(
        F.count_if(F.col("polarity") == 1).alias("a"), F.count_if(F.col("polarity") == -1).alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.max(F.when(F.col("polarity") == 1, F.col("ts"))).alias("t2"),
    )
    zero = F.lit(0).cast("long")
    fresh = F.col("status").isNull()
    return edges.join(new, KEY, "full_outer").select(
        *KEY, (F.coalesce("pos", zero) + F.coalesce("a", zero)).alias("pos"), (F.coalesce("neg", zero) + F.coalesce("b", zero)).alias("neg"),
        F.coalesce("first_seen", "t0").alias("first_seen"), F.greatest("last_seen", "t1").alias("last_seen"),
        F.greatest("last_reinforced", F.coalesce("t2", F.when(fresh, F.col("t0")))).alias("last_reinforced"),
        F.when(fresh | (F.coalesce("a", zero) > 0), "active").otherwise(F.col("status")).alias("status"),
        (F.coalesce("derived", F.lit(False)) & F.col("t1").isNull()).alias("derived"),
    )


def evidence_rows(triples: DataFrame) -> DataFrame:
    """Distinct evidence per edge, chunk and polarity."""
    return triples.select(*KEY, "chunk_id", "polarity").distinct()


def competing_objects(edges: DataFrame, piece: int = 1000) -> DataFrame:
    """Pairs of objects of one subject and exclusive predicate.

    The objects of a pair (s, p) of many are dealt to pieces of about `piece`, and any two pieces meet
    once: so no join key makes more than piece * piece pairs, however many objects a subject has.
    """
    e = edges.filter(_base() & F.col("p").isin(*EXCLUSIVE)).select("s", "p", "o", "pos", "neg")
    some = e.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s", "p", F.ceil(F.col("n") / piece).cast("int").alias("k"))
    dealt = e.join(some, ["s", "p"]).withColumn("at", F.pmod(F.xxhash64("o"), F.col("k")).cast("int")).withColumn("conf", confidence(F.col("pos"), F.col("neg")))
    one = F.struct("o", "conf")
    a = dealt.select("s", "p", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("k") - 1)).alias("j"), one.alias("a"))
    b = dealt.select("s", "p", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), one.alias("b"))
    pairs = a.join(b, ["s", "p", "i", "j"]).filter("i < j AND a.o <> b.o OR a.o < b.o")
    first = F.col("a.o") < F.col("b.o")
    of = lambda c, low: F.when(first == F.lit(low), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return pairs.select(F.lit("competing_object").alias("kind"), "s", F.col("p").alias("p1"), of("o", True).alias("o1"), F.col("p").alias("p2"), of("o", False).alias("o2"), of("conf", True).alias("conf1"), of("conf", False).alias("conf2"))


def opposing_predicates(edges: DataFrame) -> DataFrame:
    """Pairs of opposing predicates between one subject and object."""
    e = edges.filter(_base() & F.col("p").isin(*{x for pair in OPPOSING for x in pair})).select("s", "p", "o", "pos", "neg")
    b = e.select("s", "o", F.col("p").alias("q"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2"))
    pair = F.lit(False)
    for x, y in OPPOSING:
        low, high = sorted((x, y))
        pair = pair | ((F.col("p") == low) & (F.col("q") == high))
    return e.join(b, ["s", "o"]).filter(pair).select(
        F.lit("opposing_predicate").alias("kind"), "s", F.col("p").alias("p1"), F.col("o").alias("o1"), F.col("q").alias("p2"), F.col("o").alias("o2"),
        confidence(F.col("pos"), F.col("neg")).alias("conf1"), confidence(F.col("pos2"), F.col("neg2")).alias("conf2"),
    )


def conflicts(edges: DataFrame) -> DataFrame:
    return competing_objects(edges).unionByName(opposing_predicates(edges))


def known_canonicals(edges: DataFrame) -> DataFrame:
    return edges.filter("status = 'active'").select(F.explode(F.array("s", "o")).alias("canonical")).distinct()


def canonical_drift(edges: DataFrame, aliases: DataFrame, types: DataFrame) -> DataFrame:
    """Stored names that differ from their normal form, by where they stand."""
    parts = [edges.select(F.lit("subject").alias("place"), F.col("s").alias("v")), edges.select(F.lit("object"), F.col("o")), aliases.select(F.lit("alias"), F.col("canonical")), types.select(F.lit("type"), F.col("entity"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().withColumn("normal", normalize(F.col("v"))).filter("v != normal")


def _regroup(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*KEY).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("last_reinforced").alias("last_reinforced"),
        F.min("status").alias("status"), F.min("derived").alias("derived"),
    )


def merge_canonical(edges: DataFrame, keep: str, drop: str) -> DataFrame:
    """Rename drop to keep; edges that collide add up."""
    put = lambda c: F.when(F.col(c) == drop, keep).otherwise(F.col(c))
    return _regroup(edges.withColumn("s", put("s")).withColumn("o", put("o")))


def repair_drift(edges: DataFrame) -> DataFrame:
    return _regroup(edges.withColumn("s", normalize(F.col("s"))).withColumn("o", normalize(F.col("o"))))


def _window(chunks: DataFrame, as_of: str, days: int) -> DataFrame:
    until = F.expr(f"timestamp_ntz'{as_of}'")
    return chunks.filter((F.col("created_at") <= until) & (F.col("created_at") >= until - F.expr(f"make_dt_interval({days})"))).select("chunk_id")


def _own(evidence: DataFrame, recent: DataFrame) -> DataFrame:
    """Distinct keys and chunks of the evidence in the window."""
    return evidence.join(recent, "chunk_id", "left_semi").select(*KEY, "chunk_id").distinct()


def _mentioned(mentions: DataFrame, recent: DataFrame) -> DataFrame:
    return cut(mentions.join(recent, "chunk_id", "left_semi").select("chunk_id", "entity").distinct())


def _named(m: DataFrame, entity: str, n: str) -> DataFrame:
    return m.groupBy(F.col("entity").alias(entity)).agg(F.count(F.lit(1)).alias(n))


def _pairs(m: DataFrame, edges: DataFrame) -> DataFrame:
    """s, o and n: in how many chunks both are mentioned, for all pairs that an edge may join.

    A chunk of few mentions gives all its pairs, which takes no look at the edges. In one of more than
    PAIRED each edge looks up the chunks of its rarer end, then the other end in those.
    """
    sized = m.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    of = m.join(sized.filter(F.col("n") <= PAIRED), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.collect_list("entity").alias("e"))
    found = of.select("e", F.explode("e").alias("s")).select("s", F.explode("e").alias("o")).groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))
    many = sized.filter(F.col("n") > PAIRED)
    if many.isEmpty():
        return found
    big = cut(m.join(many, "chunk_id", "left_semi"))
    ends = (
        edges.filter(_base()).select("s", "o").distinct().join(_named(big, "s", "ns"), "s").join(_named(big, "o", "no"), "o")
        .select("s", "o", F.when(F.col("ns") <= F.col("no"), F.col("s")).otherwise(F.col("o")).alias("rare"), F.when(F.col("ns") <= F.col("no"), F.col("o")).otherwise(F.col("s")).alias("other"))
    )
    more = ends.join(big.withColumnRenamed("entity", "rare"), "rare").join(big.withColumnRenamed("entity", "other"), ["chunk_id", "other"], "left_semi")
    return found.unionByName(more.groupBy("s", "o").agg(F.count(F.lit(1)).alias("n"))).groupBy("s", "o").agg(F.sum("n").alias("n"))


def _own_mentions(m: DataFrame, evidence: DataFrame, recent: DataFrame) -> DataFrame:
    """Keys of edges with how many of their evidence chunks in the window mention the subject (own_s), the object (own_o), both."""
    end = lambda c: m.select("chunk_id", F.col("entity").alias(c), F.lit(True).alias(f"has_{c}"))
    each = _own(evidence, recent).join(end("s"), ["chunk_id", "s"], "left").join(end("o"), ["chunk_id", "o"], "left")
    return each.groupBy(*KEY).agg(F.count("has_s").alias("own_s"), F.count("has_o").alias("own_o"), F.count_if(F.col("has_s") & F.col("has_o")).alias("both"))


def _more(n: str, own: str) -> Column:
    return F.coalesce(n, F.lit(0)) > F.coalesce(own, F.lit(0))


def _with_co_mentioned(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int) -> DataFrame:
    """edges with `hit`. What is counted lies in the window; the edges themselves are read once and listed per chunk nowhere."""
    recent = _window(chunks, as_of, days)
    m = _mentioned(mentions, recent)
    counted = edges.join(_own_mentions(m, evidence, recent).select(*KEY, "both"), KEY, "left").join(_pairs(m, edges), ["s", "o"], "left")
    return counted.withColumn("hit", _base() & _more("n", "both")).select(*edges.columns, "hit")


def co_mentioned(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Keys of active base edges whose two ends share a chunk of the window that is not their evidence: more chunks mention both than evidence chunks of the edge do."""
    return _with_co_mentioned(edges, mentions, chunks, evidence, as_of, days).filter("hit").select(*KEY).distinct()


def reinforce(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    at = F.expr(f"timestamp_ntz'{as_of}'")
    seen = _with_co_mentioned(edges, mentions, chunks, evidence, as_of, days)
    return seen.withColumn("pos", F.col("pos") + F.when(F.col("hit"), 1).otherwise(0)).withColumn("last_reinforced", F.when(F.col("hit"), at).otherwise(F.col("last_reinforced"))).drop("hit")


def _with_re_mentioned(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int) -> DataFrame:
    """edges with `hit`; they are read once. The counts of up to NAMES names go to all executors, those of more are shuffled."""
    recent = _window(chunks, as_of, days)
    m = _mentioned(mentions, recent)
    count = cut(_named(m, "entity", "n"))
    sent = F.broadcast if count.count() <= NAMES else lambda df: df
    of = lambda c, n: sent(count.select(F.col("entity").alias(c), F.col("n").alias(n)))
    stale = F.col("last_reinforced").isNull() | (F.col("last_reinforced") < F.expr(f"timestamp_ntz'{as_of}' - make_dt_interval({days})"))
    counted = edges.join(_own_mentions(m, evidence, recent), KEY, "left").join(of("s", "ns"), "s", "left").join(of("o", "no"), "o", "left")
    return counted.withColumn("hit", _base() & stale & (_more("ns", "own_s") | _more("no", "own_o"))).select(*edges.columns, "hit")


def re_mentioned(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Keys of active base edges, not reinforced in the window, of which an end is mentioned there outside their evidence.

    Counted instead of listed: an end with more chunks that mention it than evidence chunks of the
    edge that do. Evidence chunks need not mention both ends, or either.
    """
    return _with_re_mentioned(edges, mentions, chunks, evidence, as_of, days).filter("hit").select(*KEY).distinct()


def decay(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, evidence: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    seen = _with_re_mentioned(edges, mentions, chunks, evidence, as_of, days)
    return seen.withColumn("neg", F.col("neg") + F.when(F.col("hit"), 1).otherwise(0)).drop("hit")


def is_spent(threshold: float = DEFAULTS["retract_threshold"], zombie: int = DEFAULTS["zombie_neg"]) -> Column:
    return (confidence(F.col("pos"), F.col("neg")) < threshold) | (F.col("neg") >= 2 * F.col("pos") + zombie)


def auto_retract(edges: DataFrame) -> DataFrame:
    return edges.withColumn("status", F.when(_base() & is_spent(), "retracted").otherwise(F.col("status")))


def retraction_feedback(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Best evidence of each edge that is to be retracted: positive first, then latest."""
    w = Window.partitionBy(*KEY).orderBy(F.col("polarity").desc(), F.col("ts").desc(), F.col("chunk_id"))
    return evidence.join(edges.filter(_base() & is_spent()).select(*KEY), KEY, "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").select(*KEY, "chunk_id", "polarity")


def manual_retract(edges: DataFrame, s: str, p: str, o: str, as_of: str) -> DataFrame:
    """Retract one active edge; retracting again changes nothing."""
    hit = (F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o) & (F.col("status") == "active")
    return edges.withColumn("_hit", hit).withColumns({
        "neg": F.col("neg") + F.col("_hit").cast("long"), "last_seen": F.when(F.col("_hit"), F.expr(f"timestamp_ntz'{as_of}'")).otherwise(F.col("last_seen")),
        "status": F.when(F.col("_hit"), "retracted").otherwise(F.col("status")),
    }).drop("_hit")


def hops(base: DataFrame, threshold: float) -> DataFrame:
    """(s, o, conf): the most confident edge of each pair of base (s, o, pos, neg), where it reaches the threshold."""
    return base.groupBy("s", "o").agg(F.max(confidence(F.col("pos"), F.col("neg"))).alias("conf")).filter(F.col("conf") >= threshold)


def _grown(best: DataFrame, better: DataFrame, threshold: float, max_rounds: int) -> DataFrame:
    """The closure from best (s, o, conf), which holds `better`, its pairs that improved last.

    Semi-naive: each round joins only what improved in the last one with all there is, on either
    side, so paths' reach doubles and nothing is joined twice; it ends when no pair improves.
    """
    ahead = lambda df: df.select(F.col("s").alias("o"), F.col("o").alias("t"), F.col("conf").alias("c"))
    longer = lambda a, b: a.join(ahead(b), "o").select("s", F.col("t").alias("o"), (F.col("conf") * F.col("c")).alias("conf"))
    for _ in range(max_rounds):
        found = longer(better, best).unionByName(longer(best, better)).filter(F.col("conf") >= threshold).groupBy("s", "o").agg(F.max("conf").alias("new"))
        # products of one path in another order differ in their last bits: that is no improvement
        both = cut(best.join(found, ["s", "o"], "full_outer").select("s", "o", F.greatest("conf", "new").alias("conf"), (F.col("new").isNotNull() & (F.col("conf").isNull() | (F.col("new") > F.col("conf") * (1 + 1e-12)))).alias("up")))
        best, better = both.select("s", "o", "conf"), both.filter("up").select("s", "o", "conf")
        if better.isEmpty():
            return best
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def transitive(base: DataFrame, threshold: float = 0.15, max_rounds: int = 60) -> DataFrame:
    """Best path confidence of every pair, (s, o, conf), with conf >= threshold; base has s, o, pos, neg.

    A factor of a path is below 1, so pruning inside the loop loses nothing.
    """
    first = cut(hops(base, threshold))
    return first if first.isEmpty() else _grown(first, first, threshold, max_rounds)


def updated_closure(best: DataFrame, old: DataFrame, new: DataFrame, threshold: float = 0.15, max_rounds: int = 60) -> DataFrame:
    """The closure of the hops `new` from best, that of the hops `old`, deriving anew only what depends on the hops that differ.

    Pairs whose best path may lead over an edge that went or weakened are taken back; they get what
    their new first edges and the pairs that stand give them, and from these and the edges that came or
    grew the closure goes on as always.
    """
    moved = cut(old.withColumnRenamed("conf", "was").join(new.withColumnRenamed("conf", "now"), ["s", "o"], "full_outer").filter("NOT was <=> now"))
    weaker = moved.filter("was IS NOT NULL AND (now IS NULL OR now < was)").select(F.col("s").alias("x"), F.col("o").alias("y"), "was")
    up, down = best.select("s", F.col("o").alias("x"), F.col("conf").alias("a")), best.select(F.col("s").alias("y"), "o", F.col("conf").alias("b"))
    one = F.lit(1.0)
    into = weaker.select(F.col("x").alias("s"), "x", "y", "was", one.alias("a")).unionByName(weaker.join(up, "x").select("s", "x", "y", "was", "a"))
    over = into.select("s", F.col("y").alias("o"), (F.col("a") * F.col("was")).alias("via")).unionByName(into.join(down, "y").select("s", "o", (F.col("a") * F.col("was") * F.col("b")).alias("via")))
    lost = cut(best.join(over.groupBy("s", "o").agg(F.max("via").alias("via")), ["s", "o"]).filter(F.col("via") >= F.col("conf") * (1 - 1e-9)).select("s", "o"))
    stays = cut(best.join(lost, ["s", "o"], "left_anti"))
    again = new.join(lost, ["s", "o"], "left_semi").unionByName(new.withColumnRenamed("o", "z").join(lost, "s").join(stays.select(F.col("s").alias("z"), "o", F.col("conf").alias("c")), ["z", "o"]).select("s", "o", (F.col("conf") * F.col("c")).alias("conf")))
    came = moved.filter("now IS NOT NULL AND (was IS NULL OR now > was)").select("s", "o", F.col("now").alias("conf"))
    seeds = again.unionByName(came).filter(F.col("conf") >= threshold).groupBy("s", "o").agg(F.max("conf").alias("new"))
    both = cut(stays.join(seeds, ["s", "o"], "full_outer").select("s", "o", F.greatest("conf", "new").alias("conf"), (F.col("new").isNotNull() & (F.col("conf").isNull() | (F.col("new") > F.col("conf")))).alias("up")))
    start, better = both.select("s", "o", "conf"), both.filter("up").select("s", "o", "conf")
    return start if better.isEmpty() else _grown(start, better, threshold, max_rounds)


def dependencies(edges: DataFrame) -> DataFrame:
    """The active base edges that inference goes along."""
    return edges.filter(_base() & (F.col("p") == "depends_on")).select("s", "o", "pos", "neg")


def inferred_edges(edges: DataFrame, threshold: float = 0.15, best: DataFrame | None = None) -> DataFrame:
    """Edges with fresh derived depends_on edges: old ones go, pairs held by any base row are skipped. best: the closure, where it is known."""
    base = edges.filter(~F.col("derived"))
    best = transitive(dependencies(edges), threshold) if best is None else best
    held = base.filter(F.col("p") == "depends_on").select("s", "o")
    new = best.join(held, ["s", "o"], "left_anti").select("s", F.lit("depends_on").alias("p"), "o", F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit("active").alias("status"), F.lit(True).alias("derived"))
    return base.unionByName(new, allowMissingColumns=True)
