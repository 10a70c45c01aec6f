"""Operator 2, mixing sources to target weights by cube-method balanced sampling.

Each source's target is met by taking every document floor(f) times and once more with probability
f - floor(f), f being target / source size. The extra documents are drawn by the cube method: the
probabilities move through the null-space of the constraints (token total, document total) until all
but two per group are 0 or 1. Groups are hashed pieces of a source; what they leave open moves on in
fewer and fewer groups (the totals stay those of the source) until one small landing per source. A source lands
as soon as it has one group, however large the others are, and settled documents join its landing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking
from .common import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
GROUP = 2_000  # documents of a flight group, without their texts


def water_fill(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Targets by weight that sum to total, none above most * its size; the excess is reshared by weight."""
    caps = [most * s for s in sizes]
    targets = [0.0] * len(sizes)
    open_, left = [i for i, c in enumerate(caps) if c > 0], min(total, sum(caps))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= caps[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move p (all in (0, 1)) until at most two entries are neither 0 nor 1, keeping sum(p) and sum(p * size).

    Three open units at a time have a null direction of the 2 x 3 constraint matrix; moving along it
    to the nearest face settles at least one. The draw between the two faces is balanced by chance
    that follows from the data, so reruns agree.
    """
    p = p.tolist()
    x = size.tolist()
    rng = np.random.default_rng(np.array([len(x), int(sum(x)) & 0xFFFFFFFF], np.uint64))
    draws = rng.random(len(x) + 1).tolist()
    eps = 1e-9
    window: list[int] = []
    for i in range(len(p)):
        window.append(i)
        step = 0
        while len(window) == 3:
            a, b, c = window
            u, v, w = x[b] - x[c], x[c] - x[a], x[a] - x[b]
            if u == 0 and v == 0 and w == 0:
                u, v, w = 1.0, -1.0, 0.0
            up = down = float("inf")
            for q, d in ((p[a], u), (p[b], v), (p[c], w)):
                if d > 0:
                    up, down = min(up, (1 - q) / d), min(down, q / d)
                elif d < 0:
                    up, down = min(up, q / -d), min(down, (1 - q) / -d)
            t = up if draws[i] * (up + down) < down else -down
            for j, d in ((a, u), (b, v), (c, w)):
                q = p[j] + t * d
                p[j] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
            window = [j for j in window if 0.0 < p[j] < 1.0]
            step += 1
            if step > 3:
                break
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, goal: float, docs: float, extra: int = 10) -> np.ndarray:
    """Settle the last open units (two as a rule) so that the token total is nearest to its goal.

    The open units are tried together with a few settled ones of sizes spread over the group: all
    their combinations, by token error, then by error of the document count.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    shut = np.flatnonzero((p == 0) | (p == 1))
    shut = shut[np.argsort(size[shut], kind="stable")]
    pick = np.unique(np.linspace(0, len(shut) - 1, min(extra, len(shut))).astype(np.int64)) if len(shut) else shut
    at = np.concatenate((open_[:12], shut[pick])).astype(np.int64)
    out = p.copy()
    out[open_[12:]] = np.round(out[open_[12:]])
    rest = np.ones(len(p), bool)
    rest[at] = False
    bits = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    tokens = np.abs(bits @ size[at] + (out[rest] * size[rest]).sum() - goal)
    count = np.abs(bits.sum(1) + out[rest].sum() - docs)
    out[at] = bits[np.lexsort((count, np.round(tokens, 6)))[0]]
    return out


def _fly(group: int, extra: int = 10):
    """Fly a group; land it if it is all that its source has open (_groups is 1).

    The groups whose open units meet in the landing mark (_c) at least `extra` of the units they
    settled, of sizes spread over each group, to join it: two open units alone can miss the goal by
    half a document.
    """

    def run(tbl):
        p = tbl.column("_p").to_numpy()
        size = tbl.column("size").to_numpy().astype(np.float64)
        order = np.lexsort((size, np.array(tbl.column("_h").to_numpy())))
        q, s, carried = p[order].copy(), size[order], np.array(tbl.column("_c").to_numpy(zero_copy_only=False), bool)[order]
        groups = tbl.column("_groups")[0].as_py()
        open_ = np.flatnonzero((q > 0) & (q < 1))
        carry = np.zeros(len(q), bool)
        if len(open_):
            goal, docs = float((q[open_] * s[open_]).sum()), float(q[open_].sum())
            q[open_] = flight(q[open_], s[open_])
            if groups == 1:
                both = np.concatenate((open_, np.flatnonzero(carried)))
                goal, docs = goal + float((q[carried] * s[carried]).sum()), docs + float(q[carried].sum())
                q[both] = landing(q[both], s[both], goal, docs, extra)
            elif 2 * groups <= group:
                shut = open_[(q[open_] == 0) | (q[open_] == 1)]
                shut = shut[np.argsort(s[shut], kind="stable")]
                if len(shut):
                    carry[shut[np.unique(np.linspace(0, len(shut) - 1, min(-(-extra // groups), len(shut))).astype(np.int64))]] = True
        back, marks = np.empty_like(q), np.empty_like(carry)
        back[order], marks[order] = q, carry
        tbl = tbl.set_column(tbl.schema.get_field_index("_c"), "_c", pa.array(marks))
        return tbl.set_column(tbl.schema.get_field_index("_p"), "_p", pa.array(back))

    return run


def _level(sources: DataFrame, weights, share: float, most: float) -> float | None:
    """The level of the water fill: every source's target is the smaller of weight * level and most * its size (None: every source at its most).

    Sources may be many, so they stay distributed; per round one aggregate over them gives exact
    integer sums by weight. As in water_fill, a round fills the sources that the level lifts over
    their most and shares what is left among the others, until none is new.
    """
    cap = most * F.col("source_size")
    level, full = 0.0, None
    while True:
        rows = sources.filter("source_size > 0").groupBy("w").agg(
            F.sum("source_size").alias("all"), F.count(F.lit(1)).alias("n"),
            *[f.alias(k) for k, f in (("size", F.coalesce(F.sum(F.when(cap <= F.col("_weight") * level, F.col("source_size"))), F.lit(0))), ("filled", F.count(F.when(cap <= F.col("_weight") * level, 1))))],
        ).collect()
        total = sum(int(r["all"]) for r in rows)
        left = min(share * total, most * total) - most * sum(int(r["size"]) for r in rows)
        open_ = sum(weights[r["w"]] * (r["n"] - r["filled"]) for r in rows)
        now = sum(r["filled"] for r in rows)
        if open_ <= 0:
            return None
        if now == full:
            return level
        level, full = left / open_, now


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_REPEAT) -> DataFrame:
    """_s (the source), source_size, _docs and target of every source of sized (source, size).

    Sources take the weights in turn by code point, null last. They stay a table: only sums of them
    reach the driver.
    """
    found = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")))
    order = [F.col("source").isNull(), F.col("source")]  # Spark compares strings by their UTF-8 bytes, which is code point order
    numbered = cut(ranking.numbered(found, "_i", *order, start=0).withColumn("w", F.pmod(F.col("_i"), F.lit(len(weights))).cast("int")).withColumn("_weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("w") + 1)))
    level = _level(numbered, weights, share, most)
    full = F.lit(float(most)) * F.col("source_size")
    target = full if level is None else F.least(full, F.col("_weight") * level)
    return cut(numbered.select(F.col("source").alias("_s"), "source_size", "_docs", target.alias("target")))


def _draw(sized: DataFrame, goals: DataFrame, most: float, group: int) -> DataFrame:
    """sized (source, size, _h and what else it holds) with source_size, target and _copies."""
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    rest = (
        sized.join(goals, sized["source"].eqNullSafe(goals["_s"]), "left")
        .withColumn("_f", F.when(F.col("size") > 0, F.least(ratio, F.lit(float(most)))).otherwise(F.lit(0.0)))
        .withColumn("_base", F.floor(F.col("_f") + 1e-12))
        .withColumn("_p", F.greatest(F.lit(0.0), F.col("_f") - F.col("_base")))
        .withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("_docs") / group)).cast("int"))
        .withColumn("_g", F.pmod(F.col("_h"), F.col("_groups")).cast("int"))
        .withColumn("_c", F.lit(False))
        .drop("_f", "_docs", "source")
    )
    n = -(-(goals.agg(F.max("_docs")).first()[0] or 0) // group)
    levels = 1
    while n > 1:  # each group leaves at most two
        levels, n = levels + 1, -(-2 * n // group)
    settled = []
    for _ in range(levels - 1):
        done = cut(rest.groupBy("_s", "_g").applyInArrow(_fly(group), rest.schema))
        is_open = ((F.col("_p") > 0) & (F.col("_p") < 1)) | F.col("_c")
        settled.append(done.filter(~is_open))
        rest = done.filter(is_open).withColumn("_groups", F.greatest(F.lit(1), F.ceil(2 * F.col("_groups") / group)).cast("int")).withColumn("_g", F.pmod(F.shiftrightunsigned("_h", 20), F.col("_groups")).cast("int"))
    out = rest.groupBy("_s", "_g").applyInArrow(_fly(group), rest.schema)
    for more in settled:
        out = out.unionByName(more)
    return out.withColumn("_copies", (F.col("_base") + F.col("_p")).cast("int")).drop("_s", "_base", "_p", "_groups", "_g", "_c")


_SIZE = r"[^\x20\x09-\x0D]+"


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, group: int = GROUP, keep_text: bool = True) -> DataFrame:
    """df with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    Rows keep all their columns (those with the added names are replaced). Null text has size 0, null
    source is a source of its own and comes last; documents of size 0 take nothing. Repeated rows are
    drawn like any others. Texts never pass through Python: the flights see a row number, the source,
    the size and a hash, and what they decide is joined back. A source's documents never meet in one
    task unless they are fewer than about 1.5 * `group`: flights run in hashed groups, then on what
    those leave open. keep_text=False leaves the text out of the join and of the result. An empty
    table gives no rows.
    """
    out = _mixed(df, text, source, key, weights, share, most, group, keep_text)
    return out.select("_row.*", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def _mixed(df: DataFrame, text: str, source: str, key: str, weights, share: float, most: float, group: int, keep_text: bool) -> DataFrame:
    """_row (a struct of df's columns but those that mix adds), size, source_size, target and _copies."""
    added = {"size", "source_size", "target", "taken", *([] if keep_text else [text.lower()])}
    body = F.coalesce(F.col(text), F.lit(""))
    numbered = cut(df.select(
        F.monotonically_increasing_id().alias("_id"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(_SIZE)).cast("long").alias("size"),
        F.xxhash64(F.col(key).cast("string"), body).alias("_h"), F.struct(*[c for c in df.columns if c.lower() not in added]).alias("_row"),
    ))
    narrow = numbered.select("_id", "source", "size", "_h")
    drawn = _draw(narrow, source_targets(narrow.select("source", "size"), weights, share, most), most, group).select("_id", "source_size", "target", "_copies")
    return numbered.select("_id", "size", "_row").join(drawn, "_id")


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, group: int = GROUP) -> DataFrame:
    """The mix itself: each row of df as often as it is taken (0, 1 or 2 times), in df's columns. Rows without words stay once, having no tokens to weigh."""
    wide = df.select(F.struct(*df.columns).alias("_all"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("key"))
    out = _mixed(wide.select("_all", "text", "source", "key"), "text", "source", "key", weights, share, most, group, False)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("_copies"))
    return out.withColumn("_times", times).filter("_times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row._all.*")


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")
