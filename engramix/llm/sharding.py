"""Operator 10, sharding by histogram sort (DataFrame functions only).

Rows are ordered by the 128-bit key (hash of the text, hash of the id), so equal texts are neighbours.
Splitters between shards are found without sorting: each round counts exact bytes and rows below
candidate boundaries (bin edges of 12 key bits) and only bins that hold a wanted boundary are refined
further. When every splitter meets the tolerance, the rows are exchanged once, each range to a
partition of its own.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BITS = 12
BINS = 1 << BITS
LEVELS = 10  # 5 rounds of 12 bits per 60-bit half of the key


def with_key(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds _size (UTF-8 bytes plus 8; null text counts none), _crc and the key halves _k1, _k2 (60 bits each)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({
        "_size": F.octet_length(body).cast("long") + 8,
        "_crc": F.crc32(body),
        "_k1": F.shiftrightunsigned(F.xxhash64(body), 4),
        "_k2": F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("row")), 4),
    })


def _digit(level: int):
    """The 12-bit digit of the key at a level (0: most significant)."""
    half, i = ("_k1", level) if level < 5 else ("_k2", level - 5)
    return F.shiftrightunsigned(F.col(half), 60 - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1).cast("int")


def _prefix_of(level: int):
    """The digits above a level as one string-free pair of longs."""
    done = min(level, 5)
    a = F.shiftrightunsigned(F.col("_k1"), 60 - BITS * done) if done else F.lit(0).cast("long")
    rest = max(0, level - 5)
    b = F.shiftrightunsigned(F.col("_k2"), 60 - BITS * rest) if rest else F.lit(0).cast("long")
    return a, b


def find_splitters(keyed: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], list[int], int, int]:
    """Splitters (lower key bounds of parts 1..parts-1), rows below each, and total rows and bytes.

    Only bin counts reach the driver: at most 4096 in the first round and 4096 per open splitter
    after it. Rounds end when the best edge is within tolerance * ideal bytes of each
    target, or when a bin holds a single key, which no boundary can cut.
    """
    total = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("b")).first()
    n, size = total["n"], total["b"]
    ideal = size / parts
    slack = ideal * tolerance
    found: dict[int, tuple[tuple[int, int], int, int]] = {}  # part -> (key bound, rows below, bytes below)
    # open bins: prefix -> (rows below, bytes below, splitters wanted in it)
    open_bins: dict[tuple[int, int], tuple[int, int, list[int]]] = {(0, 0): (0, 0, list(range(1, parts)))}
    for level in range(LEVELS):
        if not open_bins or n == 0:
            break
        a, b = _prefix_of(level)
        wanted = keyed
        if level:  # at most one open bin per splitter
            here = F.lit(False)
            for pa, pb in open_bins:
                here = here | ((a == pa) & (b == pb))
            wanted = keyed.filter(here)
        counts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in wanted.groupBy(a.alias("a"), b.alias("b"), _digit(level).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).collect():
            counts.setdefault((r["a"], r["b"]), []).append((r["d"], r["n"], r["s"]))
        upcoming: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
        for prefix, (rows0, bytes0, splitters) in open_bins.items():
            bins = sorted(counts.get(prefix, []))
            edges, rows, acc = [], rows0, bytes0
            for d, c, s in bins:
                edges.append((acc, rows, d, c, s))
                rows, acc = rows + c, acc + s
            starts = [e[0] for e in edges]
            for k in splitters:
                goal = ideal * k
                i = max(0, bisect_right(starts, goal) - 1)
                low, rows_low, d, c, s = edges[i]
                choices = [(abs(goal - low), _bound(level, prefix, d), rows_low, low), (abs(goal - low - s), _bound(level, prefix, d + 1), rows_low + c, low + s)]
                best = min(choices)
                if best[0] <= slack or c == 1 or level == LEVELS - 1:
                    found[k] = best[1:]
                else:
                    key = _child(level, prefix, d)
                    upcoming.setdefault(key, (rows_low, low, []))[2].append(k)
        open_bins = upcoming
    order = [found.get(k, ((1 << 60, 0), n, size)) for k in range(1, parts)]
    for i in range(1, len(order)):  # ties of targets inside one key keep their order
        if order[i][0] < order[i - 1][0]:
            order[i] = order[i - 1]
    return [x[0] for x in order], [x[1] for x in order], n, size


def _bound(level: int, prefix: tuple[int, int], digit: int) -> tuple[int, int]:
    """The least key whose digits up to this level are prefix and digit; a carry moves upward by itself."""
    if level < 5:
        return (((prefix[0] << BITS) + digit) << (60 - BITS * (level + 1)), 0)
    k2 = ((prefix[1] << BITS) + digit) << (60 - BITS * (level - 4))
    return (prefix[0] + (k2 >> 60), k2 & ((1 << 60) - 1))


def _child(level: int, prefix: tuple[int, int], digit: int) -> tuple[int, int]:
    return ((prefix[0] << BITS) + digit, 0) if level < 5 else (prefix[0], (prefix[1] << BITS) + digit)


def _at(bounds: list[tuple[int, int]], a: str, b: str, low: int = 0):
    """How many of the sorted bounds are at or below the key (a, b), by binary search."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    x, y = bounds[mid]
    here = (F.col(a) > x) | ((F.col(a) == x) & (F.col(b) >= y))
    return F.when(here, _at(bounds[mid + 1 :], a, b, low + mid + 1)).otherwise(_at(bounds[:mid], a, b, low))


def _ranges(narrow: DataFrame, bounds: list[tuple[int, int]], rows: list[int], most: int):
    """Cuts shards into key ranges of about most rows: a function of the key columns, and the rows of each range below it in its shard.

    A shard's span of the first key half is cut into equal pieces by its number of rows, which hashing
    makes even; a value of that half (one text) with over `most` rows is cut by the second half.
    Ranges follow the key order. Values of over `most` rows number at most rows / most, pieces as
    many and one more a shard, and the caller lets `most` grow with the input so that this stays
    below BINS * shards: that bounds what is collected and broadcast.
    """
    spark = narrow.sparkSession
    edges = [0, *(x for x, _ in bounds), 1 << 60]
    shard = _at(bounds, "_k1", "_k2")
    spans = [(x, max(1, y - x + 1), -(-n // most) or 1) for x, y, n in zip(edges, edges[1:], rows, strict=False)]
    low, width, per = (F.element_at(F.array(*[F.lit(x[i]).cast("long") for x in spans]), shard + 1) for i in range(3))
    piece = F.least(per - 1, F.greatest(F.lit(0), F.floor((F.col("_k1") - low) / width * per))).cast("int")
    base = lambda d: d.withColumns({"_shard": shard, "_piece": piece})
    hot = base(narrow).groupBy("_shard", "_piece", "_k1").agg(F.count(F.lit(1)).alias("n"), F.min("_k2").alias("lo"), F.max("_k2").alias("hi")).filter(F.col("n") > most)
    hot = hot.select("_shard", "_piece", F.struct(F.col("_k1").alias("k"), F.ceil(F.col("n") / most).cast("int").alias("m"), "lo", (F.col("hi") - F.col("lo") + 1).alias("span")).alias("h"))
    found = hot.groupBy("_shard", "_piece").agg(F.array_sort(F.collect_list("h")).alias("_hot")).collect()
    table_ = F.broadcast(spark.createDataFrame([(r["_shard"], r["_piece"], r["_hot"]) for r in found], "_shard int, _piece int, _hot array<struct<k:bigint,m:int,lo:bigint,span:bigint>>")) if found else None

    def ranged(d: DataFrame) -> DataFrame:
        d = base(d)
        if table_ is None:
            return d.withColumn("_sub", F.lit(0))
        sub = F.aggregate(
            F.coalesce("_hot", F.array().cast("array<struct<k:bigint,m:int,lo:bigint,span:bigint>>")), F.lit(0),
            lambda s, h: s + F.when(F.col("_k1") > h["k"], h["m"] + 1).when(F.col("_k1") == h["k"], 1 + F.least(h["m"] - 1, F.floor((F.col("_k2") - h["lo"]) / h["span"] * h["m"]).cast("int"))).otherwise(0),
        )
        return d.join(table_, ["_shard", "_piece"], "left").withColumn("_sub", sub).drop("_hot")

    counts = sorted((r["_shard"], r["_piece"], r["_sub"], r["count"]) for r in ranged(narrow).groupBy("_shard", "_piece", "_sub").count().collect())
    parts, below, last = [], 0, -1
    for i, (s, p, u, n) in enumerate(counts):
        below = 0 if s != last else below
        parts.append((s, p, u, i, below))
        below, last = below + n, s
    return ranged, F.broadcast(spark.createDataFrame(parts, "_shard int, _piece int, _sub int, _part int, _below bigint")), len(parts)


def shard(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", tolerance: float = 0.002, rows_per_range: int = 500_000) -> DataFrame:
    """All rows of df with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    Law: the shards' byte sizes are as near equal as single rows allow. A group of equal texts is a
    run of neighbours in key order and is cut only where a shard boundary falls inside it. Slots
    follow the key order within a shard.
    A shard of over rows_per_range rows is cut further into ranges of about that many, each one
    partition of the one exchange, so that the sort below it stays spread over the cluster however
    few shards there are; shards and slots do not depend on it.
    Null text: size 8, crc of the empty string. Null id: an ordinary key value. Repeated rows get
    slots of their own. Empty input: no rows. df may hold columns of the added names; they are
    replaced. Columns of the input otherwise stay.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    taken = {c.lower() for c in added}
    names = [c for c in df.columns if c.lower() not in taken]
    keyed = with_key(df.select(F.struct(*names).alias("_row"), F.col(text).alias("_text"), F.col(key).alias("_id")), "_text", "_id").drop("_text", "_id")
    narrow = cut(keyed.select("_size", "_k1", "_k2"))
    bounds, below, n, _ = find_splitters(narrow, shards, tolerance)
    most = max(rows_per_range, -(-4 * n // (BINS * shards)))
    rows = [y - x for x, y in zip([0, *below], [*below, n], strict=True)]
    if max(rows) > most:
        ranged, parts, count = _ranges(narrow, bounds, rows, most)
        placed = ranged(keyed).join(parts, ["_shard", "_piece", "_sub"], "left")
    else:
        placed, count = keyed.withColumns({"_shard": _at(bounds, "_k1", "_k2"), "_below": F.lit(0).cast("long")}).withColumn("_part", F.col("_shard")), shards
    w = Window.partitionBy("_part").orderBy("_k1", "_k2", "_crc", "_size")
    return (
        placed.repartitionById(count, "_part")
        .withColumn("_rank", F.row_number().over(w))
        .select(
            "_row.*",
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("_shard").alias("shard"),
            (F.col("_below") + F.col("_rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
