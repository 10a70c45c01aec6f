"""Operator 7, n-gram Jaccard join with signature trees.

1. Each text becomes its set of distinct 4-word shingles (64-bit hashes); equal sets are one class.
2. Routing: a set is split by hash into parts, and each part's content is a signature. Two sets that
   link differ in at most D elements, so among D+1 non-empty parts one is equal in both: linked sets
   share a signature, unless hashing leaves one fewer filled parts than that (a chance under 1e-8 for
   the smallest sets, less for others). Very small sets use pairs of their least hashes instead.
   most=MOST is a cheaper way for large sets: they stop at MOST parts of about 6 elements,
   of which two linked sets share none with a chance of about 1e-8 at a similarity of exactly 0.85
   and under 1e-14 from 0.9 on (the hash, not the data, decides).
3. Classes connected through shared signatures form a candidate group; others can't be linked.
4. Within a group a signature tree joins the sets: nodes hold OR-combined token bitmaps and size
   ranges, and a dual traversal prunes node pairs by their largest possible overlap. What is left is
   verified exactly. Pairs that are connected already are skipped. A group of over BLOCK bytes is cut
   by size class, of which only equal and neighbouring ones can link, and those into blocks.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

WIDTH = 4  # words in a shingle
NUM, DEN = 85, 100  # link when DEN * intersection >= NUM * union
SMALL = 24  # below this size: pairs of prefix shingles
RATIO = 1.25  # of the size classes of part signatures; over 1 / 0.85, so that linked sets are in one class or in neighbours
MOST = 64  # part signatures of a set in one class, where asked for
BITS = 2048  # of a set's bitmap in the trees
LEAF, FANOUT = 16, 8
BLOCK = 32 << 20  # bytes of a candidate group's sets in one task, at most twice; a set counts 6 bytes a shingle and EACH
EACH = 2048
BUCKETS, SALTS = 4096, 64  # counters that find hot signatures, and the pieces that those are dealt to

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hashes of words; a few MB of the usual ones, as a missing one costs little."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 40:
            if len(self) > 200_000:
                self.clear()
            self[w] = h
        return h


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = len(ws)
    if not n:
        return np.empty(0, _U)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], _U)
    w = np.fromiter(map(words.__getitem__, ws), _U, n)
    m = n - WIDTH + 1
    h = _mix(w[:m])
    for k in range(1, WIDTH):
        h = _mix(h + w[k : k + m] * _U(2 * k + 1))
    return np.unique(h)


def _bounds() -> list[int]:
    out = [SMALL]
    while out[-1] < 1 << 40:
        out.append(ceil(out[-1] * RATIO))
    return out


_CLASSES = _bounds()


def _parts(h: np.ndarray, c: int, need: int, most: int | None) -> np.ndarray:
    """Signatures of the first `need` non-empty parts of the set in size class c (at most `most`)."""
    least = _CLASSES[c]
    # need is up to 0.2206 * least + 1 for the largest sets of the class; a few parts may be empty
    p = ceil(0.23 * least) + 6 if most is None or least * (DEN - NUM) < most * NUM else ceil(least * (1 + RATIO) / 12)
    at = (h % _U(p)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sums = np.add.reduceat(_mix(h[order] ^ _U(0x9E3779B97F4A7C15)), first)
    return _mix(sums + _mix(at[first].astype(_U) + (_U(c + 1) << _U(44))))[: need if most is None else min(need, most)]


def signatures(h: np.ndarray, most: int | None = None) -> np.ndarray:
    """Routing signatures of a set: two sets that link and differ share at least one.

    With t = 85/100, sets of sizes a and b that link differ in at most (1-t)/(1+t)*(a+b) elements,
    and b <= a/t. Sets under 6 elements link only with equal sets.
    """
    s = len(h)
    out = []
    if 6 <= s and s * NUM < SMALL * DEN:
        m = s - ceil(s * NUM / DEN) + 2
        x = h[:m]
        i, j = np.triu_indices(m, 1)
        out.append(_mix(_mix(x[i]) + x[j] * _U(3)))
    if s >= SMALL:
        c = int(np.searchsorted(_CLASSES, s, side="right")) - 1
        out.append(_parts(h, c, int((DEN - NUM) * s * (1 + DEN / NUM) / (DEN + NUM)) + 1, most))
        if c and s * NUM <= (_CLASSES[c] - 1) * DEN:
            out.append(_parts(h, c - 1, (DEN - NUM) * (s + _CLASSES[c] - 1) // (DEN + NUM) + 1, most))
    return np.unique(np.concatenate(out)) if out else np.empty(0, _U)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, most: int | None = None) -> DataFrame:
    """id, n_shingles, cid (digest of the set; null if empty), th (hash of the text) and sigs for docs (id, text).

    Of the rows of one set that a task meets, the first alone carries the signatures.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        words, met = _Words(), set()
        for b in batches:
            n, cid, sizes, sigs = [], [], [0], []
            for t in b.column(1):
                h = shingles(t.as_py(), words)
                n.append(len(h))
                d = _digest(h) if len(h) else None
                cid.append(d)
                g = np.empty(0, _U) if d in met else signatures(h, most)
                met.add(d)
                sigs.append(g.view(np.int64))
                sizes.append(sizes[-1] + len(g))
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), b.column(2), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["id", "n_shingles", "cid", "th", "sigs"])

    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"id {kind}, n_shingles bigint, cid binary, th bigint, sigs array<bigint>")


def _bloom(ids: DataFrame, least: int = 1 << 20, most: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes in column h, of at most `most` bits however many there are; a full one lets everything pass."""
    n = ids.count()
    bits = min(most, max(least, 1 << (16 * max(1, n)).bit_length()))
    at = F.pmod("h", F.lit(bits))
    rows = ids.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {bits}) & 63 as int)))").alias("v")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return words.view(_U), bits


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and set (packed hashes), one row a class, of the rows of docs (text) whose texts' hashes are among wanted (th), and of a few more."""
    words_, bits = _bloom(wanted.select(F.col("th").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(words_)

    def run(batches):
        words, met, bloom = _Words(), set(), shared.value
        for b in batches:
            th = b.column(0).to_numpy()
            at = np.mod(th, bits)
            hit = ((bloom[at >> 6] >> (at & 63).astype(_U)) & _U(1)).astype(bool)
            keep = []
            for i in np.flatnonzero(hit).tolist():
                if th[i] not in met:  # a copy of a text that this task has read
                    met.add(th[i])
                    keep.append(i)
            found = [shingles(t.as_py(), words) for t in b.column(1).take(pa.array(keep, pa.int64()))]
            found = [h for h in found if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(h) for h in found], pa.binary()), pa.array([_pack(h) for h in found], pa.binary())], ["cid", "set"])

    rows = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(run, "cid binary, set binary")
    return rows.groupBy("cid").agg(F.first("set").alias("set"))


class _Node:
    __slots__ = ("bits", "lo", "hi", "slack", "kids", "rows")

    def __init__(self, bits, lo, hi, slack, kids, rows):
        self.bits, self.lo, self.hi, self.slack, self.kids, self.rows = bits, lo, hi, slack, kids, rows


class SignatureTree:
    """A tree over sets: bitmaps are combined by OR, sizes by range, and `slack` is the most elements that share a bit in one set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.bits = np.zeros((n, BITS // 64), _U)
        for i, s in enumerate(sets):
            b = s >> _U(64 - BITS.bit_length() + 1)
            np.bitwise_or.at(self.bits[i], (b >> _U(6)).astype(np.int64), _U(1) << (b & _U(63)))
        self.slack = self.size - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        key = [(int(np.log(max(1, len(s))) / 0.16), int(s[0]) if len(s) else 0) for s in sets]
        order = sorted(range(n), key=key.__getitem__)
        level = [self._leaf(np.array(order[i : i + LEAF])) for i in range(0, n, LEAF)]
        while len(level) > 1:
            level = [self._join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    def _leaf(self, rows: np.ndarray) -> _Node:
        return _Node(np.bitwise_or.reduce(self.bits[rows]), int(self.size[rows].min()), int(self.size[rows].max()), int(self.slack[rows].max()), None, rows)

    @staticmethod
    def _join(kids: list[_Node]) -> _Node:
        return _Node(np.bitwise_or.reduce([k.bits for k in kids]), min(k.lo for k in kids), max(k.hi for k in kids), max(k.slack for k in kids), kids, np.concatenate([k.rows for k in kids]))

    @staticmethod
    def _apart(x: _Node, y: _Node) -> bool:
        """No set of x can link with one of y: sizes too far apart, or too few common bits for the least overlap."""
        if x.hi * DEN < y.lo * NUM or y.hi * DEN < x.lo * NUM:
            return True
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        return most * (DEN + NUM) < NUM * (x.lo + y.lo)

    def links(self, other_side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links. other_side: marks of two blocks, of which only pairs across are asked for."""
        parent = np.arange(len(self.sets))
        root = parent.copy()  # flat: root[i] is always the component's mark
        members = {i: [i] for i in range(len(self.sets))}
        out = []
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            x, y = stack.pop()
            if x is not y and self._apart(x, y):
                continue
            if x.kids or y.kids:
                first = root[x.rows[0]]
                if (root[x.rows] == first).all() and (root[y.rows] == first).all():
                    continue
                if x is y:
                    k = x.kids
                    stack += [(k[i], k[j]) for i in range(len(k)) for j in range(i + 1, len(k))]
                    stack += [(c, c) for c in k]
                elif x.kids and (not y.kids or len(x.rows) >= len(y.rows)):
                    stack += [(c, y) for c in x.kids]
                else:
                    stack += [(x, c) for c in y.kids]
                continue
            a, b = x.rows, y.rows
            ok = root[a][:, None] != root[b][None, :]
            if not ok.any():
                continue
            if other_side is not None:
                ok &= other_side[a][:, None] != other_side[b][None, :]
            na, nb = self.size[a][:, None], self.size[b][None, :]
            most = np.bitwise_count(self.bits[a][:, None, :] & self.bits[b][None, :, :]).sum(2).astype(np.int64) + np.minimum(self.slack[a][:, None], self.slack[b][None, :])
            ok &= (np.minimum(most, np.minimum(na, nb)) * (DEN + NUM) >= NUM * (na + nb))
            if x is y:
                ok = np.triu(ok, 1)
            for i, j in zip(*np.nonzero(ok), strict=True):
                p, q = int(a[i]), int(b[j])
                if root[p] == root[q]:
                    continue
                s, t = self.sets[p], self.sets[q]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if DEN * both >= NUM * (len(s) + len(t) - both):
                    out.append((p, q))
                    keep, gone = root[p], root[q]
                    if len(members[keep]) < len(members[gone]):
                        keep, gone = gone, keep
                    moved = members.pop(gone)
                    root[moved] = keep
                    members[keep] += moved
        return out


def _join_block(keys, tbl):
    """Links within a block (bi = bj), or across two blocks."""
    bi, bj = keys[1].as_py(), keys[2].as_py()
    cids = tbl.column("cid").to_pylist()
    order = sorted(range(len(cids)), key=cids.__getitem__)
    sets = tbl.column("set").to_pylist()
    side = tbl.column("block").to_numpy()[order]
    tree = SignatureTree([_unpack(sets[i]) for i in order])
    found = tree.links(side if bi != bj else None)
    return pa.table({"a": pa.array([cids[order[p]] for p, _ in found], pa.binary()), "b": pa.array([cids[order[q]] for _, q in found], pa.binary())})


def _pack(h: np.ndarray) -> bytes:
    """A set's hashes by their upper 48 bits: two elements of a pair of sets clash with a chance of |A||B| / 2^48."""
    return h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(_U).ravel()


def _short(cid: str):
    """The first 60 bits of a class digest, enough to route by: a clash only makes a candidate more."""
    return F.conv(F.substring(F.hex(cid), 1, 15), 16, 10).cast("long")


def _hot(sigs: DataFrame) -> list[int]:
    """The buckets of signatures, of BUCKETS, that hold over four times the mean: under a quarter of BUCKETS, with every signature of that many rows among them."""
    counts = [(r["k"], r["n"]) for r in sigs.groupBy(F.pmod("sig", F.lit(BUCKETS)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()]
    mean = sum(n for _, n in counts) / BUCKETS
    return sorted(k for k, n in counts if n > max(1000, 4 * mean))


def _candidates(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of short class ids that connect, within each signature, classes of like size.

    Sorted by size, two classes of a signature that may link have only such classes between them, so
    edges between neighbours whose sizes allow a link keep them connected. Signatures in hot buckets
    are chained in two steps, whatever the sizes: pieces dealt by class first, then the heads of the
    pieces, so that no signature has to be sorted by one task.
    """
    sigs = rows.filter(F.size("sigs") > 0).select(_short("cid").alias("c"), F.col("n_shingles").cast("int").alias("n"), F.explode("sigs").alias("sig"))
    hot = _hot(sigs)
    is_hot = F.pmod("sig", F.lit(BUCKETS)).isin(*hot) if hot else F.lit(False)
    w = Window.partitionBy("sig").orderBy("n", "c")
    near = sigs.filter(~is_hot).withColumn("b", F.lag("c").over(w)).withColumn("m", F.lag("n").over(w))
    out = near.filter((F.col("b") != F.col("c")) & (F.col("m") * DEN >= F.col("n") * NUM)).select(F.col("c").alias("a"), "b")
    if hot:
        w = Window.partitionBy("sig", "salt").orderBy("c")
        dealt = cut(sigs.filter(is_hot).withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).withColumn("b", F.lag("c").over(w)))
        heads = dealt.filter("b is null").withColumn("b", F.lag("c").over(Window.partitionBy("sig").orderBy("c")))
        out = out.unionByName(dealt.unionByName(heads).filter("b != c").select(F.col("c").alias("a"), "b"))
    return out


def _placed(classes: DataFrame, block: int) -> DataFrame:
    """classes (cid, grp, n) with the block of each (`block`) and every pair of blocks (bi, bj) that it is to be joined in.

    A group of up to `block` bytes is one block. In a larger one, size classes in a row make a unit of
    about `block` bytes; a class of more is a unit by itself, cut into pieces. A block is a unit's
    piece (unit * 2^32 + piece): pieces meet those of their own unit, and where a unit begins or ends,
    its outermost class also meets the neighbouring class of the next unit. Large groups and their
    classes number at most all bytes / block, and 60 classes or so each; they are written first, so
    that the planner knows their size and never deals a whole group to one task to join with them.
    """
    weight = F.col("n") * 6 + EACH
    large = cut(classes.groupBy("grp").agg(F.sum(weight).alias("bytes")).filter(F.col("bytes") > block).select("grp"))
    if large.isEmpty():
        return classes.select("cid", "grp", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("bi"), F.lit(0).cast("long").alias("bj"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.2)))).cast("long")  # 1.2 > 1 / 0.85
    marked = classes.join(large.withColumn("_l", F.lit(True)), "grp", "left").withColumn("k", F.when(F.col("_l"), step)).drop("_l")
    w = Window.partitionBy("grp").orderBy("k")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    big = F.col("bytes") > block
    units = (
        marked.filter("k is not null").groupBy("grp", "k").agg(F.sum(weight).alias("bytes"))
        .withColumn("run", 2 * F.sum(big.cast("int")).over(so_far) - big.cast("int"))
        .withColumn("strip", F.when(big, 0).otherwise(F.floor((F.sum(F.when(big, 0).otherwise(F.col("bytes"))).over(so_far) - F.col("bytes")) / block)))
        .withColumn("unit", F.min("k").over(Window.partitionBy("grp", "run", "strip")))
        .withColumn("m", F.when(big, F.ceil(F.col("bytes") / block)).otherwise(1).cast("long"))
    )
    side = lambda f, d: F.when((f("k").over(w) == F.col("k") + d) & (f("unit").over(w) != F.col("unit")), F.struct(f("unit").over(w).alias("unit"), f("m").over(w).alias("m")))
    around = cut(units.select("grp", "k", F.struct("unit", "m").alias("own"), side(F.lag, -1).alias("below"), side(F.lead, 1).alias("above")))
    code = lambda unit, i: F.shiftleft(unit, 32) + i
    codes = lambda u: F.when(F.col(u).isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col(f"{u}.m") - 1), lambda i: code(F.col(f"{u}.unit"), i))).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    return (
        marked.join(around, ["grp", "k"], "left")
        .withColumn("block", F.when(F.col("own").isNull(), zero).otherwise(code(F.col("own.unit"), F.pmod(F.xxhash64("cid"), F.col("own.m")))))
        .withColumn("other", F.explode(F.when(F.col("own").isNull(), F.array(zero)).otherwise(F.concat(codes("below"), codes("own"), codes("above")))))
        .select("cid", "grp", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    Null, empty and blank texts have no shingles and link with nothing; equal sets always link; the
    result does not depend on row order. Rows of one id with different texts may give the id two
    rows with different components. A row with a null id is grouped with equal sets only, and with a
    null component_id where no equal row has an id. Groups of more than `block` bytes are joined
    block against block, each pair of blocks that can link in a task of its own. An empty table
    gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = cut(sketch(src, most))
    reps = rows.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("th").alias("th"), F.max("n_shingles").alias("n"))
    groups = cut(components(_candidates(rows)).select(F.col("node").alias("c"), F.col("root").alias("grp")))
    wanted = cut(reps.withColumn("c", _short("cid")).join(groups, "c").select("th", "cid", "grp", "n"))
    pairs = _sets(src, wanted).join(_placed(wanted.select("cid", "grp", "n"), block), "cid")
    links = pairs.groupBy("grp", "bi", "bj").applyInArrow(_join_block, "a binary, b binary")
    found = components(links)
    labelled = rows.select("id", "n_shingles", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return (
        labelled.join(least, "root", "left")
        .select(F.col("id").alias(key), "n_shingles", F.coalesce("least", "id").alias("component_id"))
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least key (null last), then of the least text digest.

    Components are of rows: repeated ids and null ids are no ties, and of rows that agree in both id
    and text one stays, the same whatever the row order. Rows whose texts have no shingles all stay.
    """
    full = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.filter(full)
    row = F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), F.md5(F.col(text)).alias("md5"))
    marked = ngram_components(some.select(row.alias("_row"), F.col(text).alias("text")), "_row", "text")
    first = marked.filter(F.col("_row").eqNullSafe(F.col("component_id"))).select(F.xxhash64("_row.id").alias("_h"), F.col("_row.md5").alias("_d"), F.col("_row.id").alias("_id")).distinct()
    keyed = some.withColumns({"_h": F.xxhash64(key), "_d": F.md5(F.col(text))})
    same = (keyed["_h"] == first["_h"]) & (keyed["_d"] == first["_d"]) & keyed[key].eqNullSafe(first["_id"])
    copies = Window.partitionBy("_h", "_d", key).orderBy(F.xxhash64(*docs.columns))
    one = keyed.join(first, same, "left_semi").withColumn("_n", F.row_number().over(copies)).filter("_n = 1")
    return one.select(*docs.columns).unionByName(docs.filter(~full))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
