r"""Operator 11, the prefix trie of conversations, from the Cartesian tree over their sorted LCP array.

1. A conversation becomes a key: 20 bytes a turn, the MD5 of (role, text) and the text's size. Equal
   keys are one class with its count, least id and digest of ids.
2. Classes are sorted by key over range partitions, the blocks. Between neighbours stands a position
   with the longest common prefix (LCP) in turns. A position's two nearest smaller values bound the
   interval of classes that share its prefix: a node of the trie that branches. Positions of one value
   with nothing smaller between them are the same node.
3. Each block finds the nearest smaller values of its positions with a stack (`Forest`). What has one
   on both sides is closed, and its counts are folded into the node around it. What stays open are
   the block's minima from either end: at most one node for each turn of its first and last key.
4. Neighbouring blocks, GATHER at a time, are joined the same way over their open minima and the LCP
   between them, round by round, until one block is left; a position of -1 at either end closes it.
5. A closed node holds for all depths between its parent's and its own; these are expanded at last.

No block, round or group is larger than a range partition or GATHER pairs of spines; the digest of a
class's ids reads them in order, as SHA-256 must, in a stream of constant memory.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import cut, table

TURN = 20  # bytes of a turn in a key
GATHER = 64  # blocks joined in one task
EMPTY = hashlib.sha256(b"").hexdigest()
BLOCK = 32 << 20  # bytes of keys in a block, about


# ---- conversations as keys
def turn_key(role: Column, text: Column) -> Column:
    """20 bytes: MD5 of role and text, kept apart by the role's length, and the text's size."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)).cast("binary")), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def keyed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (array of turn keys) for each conversation, by turn (null first), then role, then turn key."""
    slim = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), turn_key(F.col(role), F.col(text)).alias("key")).alias("t"))
    return slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.key").alias("turns"))


def regrafted(keys: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then c's own after its first h, for h = crc32(c) % 9."""
    fam = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    families = keys.groupBy(fam.alias("fam")).agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"))
    h = F.pmod(F.crc32(F.col("c.conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    none = F.array().cast("array<binary>")
    base = F.coalesce(F.get(F.filter("all", lambda x: x["conv_id"] == F.col("fam")), F.lit(0))["turns"], none)
    return families.withColumn("c", F.explode("all")).select(
        F.col("c.conv_id").alias("conv_id"), F.concat(F.slice(base, F.lit(1), h), F.slice(F.col("c.turns"), h + 1, F.greatest(F.lit(0), F.size("c.turns") - h))).alias("turns")
    )


# ---- classes of equal conversations
def _pieces(batches, most: int = 1 << 18):
    """cls, n, least and data (ids in decimal, a comma before each) of runs of one class, from ids sorted by class and id."""
    cls, n, least, data, size, out = None, 0, None, [], 0, []
    for b in batches:
        for c, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n and (c != cls or size > most):
                out.append((cls, n, least, b"".join(data)))
                n, data, size = 0, [], 0
            if not n:
                cls, least = c, i
            data.append(b",%d" % i)
            size += len(data[-1])
            n += 1
        if len(out) > 1000:
            yield _piece_batch(out)
            out = []
    if n:
        out.append((cls, n, least, b"".join(data)))
    if out:
        yield _piece_batch(out)


def _piece_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["cls", "n", "least", "data"])


def _digests(batches):
    """cls, n, least and ends of each class, from its pieces in order."""
    cls, n, least, sha, out = None, 0, None, None, []
    for b in batches:
        for c, m, first, data in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if n and c != cls:
                out.append({"cls": cls, "n": n, "least": least, "ends": sha.hexdigest()})
                n = 0
            if not n:
                cls, least, sha, data = c, first, hashlib.sha256(), data[1:]
            sha.update(data)
            n += m
        if out:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if n:
        yield pa.RecordBatch.from_pylist([{"cls": cls, "n": n, "least": least, "ends": sha.hexdigest()}])


def classes(conversations: DataFrame) -> DataFrame:
    """key, n, least and ends of each distinct sequence of turns among conversations (conv_id, turns)."""
    rows = cut(conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", F.hex), "")).alias("key")).withColumn("cls", F.unhex(F.md5("key"))))
    # a class of any size is sorted by many tasks; the one that hashes it reads its ids in pieces
    pieces = rows.select("cls", "conv_id").repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(_pieces, "cls binary, n bigint, least bigint, data binary")
    ids = pieces.repartition("cls").sortWithinPartitions("cls", "least").mapInArrow(_digests, "cls binary, n bigint, least bigint, ends string")
    return rows.groupBy("cls").agg(F.first("key").alias("key")).join(ids, "cls").select("key", "n", "least", "ends")


# ---- the tree
@dataclass
class Sub:
    """A closed subtree: classes that share `depth` turns of `key`; a leaf is one class with all its turns."""

    key: bytes
    depth: int
    n: int = 0
    least: int = 0
    kids: int = 0
    leaves: int = 0
    below: int = 0  # saved tokens of the subtrees under its depth
    ends: str | None = None
    leaf: bool = False
    carried: bool = False  # it was open at the end of a task
    rows: list = field(default_factory=list)  # the output rows of its children, which wait for its least id


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common."""
    m = min(len(a), len(b)) // TURN
    differ = np.flatnonzero(np.frombuffer(a, "V20", m) != np.frombuffer(b, "V20", m))
    return int(differ[0]) if len(differ) else m


def node_key(x: Sub) -> bytes:
    return hashlib.md5(x.key[: x.depth * TURN]).digest()


class Forest:
    """Reads classes and positions from left to right and closes nodes that have a nearest smaller value on both sides.

    `left` holds the open minima from the left end, falling; `stack` those towards the right end,
    rising. `first` and `last` are the leaves at the ends, whose parents are unknown while the LCP
    beyond is; a block of one class has `last` alone. Closed nodes are rows of `out`.
    """

    def __init__(self, closed: bool = False):
        self.first: Sub | None = None
        self.last: Sub | None = None
        self.left: list[Sub] = []
        self.stack: list[Sub] = [Sub(b"", -1)] if closed else []
        self.begun = closed
        self.out: list[dict] = []

    def _absorb(self, sub: Sub, into: Sub) -> None:
        """Put a closed subtree under the open node that is its parent, and write a row for its depths."""
        into.least = min(into.least, sub.least) if into.n else sub.least
        into.n += sub.n
        if sub.leaf and sub.depth == into.depth:  # the class ends at the node itself
            into.ends = sub.ends
            return
        sizes = np.frombuffer(sub.key, ">u4")[4::5][max(0, into.depth) : sub.depth].astype(np.int64)
        if into.depth < 0:  # the root has no last text
            sizes = np.concatenate(([0], sizes))
        tail = (sub.n - 1) * np.cumsum(sizes[::-1])[::-1]
        for row in sub.rows:
            row["parent_id"] = sub.least
        row = {
            "lo": into.depth + 1, "hi": sub.depth, "conv_id": sub.least, "parent_id": None, "parent_key": None, "node_key": node_key(sub) if sub.carried else None,
            "n": sub.n, "kids": sub.kids, "leaves": sub.leaves, "below": sub.below, "tail": tail, "ends": sub.ends,
        }
        self.out.append(row)
        into.rows.append(row)
        into.kids += 1
        into.leaves += sub.leaves
        into.below += sub.below + int(tail[0])

    def leaf(self, leaf: Sub | None) -> None:
        self.last = leaf

    def position(self, at: Sub) -> None:
        """The next position, with what its node holds so far in its own block."""
        sub, self.last = self.last, None
        if not self.begun:
            self.first, sub, self.begun = sub, None, True
        while self.stack and self.stack[-1].depth > at.depth:
            top = self.stack.pop()
            if sub is not None:
                self._absorb(sub, top)
            if self.stack:
                sub = top  # a smaller value stands on both sides
            else:
                self.left.append(top)
                sub = None
        if self.stack and self.stack[-1].depth == at.depth:
            self._merge(self.stack[-1], at)
        else:
            self.stack.append(at)
        if sub is not None:
            self._absorb(sub, self.stack[-1])

    @staticmethod
    def _merge(a: Sub, b: Sub) -> None:
        """b is the same node, further right."""
        if b.n:
            a.least = min(a.least, b.least) if a.n else b.least
        a.n, a.kids, a.leaves, a.below = a.n + b.n, a.kids + b.kids, a.leaves + b.leaves, a.below + b.below
        a.ends, a.carried, a.rows = a.ends or b.ends, a.carried or b.carried, a.rows + b.rows

    def spine(self) -> dict:
        """What is open. The rows that wait for an open node get its key to find it by."""
        for x in (*self.left, *self.stack):
            key = node_key(x) if x.rows else None
            for row in x.rows:
                row["parent_key"] = key
        return {"first": self.first and _leaf_out(self.first), "last": self.last and _leaf_out(self.last), "left": [_open_out(x) for x in self.left], "stack": [_open_out(x) for x in self.stack]}


def _leaf_out(x: Sub) -> dict:
    return {"key": x.key, "n": x.n, "least": x.least, "ends": x.ends}


def _open_out(x: Sub) -> dict:
    return {"depth": x.depth, "n": x.n, "least": x.least, "kids": x.kids, "leaves": x.leaves, "below": x.below, "ends": x.ends}


def _leaf_in(x: dict) -> Sub:
    return Sub(x["key"], len(x["key"]) // TURN, x["n"], x["least"], leaves=1, ends=x["ends"], leaf=True)


def read_block(sorted_classes) -> Forest:
    """The forest of one block; sorted_classes gives key, n, least, ends."""
    forest, before = Forest(), None
    for key, n, least, ends in sorted_classes:
        if before is not None:
            forest.position(Sub(key, lcp(before, key)))
        forest.leaf(_leaf_in({"key": key, "n": n, "least": least, "ends": ends}))
        before = key
    return forest


def join_blocks(spines: list[dict], closed: bool) -> Forest:
    """The forest of blocks in a row, of which only the spines are left; closed: these are all blocks."""
    forest = Forest(closed)
    for i, s in enumerate(spines):
        head = s["first"] or s["last"]
        if i:
            forest.position(Sub(head["key"], lcp(forest.last.key, head["key"])))
        if s["first"]:
            forest.leaf(_leaf_in(s["first"]))
        # a left minimum holds the first class, one of the stack the last
        for side, end in (("left", s["first"]), ("stack", s["last"])):
            for x in s[side]:
                forest.position(Sub(end["key"], **x, carried=True))
        forest.leaf(_leaf_in(s["last"]))
    if closed:
        forest.position(Sub(b"", -1))
    return forest


_LEAF = pa.struct([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
_OPEN = pa.list_(pa.struct([("depth", pa.int32()), *[(c, pa.int64()) for c in ("n", "least", "kids", "leaves", "below")], ("ends", pa.string())]))
_NODE = {
    "lo": pa.int32(), "hi": pa.int32(), "conv_id": pa.int64(), "parent_id": pa.int64(), "parent_key": pa.binary(), "node_key": pa.binary(),
    "n": pa.int64(), "kids": pa.int64(), "leaves": pa.int64(), "below": pa.int64(), "tail": pa.list_(pa.int64()), "ends": pa.string(),
}
_SPINE = {"blk": pa.int32(), "first": _LEAF, "last": _LEAF, "left": _OPEN, "stack": _OPEN}
_ROWS = pa.schema([*_NODE.items(), *_SPINE.items()])


def _batches(forest: Forest, blk: int, closed: bool = False, size: int = 4096):
    """Closed nodes and, unless all is closed, one row with the spine."""
    rows = forest.out
    if not closed and forest.last is not None:
        rows = [*rows, {"blk": blk, **forest.spine()}]
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], _ROWS)


def _read(batches):
    blk = None

    def rows():
        nonlocal blk
        for b in batches:
            if blk is None and len(b):
                blk = b.column(0)[0].as_py()
            yield from zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)

    forest = read_block(rows())
    yield from _batches(forest, blk)


def _joiner(closed: bool):
    def join(key, tbl):
        spines = sorted(tbl.select(list(_SPINE)).to_pylist(), key=lambda x: x["blk"])
        return pa.Table.from_batches(_batches(join_blocks(spines, closed), key[0].as_py(), closed), _ROWS)

    return join


def trie(classes_: DataFrame, blocks: int | None = None, gather: int = GATHER) -> DataFrame:
    """One row per node from classes (key, n, least, ends): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = classes_.sparkSession
    schema = from_arrow_schema(_ROWS)
    if blocks is None:
        total = classes_.agg(F.sum(F.octet_length("key"))).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))
    placed = classes_.repartitionByRange(blocks, "key").sortWithinPartitions("key")
    found = cut(placed.select(F.spark_partition_id().alias("blk"), "key", "n", "least", "ends").mapInArrow(_read, schema))
    rounds, closed = [found], False
    last = found.agg(F.max("blk")).first()[0]
    while not closed:
        last = (last or 0) // gather
        closed = last == 0
        open_ = rounds[-1].filter("blk is not null").select(*_SPINE)
        rounds.append(cut(open_.groupBy(F.floor(F.col("blk") / gather).cast("int").alias("to")).applyInArrow(_joiner(closed), schema)))
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.filter("lo is not null").drop(*_SPINE)
    waiting = nodes.filter("parent_key is not null").drop("parent_id")
    parents = nodes.filter("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_id"))
    whole = nodes.filter("parent_key is null").unionByName(waiting.join(parents, "parent_key"))
    depth = (F.col("lo") + F.col("i")).cast("long")
    bottom = F.col("lo") + F.col("i") == F.col("hi")
    return whole.select("*", F.posexplode("tail").alias("i", "own")).select(
        "conv_id", depth.alias("depth"), F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("parent_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("kids")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + F.col("own")).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, regraft: bool = False, blocks: int | None = None, gather: int = GATHER) -> DataFrame:
    """The trie's nodes for the conversations of turns (conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role, then key; null roles and texts are empty, so a
    turn with either is a turn; repeated rows are turns of their own; rows with a null conv_id belong
    to no conversation and are left out; other columns are ignored; an empty table gives no rows.
    Texts of any length count whole. regraft: conversations are first rebuilt as the contract says.
    A conversation's key of 20 bytes a turn must fit one row.
    """
    keys = keyed(turns)
    return trie(cut(classes(regrafted(keys) if regraft else keys)), blocks, gather)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), regraft=True)


#: DuckDB equivalent, with CRC-32 from its table; paths are written out.
ORACLE_SQL = r"""
WITH tbl AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), heads AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tbl
), keys AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, k) AS pos FROM keys
), rebuilt AS (
  SELECT heads.c, pos, k, bytes FROM heads JOIN turns ON turns.c = heads.c - ((heads.c % 5) + 5) % 5 AND pos <= h
  UNION ALL SELECT heads.c, pos, k, bytes FROM heads JOIN turns ON turns.c = heads.c AND pos > h
), paths AS (
  SELECT c, row_number() OVER w AS d, string_agg(k, '') OVER w AS path, bytes FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM heads
), lens AS (
  SELECT c, max(d) AS len FROM paths GROUP BY c
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends
  FROM paths JOIN lens USING (c) GROUP BY path, d
), kids AS (
  SELECT left(path, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL
), up AS (
  SELECT unnest(range(nodes.d + 1)) AS lvl, path, saved, (kids IS NULL)::BIGINT AS leaf FROM nodes LEFT JOIN kids USING (path, d)
), subtrees AS (
  SELECT left(path, 32 * lvl) AS path, lvl AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM up GROUP BY ALL
)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN subtrees s USING (path, d) LEFT JOIN kids USING (path, d) LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = left(x.path, 32 * (x.d - 1))
"""
