r"""Operator 13, conversation structure repair by a scan of min-plus matrices.

The roles of a sound conversation, by their initials, read `(s?(ua)+)?`: an automaton of four states
(0 begun, 1 after s, 2 after u, 3 after a; 0 and 3 may end). Each turn is a 4x4 matrix whose entry
(i, j) is the cheapest way from state i to j over that turn: Keep (K), Rerole to user or assistant
(R), Delete (D), with Inserts (I) before it by the insert closure. Entries are pairs (cost, audit),
audit being the edits' initials; the smaller cost wins, then the ASCII-least audit; one after the
other they add and append. Of two audits of one cost over the same turns none is a prefix of the
other, as more inserts cost more, so the choice agrees with appending, the product is associative, and
matrices can be multiplied in any grouping: here in a balanced tree.

1. Rows are sorted by (conversation, turn, role, text's MD5) over range partitions; so a conversation of any
   length spans as many as it needs.
2. A conversation that lies within one partition is repaired there, in the same pass. A partition's
   first and last ones may go on beyond it: their rows are written as they are.
3. Of those, each partition's fragment becomes one summary (counts, ends, matrix); summaries of
   neighbouring partitions are joined GATHER at a time until a conversation has one.
4. The audit is cut at the fragments' bounds, each fragment makes its part of the repaired text, and
   the parts are hashed in order in a stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import cut, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
GATHER = 16  # fragments joined in one task
PIECE = 1 << 20  # bytes of repaired text in a row, about
BLANK, CUT, GONE = 1, 2, 4  # flags of a row
SPACE = " \t\n\x0b\x0c\r"

Matrix = tuple  # 16 entries, row by row: (cost, audit), or None where there is no way


# ---- the semiring
def _better(a, b):
    return b if a is None or b is not None and b < a else a


def product(p: Matrix, q: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        row = [(k, x) for k, x in zip((0, 4, 8, 12), p[i : i + 4], strict=True) if x]
        for j in range(4):
            best = None
            for k, x in row:
                y = q[k + j]
                if y and (best is None or x[0] + y[0] <= best[0]):
                    best = _better(best, (x[0] + y[0], x[1] + y[1]))
            out.append(best)
    return tuple(out)


IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def _closure() -> Matrix:
    """Any number of inserts: the least fixed point of I + A*C over one insert A."""
    one = tuple(min(((INSERT, "I") for (s, _), t in MOVES.items() if (s, t) == (i, j) and _ != "s"), default=None) for i in range(4) for j in range(4))
    c = IDENTITY
    while (more := tuple(_better(a, b) for a, b in zip(IDENTITY, product(one, c), strict=True))) != c:
        c = more
    return c


INSERTS = _closure()


@lru_cache(maxsize=256)
def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """The inserts before a turn and the turn itself; initial is s, u, a or empty for any other."""
    own = [None] * 16
    left = TRUNCATED if truncated else 0
    for i in range(4):
        own[5 * i] = (DELETE, "D")
        for c in "" if must_go else "sua":
            j = MOVES.get((i, c))
            if j is not None:
                if c == initial:
                    own[4 * i + j] = _better(own[4 * i + j], (left, "K"))
                if c != "s":
                    own[4 * i + j] = _better(own[4 * i + j], (left + REROLE, "R"))
    return product(INSERTS, tuple(own))


def scan(turns: tuple) -> Matrix:
    """The product of the matrices of turns (initial, must_go, truncated), in a balanced tree."""
    if len(turns) <= 8:
        return _short(turns)
    half = 8
    while 2 * half < len(turns):
        half *= 2
    return product(scan(turns[:half]), scan(turns[half:]))


@lru_cache(maxsize=1 << 14)
def _short(turns: tuple) -> Matrix:
    if len(turns) < 2:
        return turn_matrix(*turns[0]) if turns else IDENTITY
    half = len(turns) // 2
    return product(_short(turns[:half]), _short(turns[half:]))


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation, with the inserts after its last turn."""
    first = (*m[:4], *[None] * 12)
    return min(x for x in (product(first, INSERTS)[j] for j in ENDS) if x)


# ---- summaries of fragments
COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def summary(rows: list[tuple]) -> dict:
    """Of rows (turn, initial, flags, repeated) in order, those without the flag GONE: counts, ends and matrix."""
    out = dict.fromkeys(COUNTS, 0) | {"head": None, "tail": None, "low": None, "high": None}
    kinds = []
    for turn, initial, flags, repeated in rows:
        if flags & GONE:
            continue
        blank, repeated = bool(flags & BLANK), not flags & BLANK and repeated
        truncated = bool(flags & CUT) and not blank and not repeated
        out["n"] += 1
        out["blank"] += blank
        out["duplicate"] += repeated
        out["truncated"] += truncated
        if out["head"] is None:
            out["head"] = initial
        else:
            out["illegal"] += out["tail"] + initial not in LEGAL
        out["tail"] = initial
        if turn is not None:
            out["low"] = turn if out["low"] is None else out["low"]
            out["turns"] += turn != out["high"]
            out["high"] = turn
        kinds.append((initial if initial in ("s", "u", "a") else "", blank or repeated, truncated))
    return out | {"matrix": scan(tuple(kinds))}


def join_summaries(a: dict, b: dict) -> dict:
    """Of two neighbouring fragments; associative."""
    out = {c: a[c] + b[c] for c in COUNTS}
    if a["n"] and b["n"]:
        out["illegal"] += a["tail"] + b["head"] not in LEGAL
    if a["high"] is not None and a["high"] == b["low"]:
        out["turns"] -= 1
    first = lambda x, y: y if x is None else x
    return out | {"head": first(a["head"], b["head"]), "tail": first(b["tail"], a["tail"]), "low": first(a["low"], b["low"]), "high": first(b["high"], a["high"]), "matrix": product(a["matrix"], b["matrix"])}


def report(s: dict) -> dict:
    cost, audit = cheapest(s["matrix"])
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"gaps": gaps, **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


# ---- audits
def state_at(written: int, system: bool) -> int:
    """The state after so many turns of a repaired conversation, which begins with a system turn or not."""
    if written <= system:
        return written
    return 2 if (written - system) % 2 else 3


def repaired(audit: str, rows: list[tuple[str, str]], state: int = 0):
    """(edit, role, text) of each turn that a part of an audit keeps or adds, from the rows (role, text) that it is about."""
    at = 0
    for edit in audit:
        role, text = ("assistant" if state == 2 else "user"), ""
        if edit != "I":
            if edit == "K":
                role = rows[at][0]
            text = rows[at][1]
            at += 1
        if edit != "D":
            yield edit, role, text
            state = MOVES[state, role[0]]


def split_audit(audit: str, sizes: list[int]) -> list[tuple[str, int]]:
    """The parts of an audit for fragments of so many rows, each with the state it begins in; inserts go with the row after them."""
    letters = np.frombuffer(audit.encode(), np.uint8)
    of_rows = np.flatnonzero(letters != ord("I"))
    written = np.concatenate(([0], np.cumsum(letters != ord("D"))))
    system = bool(written[-1] % 2)
    out, start, done = [], 0, 0
    for i, n in enumerate(sizes):
        done += n
        end = len(audit) if i == len(sizes) - 1 else int(of_rows[done - 1]) + 1 if done else 0
        out.append((audit[start:end], state_at(int(written[start]), system)))
        start = end
    return out


# ---- rows
def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage of conv_id, turn, role and text, by crc32(`conv_id:turn`) % 20; nulls count as one space. Dropped rows stay, marked `gone`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_REPORT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_OPEN = {"blk": pa.int32(), "idx": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "flags": pa.int32()}
_FOUND = pa.schema([("conv", pa.string()), *_REPORT.items(), ("repaired", _TURNS), *_OPEN.items()])
_FRAGMENT = pa.schema([("conv", pa.string()), ("blk", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
_PIECE = pa.schema([("conv", pa.string()), ("blk", pa.int32()), ("seq", pa.int64()), ("data", pa.binary()), ("repaired", _TURNS)])
_TOTAL = pa.schema([("conv", pa.string()), *list(_REPORT.items())[:-1]])


def _whole(conv: str, rows: list[tuple], turns: bool) -> dict:
    """The report of a conversation from all its rows (turn, role, text, flags)."""
    seen, marked, kept = set(), [], []
    for turn, role, text, flags in rows:
        if not flags & GONE:
            marked.append((turn, role[:1], flags, (role, text) in seen))
            seen.add((role, text))
            kept.append((role, text))
    out = {"conv": conv, **report(summary(marked))}
    made = list(repaired(out["audit"], kept))
    out["repaired_sha256"] = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in made).encode("utf-8", "surrogatepass")).hexdigest()
    if turns:
        out["repaired"] = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in made]
    return out


def _pass(turns: bool):
    """Reports of the conversations that end and begin inside a partition; rows of its first and last one."""

    def run(batches):
        blk, conv, first, idx, held, out = None, None, True, 0, [], []

        def rows_of(rows):
            return [{"conv": conv, "blk": blk, "idx": i, "turn": t, "role": r, "text": x, "flags": f} for i, t, r, x, f in rows]

        for b in batches:
            for blk_, c, turn, role, text, flags in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if blk is None:
                    blk, conv = blk_, c
                if c != conv:
                    if not first:
                        out.append(_whole(conv, [x[1:] for x in held], turns))
                    conv, first, held = c, False, []
                row = (idx, turn, role, text, flags)
                idx += 1
                if first:
                    out += rows_of([row])
                else:
                    held.append(row)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, _FOUND)
                    out = []
        out += rows_of(held)
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist(out[i : i + 2000], _FOUND)

    return run


def _fragment_out(conv: str, blk: int, s: dict) -> pa.Table:
    m = s.pop("matrix")
    return pa.Table.from_pylist([{"conv": conv, "blk": blk, **s, "cost": [x and x[0] for x in m], "audit": [x and x[1] for x in m]}], _FRAGMENT)


def _fragment(key, tbl):
    rows = sorted(zip(*[tbl.column(c).to_pylist() for c in ("idx", "turn", "initial", "flags", "repeated")], strict=True))
    return _fragment_out(key[0].as_py(), key[1].as_py(), summary([x[1:] for x in rows]))


def _fragments_in(tbl) -> list[dict]:
    rows = sorted(tbl.to_pylist(), key=lambda x: x["blk"])
    return [x | {"matrix": tuple(None if c is None else (c, a) for c, a in zip(x["cost"], x["audit"], strict=True))} for x in rows]


def _join(key, tbl):
    out, *rest = _fragments_in(tbl)
    for x in rest:
        out = join_summaries(out, x)
    return _fragment_out(key[0].as_py(), key[1].as_py(), {c: out[c] for c in (*COUNTS, "head", "tail", "low", "high", "matrix")})


def _totals(batches):
    for b in batches:
        yield pa.RecordBatch.from_pylist([{"conv": x["conv"], **report(x)} for x in _fragments_in(pa.Table.from_batches([b]))], _TOTAL)


def _parts(batches):
    for b in batches:
        out = []
        for conv, audit, parts in zip(*[b.column(c).to_pylist() for c in ("conv", "audit", "parts")], strict=True):
            parts = sorted(parts, key=lambda x: x["blk"])
            cuts = split_audit(audit, [x["n"] for x in parts])
            out += [{"conv": conv, "blk": x["blk"], "part": part, "state": state} for x, (part, state) in zip(parts, cuts, strict=True)]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("blk", pa.int32()), ("part", pa.string()), ("state", pa.int32())]))


def _pieces(turns: bool):
    """The repaired text of a fragment, a newline before each turn."""

    def run(key, rows, parts):
        conv, blk = key[0].as_py(), key[1].as_py()
        kept = [x[1:3] for x in sorted(zip(*[rows.column(c).to_pylist() for c in ("idx", "role", "text", "flags")], strict=True)) if not x[3] & GONE]
        out, data, made, size = [], [], [], 0

        def flush():
            nonlocal data, made, size
            out.append({"conv": conv, "blk": blk, "seq": len(out), "data": b"".join(data), "repaired": made if turns else None})
            data, made, size = [], [], 0

        for edit, role, text in repaired(parts.column("part")[0].as_py(), kept, parts.column("state")[0].as_py()):
            data.append(f"\n{role}:{text}".encode("utf-8", "surrogatepass"))
            size += len(data[-1])
            made.append({"edit": edit, "role": role, "text": text})
            if size > PIECE:
                flush()
        flush()
        return pa.Table.from_pylist(out, _PIECE)

    return run


def _hashes(batches):
    """SHA-256 of each conversation from its pieces in order, the first newline left out."""
    conv, sha, begun = None, None, False
    done = lambda: pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": sha.hexdigest()}])
    for b in batches:
        for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if sha is None or c != conv:
                if sha is not None:
                    yield done()
                conv, sha, begun = c, hashlib.sha256(), False
            sha.update(data if begun else data[1:])
            begun = begun or bool(data)
    if sha is not None:
        yield done()


def _spanning(rows: DataFrame, blocks: int, gather: int, turns: bool) -> tuple[DataFrame, DataFrame]:
    """Reports of conversations that may span partitions, from their rows; and the pieces of their repaired texts."""
    live = rows.filter(F.col("flags").bitwiseAND(F.lit(GONE)) == 0)
    told = F.md5(F.concat_ws(":", F.char_length("role").cast("string"), F.concat("role", "text")).cast("binary"))
    firsts = live.groupBy("conv", told.alias("told")).agg(F.min(F.struct("blk", "idx")).alias("p")).select("p.blk", "p.idx", F.lit(True).alias("new"))
    slim = rows.select("conv", "blk", "idx", "turn", F.left("role", F.lit(1)).alias("initial"), "flags").join(firsts, ["blk", "idx"], "left").withColumn("repeated", F.col("new").isNull())
    kind = from_arrow_schema(_FRAGMENT)
    fragments = level = cut(slim.groupBy("conv", "blk").applyInArrow(_fragment, kind))
    while blocks > 1:
        blocks = -(-blocks // gather)
        level = level.groupBy("conv", F.floor(F.col("blk") / gather).cast("int").alias("to")).applyInArrow(_join, kind)
    totals = cut(level.mapInArrow(_totals, from_arrow_schema(_TOTAL)))
    sizes = fragments.groupBy("conv").agg(F.collect_list(F.struct("blk", "n")).alias("parts"))
    parts = totals.join(sizes, "conv").select("conv", "audit", "parts").mapInArrow(_parts, "conv string, blk int, part string, state int")
    pieces = cut(rows.groupBy("conv", "blk").cogroup(parts.groupBy("conv", "blk")).applyInArrow(_pieces(turns), from_arrow_schema(_PIECE)))
    hashes = pieces.select("conv", "data", "blk", "seq").repartition("conv").sortWithinPartitions("conv", "blk", "seq").mapInArrow(_hashes, "conv string, repaired_sha256 string")
    return totals.join(hashes, "conv"), pieces


def _sorted(turns: DataFrame, blocks: int) -> DataFrame:
    """blk, conv, turn, role, text and flags, a partition a block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    flags = F.when(F.col("gone"), GONE).when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0).cast("int")
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    rows = turns.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.when(F.col("gone"), "").otherwise(text).alias("text"), flags.alias("flags"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "md5"]
    placed = rows.withColumn("md5", F.md5(F.col("text").cast("binary"))).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    return placed.select(F.spark_partition_id().alias("blk"), "conv", "turn", "role", "text", "flags")


def _run(turns: DataFrame, gone: str | None, blocks: int | None, gather: int, wanted: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = turns.select("conv_id", "turn", "role", "text", (F.lit(False) if gone is None else F.col(gone)).alias("gone"))
    blocks = blocks or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(_sorted(turns, blocks).mapInArrow(_pass(wanted), from_arrow_schema(_FOUND)))
    within = found.filter("blk is null")
    spanning, pieces = _spanning(found.filter("blk is not null").select("conv", *_OPEN), blocks, gather, wanted)
    return within, spanning, pieces


def repair_report(turns: DataFrame, gone: str | None = None, blocks: int | None = None, gather: int = GATHER) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of turns (conv_id, turn, role, text).

    Rows are ordered by turn (null first), then role, then the text's MD5. Null roles and texts are
    empty; a null conv_id is a conversation like any other; repeated rows are duplicates; a role of
    another initial than s, u and a can't be kept. Rows marked true in the column `gone` (as damage() does)
    don't count, but a conversation of only such rows has its row, with zeros. An empty table gives no
    rows; other columns are ignored. A conversation's audit, a character or so for each turn, must
    fit a row; its texts need not.
    """
    within, spanning, _ = _run(turns, gone, blocks, gather, False)
    cols = [F.expr("try_cast(conv as bigint)").alias("conv_id"), *_REPORT]
    return within.select(*cols).unionByName(spanning.select(*cols))


def repaired_turns(turns: DataFrame, gone: str | None = None, blocks: int | None = None, gather: int = GATHER) -> DataFrame:
    """The turns of the repaired conversations in order: conv_id, place (blk, seq, n), edit (K, R or I), role and text."""
    within, _, pieces = _run(turns, gone, blocks, gather, True)
    both = within.select("conv", F.lit(0).alias("blk"), F.lit(0).cast("long").alias("seq"), "repaired").unionByName(pieces.select("conv", "blk", "seq", "repaired"))
    return both.select(F.expr("try_cast(conv as bigint)").alias("conv_id"), "blk", "seq", F.posexplode("repaired").alias("n", "x")).select("conv_id", F.struct("blk", "seq", "n").alias("place"), "x.edit", "x.role", "x.text")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "gone")


#: DuckDB equivalent: the same damage, then the cheapest audit of each state turn by turn; `key` holds cost and audit in one string that sorts as they do.
ORACLE_SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, tbl
), hit AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw
), placed AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM hit
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(c) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM placed
), rows_ AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT again AS truncated FROM told
), moves(f, ch, t) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(f, t, m) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), own AS (
  SELECT conv_id, n, f, t, CASE WHEN truncated THEN 3 ELSE 0 END AS cost, 'K' AS edit FROM rows_ JOIN moves ON ch = c WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, n, f, t, CASE WHEN truncated THEN 6 ELSE 3 END, 'R' FROM rows_, moves WHERE ch <> 's' AND NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, n, i, i, 4, 'D' FROM rows_, range(4) s(i)
), ways AS (
  SELECT conv_id, n, inserts.f, own.t, cost + 3 * m AS cost, repeat('I', m) || edit AS edits FROM own JOIN inserts ON inserts.t = own.f
), states AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS st, '0000000000' AS key FROM rows_ GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, w.n, w.t, min(lpad((left(s.key, 10)::BIGINT + cost)::VARCHAR, 10, '0') || substr(s.key, 11) || edits)
  FROM states s JOIN ways w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.n = s.n + 1 AND w.f = s.st GROUP BY w.conv_id, w.n, w.t
), counts AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
), best AS (
  SELECT s.conv_id, min(lpad((left(key, 10)::BIGINT + 3 * m)::VARCHAR, 10, '0') || substr(key, 11) || repeat('I', m)) AS key
  FROM states s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.n JOIN inserts i ON i.f = s.st AND i.t IN (0, 3) GROUP BY s.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(substr(key, 11), '')) AS e, generate_subscripts(string_split(substr(key, 11), ''), 1) AS i FROM best
), spots AS (
  SELECT *, sum((e <> 'I')::INT) OVER w AS n, sum((e <> 'D')::INT) OVER w AS pos, sum((e <> 'D')::INT) OVER (PARTITION BY conv_id) % 2 AS odd FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), texts AS (
  SELECT s.conv_id, string_agg(CASE e WHEN 'K' THEN r.role ELSE CASE WHEN (pos - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY i) AS text
  FROM spots s LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n WHERE e <> 'D' GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
  coalesce(left(b.key, 10)::BIGINT, 0) AS cost, coalesce(substr(b.key, 11), '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""
