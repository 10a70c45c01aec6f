"""Conversation repair against a plain search over edits, over any blocks, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from engramix.llm import turn_repair as tr

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest_plain(kinds):
    """Cost and audit of turns (initial, must_go, truncated), from the last turn back to the first, all edits tried in each state."""
    to, after = {"s": 1, "u": 2, "a": 3}, None
    for i in range(len(kinds), -1, -1):
        here = {0: [], 1: [], 2: [], 3: []}
        for state, options in here.items():
            nexts = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
            if i == len(kinds):
                if state in (0, 3):
                    options.append((0, ""))
                continue
            initial, must_go, cut = kinds[i]
            edits = [("D", 4, state)]
            if not must_go:
                edits += [("K", 3 * cut, to[x]) for x in nexts if x == initial] + [("R", 3 + 3 * cut, to[x]) for x in nexts if x != "s"]
            options += [(more + cost, e + audit) for e, more, t in edits for cost, audit in after[t]]
        for _ in range(4):  # inserts before the turn
            for state, options in here.items():
                options += [(cost + 3, "I" + audit) for cost, audit in here[{0: 2, 1: 2, 2: 3, 3: 2}[state]][:1]]
                options[:] = [min(options)] if options else []
        after = here
    return after[0][0]


def test_scan_equals_a_plain_search_in_any_grouping():
    r = random.Random(13)
    for _ in range(400):
        kinds = tuple((r.choice(["s", "u", "a", ""]), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 14)))
        want = cheapest_plain(kinds)
        assert tr.cheapest(tr.scan(kinds)) == want, kinds
        at = sorted(r.sample(range(len(kinds) + 1), min(2, len(kinds) + 1)))
        m = tr.IDENTITY
        for part in (kinds[: at[0]], kinds[at[0] : at[-1]], kinds[at[-1] :]):
            m = tr.product(m, tr.scan(part))
        assert tr.cheapest(m) == want
        made = list(tr.repaired(want[1], [({"s": "system", "u": "user", "a": "assistant"}.get(k[0], "tool"), "t") for k in kinds]))
        assert GOOD.fullmatch("".join(x[1][0] for x in made))


def test_closure_takes_the_least_inserts():
    assert tr.INSERTS[0 * 4 + 3] == (6, "II") and tr.INSERTS[2 * 4 + 3] == (3, "I") and tr.INSERTS[0 * 4 + 1] is None and tr.INSERTS[2 * 4 + 2] == (0, "")


def plain(rows, damaged=True):
    """conv_id -> report, from rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        if damaged:
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            convs[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        else:
            convs[c].append((t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, role, text in turns:
            body = text.strip(tr.SPACE)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            kinds.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest_plain(tuple(kinds))
        ts = [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        made, at = [], 0
        for e in audit:
            want = "user" if not made or made[-1][0][0] in "sa" else "assistant"
            if e == "I":
                made.append((want, ""))
                continue
            _, role, text = turns[at]
            at += 1
            if e != "D":
                made.append((role if e == "K" else want, text))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *faults, illegal, cost, audit, sha)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def reports(df):
    rows = [tuple(x) for x in df.collect()]
    out = {x[0]: x[1:] for x in rows}
    assert len(out) == len(rows)
    return out


def some_rows(r, convs, deep):
    out = []
    for c in range(convs):
        for t in range(r.randint(1, deep)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool"]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c, t if r.random() < 0.95 else None, role if r.random() < 0.98 else None, r.choice(["Yes.", "No", "ok!\n ", f"text {r.randint(0, 99)}.", "", None, " \t", "x. y"])))
    return out


@pytest.mark.parametrize("blocks,gather", [(1, 16), (7, 2), (60, 3)])
def test_spark_equals_plain_over_any_blocks(spark, blocks, gather):
    r = random.Random(14)
    rows = some_rows(r, 40, 9) + [(500, t, r.choice(["user", "assistant", "tool"]), r.choice([f"m {t}.", "again.", "open"])) for t in range(300)]  # a long one
    df = spark.createDataFrame(rows, SCHEMA)
    assert reports(tr.repair_report(tr.damage(df), "gone", blocks, gather)) == plain(rows)


def test_repaired_turns_are_the_audits(spark):
    rows = some_rows(random.Random(15), 12, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, damaged=False)
    got = defaultdict(list)
    for x in tr.repaired_turns(df, None, 5, 2).collect():
        got[x["conv_id"]].append((x["place"], x["edit"], x["role"], x["text"]))
    for c, w in want.items():
        made = sorted(got[c])
        assert "".join(x[1] for x in made) == w[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in made).encode()).hexdigest() == w[7]


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, 1, "user", "x." * 100_000), (1, 2, "assistant", "y"), (1, 2, "assistant", "y"), (1, 2, "assistant", "y"), (2, None, "u", "q?"), (3, 5, "", ""), (4, 1, "system", "only."), (0, 5, "user", "b.")]
    wide = spark.createDataFrame([(*x, "z", 1, "k") for x in rows], SCHEMA + ", GONE string, blk int, flags string")
    assert reports(tr.repair_report(tr.damage(wide), "gone", 3)) == plain(rows)
    assert reports(tr.repair_report(wide, None, 4)) == plain(rows, damaged=False)
    empty = wide.limit(0)
    assert tr.repair_report(tr.damage(empty), "gone").collect() == [] and tr.repaired_turns(empty).collect() == []
    gone = [(c, 0, "user", "a.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = reports(tr.repair_report(tr.damage(spark.createDataFrame(gone, SCHEMA)), "gone", 3))
    assert gone and got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}
