"""The prefix trie against a plain one, over any blocks, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

from engramix.llm import prefix_trie as pt


def plain(convs):
    """conv_id -> list of (role, text); rows of the trie."""
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    memo = {}

    def under(p):
        if p not in memo:
            below = [under(k) for k in kids[p]]
            own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
            memo[p] = (1 if not below else sum(x[0] for x in below), own + sum(x[1] for x in below))
        return memo[p]

    out = set()
    for p, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        leaves, saved = under(p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def some_convs(r, n, deep):
    texts = ["", "a", "bb", "é" * 3]
    return {r.randint(0, 10 * n): [(r.choice(["user", "assistant"]), r.choice(texts)) for _ in range(r.randint(0, deep))] for _ in range(n)}


def rows_of(forests):
    nodes = [x for f in forests for x in f.out]
    named = {x["node_key"]: x["conv_id"] for x in nodes if x["node_key"]}
    out = []
    for x in nodes:
        parent = named[x["parent_key"]] if x["parent_key"] else x["parent_id"]
        for i, own in enumerate(x["tail"]):
            bottom = x["lo"] + i == x["hi"]
            out.append((x["conv_id"], x["lo"] + i, x["conv_id"] if i else parent, x["n"], x["kids"] if bottom else 1, x["leaves"], x["below"] + int(own), (x["ends"] if bottom else None) or pt.EMPTY))
    return out


def test_any_blocks_give_the_plain_trie():
    r = random.Random(11)
    for k in range(300):
        convs = some_convs(r, r.randint(1, 60), r.choice([1, 3, 8, 30]))
        groups = defaultdict(list)
        for c, turns in convs.items():
            groups[b"".join(hashlib.md5(f"{len(a)}:{a}{b}".encode()).digest() + len(b.encode()).to_bytes(4, "big") for a, b in turns)].append(c)
        rows = [(key, len(ids), min(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()) for key, ids in sorted(groups.items())]
        size, gather = r.choice([1, 2, 3, 7, 100]), r.choice([2, 3, 5])
        forests = [pt.read_block(rows[i : i + size]) for i in range(0, len(rows), size)]
        done, spines = list(forests), [f.spine() for f in forests]
        while True:
            closed = len(spines) <= gather
            joined = [pt.join_blocks(spines[i : i + gather], closed) for i in range(0, len(spines), gather)]
            done += joined
            if closed:
                break
            spines = [f.spine() for f in joined]
        got = rows_of(done)
        assert len(got) == len(set(got)) and set(got) == plain(convs), k


def test_spines_are_no_longer_than_their_keys():
    turns = [("u", str(i)) for i in range(200)]
    key = lambda t: b"".join(hashlib.md5(b.encode()).digest() + b"\0\0\0\1" for _, b in t)
    rows = sorted((key(turns[:i]), 1, i, "x") for i in range(200))
    f = pt.read_block(rows)
    assert len(f.left) + len(f.stack) <= 400 and len(f.out) == 0


def table_of(spark, convs, extra=()):
    rows = [(c, i, a, b, "x", 1) for c, turns in convs.items() for i, (a, b) in enumerate(turns)]
    return spark.createDataFrame([*rows, *extra], "conv_id long, turn long, role string, text string, KEY string, blk int")


def test_spark_equals_plain_over_many_blocks(spark):
    r = random.Random(12)
    convs = {c: t for c, t in some_convs(r, 150, 12).items() if t}
    convs |= {c: [("user", "hot"), ("assistant", "same")] for c in range(5000, 5100)}  # copies
    df = table_of(spark, convs)
    for blocks, gather in ((1, 64), (9, 2)):
        assert {tuple(x) for x in pt.prefix_trie(df, blocks=blocks, gather=gather).collect()} == plain(convs)
    got = [tuple(x) for x in pt.prefix_trie(df, regraft=True, blocks=7, gather=3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rebuilt(convs))


def test_nulls_ties_repeats_and_empty_tables(spark):
    extra = [(7, None, None, None, "x", 1), (7, None, "user", "b", "x", 1), (7, None, "user", "b", "x", 1), (7, 0, "user", None, "x", 1), (None, 0, "user", "lost", "x", 1), (8, 0, "u:", "x", "x", 1), (9, 0, "u", ":x", "x", 1), (10, 3, "", "", "x", 1)]
    df = table_of(spark, {}, extra)
    convs = {7: [("", ""), ("user", "b"), ("user", "b"), ("user", "")], 8: [("u:", "x")], 9: [("u", ":x")], 10: [("", "")]}
    assert {tuple(x) for x in pt.prefix_trie(df, blocks=3).collect()} == plain(convs)
    assert pt.prefix_trie(df.limit(0)).collect() == []
    lone = table_of(spark, {2: [("user", "a" * 300_000)]})  # conversation 0 is absent, h of 2 is 5: nothing is left
    got = [tuple(x) for x in pt.prefix_trie(lone, regraft=True).collect()]
    assert set(got) == plain(rebuilt({2: [("user", "a" * 300_000)]})) and len(got) == 1
