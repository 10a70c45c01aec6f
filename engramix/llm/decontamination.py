"""Operator 8, benchmark decontamination with a generalised suffix automaton over words.

The automaton is built from the normalised words of all benchmark items. Document words stream
through it; at each word it gives the length of the longest suffix that is a substring of some item.
A window (10 item words, or a whole shorter item) ends where that length reaches its size.

A benchmark of over max_words words is spread over several automata. Each row then carries its hit
spans and items from pass to pass, so no row is matched up by an id, and what is decided on them
(counts, coverage, removal) is decided once, on the spans of all automata.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Words of one automaton: at most twice as many states of 24 bytes, plus the vocabulary and the states with
#: several transitions; under about 300 MB on the driver and in a worker even if every word is new.
MAX_WORDS = 1_000_000

#: Bytes kept as word bytes after lower-casing A-Z; every other byte becomes a space.
_MAP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

Spans = list[tuple[int, int]]


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences, with the items of every window.

    Most states have one transition, kept in two arrays (sym, to); the others stand in `more`. The
    items of a window are kept once per distinct list of items (lists), found by state (cls).
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = self.least = window
        self.vocab: dict[bytes, int] = {}
        self.sym, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.ids = list(dict.fromkeys(k for k, _ in items))
        number = {k: i for i, k in enumerate(self.ids)}
        coded = []
        for k, seq in items:
            ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in seq])
            coded.append((number[k], ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
            if len(ids) < window:
                self.least = min(self.least, len(ids))
        self._place(coded)

    def _get(self, s: int, c: int) -> int:
        if self.sym[s] == c:
            return self.to[s]
        m = self.more.get(s)
        return m.get(c, -1) if m else -1

    def _put(self, s: int, c: int, t: int) -> None:
        if self.sym[s] in (-1, c):
            self.sym[s], self.to[s] = c, t
        else:
            self.more.setdefault(s, {})[c] = t

    def _state(self, length: int, link: int) -> int:
        self.len.append(length)
        self.link.append(link)
        self.sym.append(-1)
        self.to.append(-1)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self._get(last, c)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, 0)
        p = last
        while p >= 0 and self._get(p, c) < 0:
            self._put(p, c, cur)
            p = self.link[p]
        if p >= 0:
            q = self._get(p, c)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, self.link[q])
        self.sym[new], self.to[new] = self.sym[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._get(p, c) == q:
            self._put(p, c, new)
            p = self.link[p]
        return new

    def _place(self, coded: list[tuple[int, array]]) -> None:
        """Set cls (state -> list of the items that hold its suffix of window words, -1: shorter), lists, whole and near.

        whole maps the state of a short item to (its length, item); near is a state's closest one of
        those on its way to the root, itself included, or 0.
        """
        n, window = len(self.len), self.window
        order = np.argsort(np.frombuffer(self.len, np.int32), kind="stable").tolist()
        top = array("i", bytes(4 * n))  # the state that holds the suffix of exactly window words
        for s in order:
            if self.len[s] >= window:
                up = self.link[s]
                top[s] = top[up] if self.len[up] >= window else s
        states, owners = array("i"), array("i")
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for at, ids in coded:
            s = 0
            for i, c in enumerate(ids, 1):
                s = self._get(s, c)
                if i >= window:
                    states.append(top[s])
                    owners.append(at)
            if 0 < len(ids) < window and (len(ids), at) not in self.whole.setdefault(s, []):
                self.whole[s].append((len(ids), at))
        pairs = np.unique(np.stack([np.frombuffer(states, np.int32), np.frombuffer(owners, np.int32)], 1), axis=0) if len(states) else np.empty((0, 2), np.int32)
        edges = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1, append=-1)).tolist()  # where another state's items begin, and the end
        lists: dict[tuple[int, ...], int] = {}
        own = array("i", [-1]) * n
        for lo, hi in zip(edges, edges[1:], strict=False):
            own[int(pairs[lo, 0])] = lists.setdefault(tuple(pairs[lo:hi, 1].tolist()), len(lists))
        self.lists = list(lists)
        self.cls = array("i", [own[t] if t else -1 for t in top])
        self.near = array("i", bytes(4 * n))
        if self.whole:
            for s in order[1:]:
                self.near[s] = s if s in self.whole else self.near[self.link[s]]

    def hits(self, doc: list[bytes]) -> tuple[Spans, set[int]]:
        """Merged hit spans (start, end exclusive, in words) and the items with occurring windows."""
        n = len(doc)
        if n < self.least or not self.vocab:
            return [], set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in doc), np.int64, n)
        edges = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))  # runs of known words lie between unknown ones
        spans: Spans = []
        found: set[int] = set()
        sym, to, more, link, length, least, window, cls = self.sym, self.to, self.more, self.link, self.len, self.least, self.window, self.cls
        seen = -1
        for r in np.flatnonzero(np.diff(edges) - 1 >= least).tolist():
            lo, hi = int(edges[r]) + 1, int(edges[r + 1])
            s = size = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                while True:
                    if sym[s] == c:
                        s = to[s]
                        size += 1
                        break
                    m = more.get(s)
                    if m is not None and c in m:
                        s = m[c]
                        size += 1
                        break
                    if not s:
                        size = 0
                        break
                    s = link[s]
                    size = length[s]
                if size < least:
                    continue
                longest = 0
                if size >= window:
                    longest = window
                    # the state's own suffix of window words; the match may be shorter than the state's strings
                    if cls[s] != seen:
                        seen = cls[s]
                        found.update(self.lists[seen])
                if self.whole:
                    longest = max(longest, self._short(s, size, found))
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found

    def _short(self, s: int, size: int, found: set[int]) -> int:
        """The longest whole short item that ends with the current match (0: none); all of them go to found."""
        longest = 0
        t = self.near[s]
        while t:
            for n, at in self.whole[t]:
                if n <= size:
                    found.add(at)
                    longest = max(longest, n)
            t = self.near[self.link[t]]
        return longest


def union(spans: Iterable[tuple[int, int]]) -> Spans:
    """Spans merged where they touch or overlap, in order."""
    out: Spans = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def automata(bench: DataFrame, window: int = 10, max_words: int = MAX_WORDS, item: str = "item_id", text: str = "text") -> Iterator[SuffixAutomaton]:
    """Automata over all items, each of at most max_words words (2 * window at least); one for any usual benchmark.

    Items stream to the driver by partitions; one of more words is cut into pieces that overlap by
    window - 1 words, which keeps every window. Items without words are left out; an empty benchmark
    gives one automaton that hits nothing. Items of equal id count as one. Items without an id hit
    like any other; together they count as one in n_items and do not enter the digest.
    """
    most = max(max_words, 2 * window)
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    rows: list[tuple[str | None, list[bytes]]] = []
    size, made = 0, False
    for r in bench.select(F.col(item).cast("string"), text).toLocalIterator():
        seq = words(r[1])
        for at in range(0, max(1, len(seq) - window + 1), most - window + 1):
            piece = seq[at : at + most]
            if not piece:
                continue
            if size + len(piece) > most:
                yield SuffixAutomaton(sorted(rows, key=key), window)
                rows, size, made = [], 0, True
            rows.append((r[0], piece))
            size += len(piece)
    if rows or not made:
        yield SuffixAutomaton(sorted(rows, key=key), window)


_SPAN = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def match(docs: DataFrame, auto: SuffixAutomaton, text: str, spans: str, items: str, n_words: str, keep_text: bool = True) -> DataFrame:
    """docs with hit spans, items and n_words of every row; what earlier passes left in those columns is merged in."""
    shared = docs.sparkSession.sparkContext.broadcast(auto)
    names = docs.columns
    again = spans in names
    src = docs if again else docs.withColumns({n_words: F.lit(0).cast("long"), spans: F.lit(None).cast("array<struct<s:bigint,e:bigint>>"), items: F.lit(None).cast("array<string>")})
    out = src if keep_text else src.drop(text)
    at, at_spans, at_items = (src.columns.index(c) for c in (text, spans, items))
    kept = [i for i, c in enumerate(src.columns) if keep_text or c != text]
    where = {c: i for i, c in enumerate(out.columns)}

    def run(batches):
        a = shared.value
        for b in batches:
            n, sp, it = [], [], []
            old = zip(b.column(at_spans).to_pylist(), b.column(at_items).to_pylist(), strict=True) if again else ((None, None) for _ in range(b.num_rows))
            for t, (s0, i0) in zip(b.column(at), old, strict=True):
                w = words(t.as_py())
                s1, found = a.hits(w)
                ids = {a.ids[k] for k in found}
                if s0 or i0:
                    s1 = union([*s1, *((x["s"], x["e"]) for x in s0)])
                    ids |= set(i0)
                n.append(len(w))
                sp.append([{"s": x, "e": y} for x, y in s1])
                it.append(sorted(ids, key=lambda x: (x is None, x or "")))
            cols = [b.column(i) for i in kept]
            cols[where[n_words]], cols[where[spans]], cols[where[items]] = pa.array(n, pa.int64()), pa.array(sp, _SPAN), pa.array(it, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [src_names[i] for i in kept])

    src_names = src.columns
    return src.mapInArrow(run, out.schema)


def match_all(docs: DataFrame, autos: Iterator[SuffixAutomaton], text: str, spans: str, items: str, n_words: str, keep_text: bool) -> DataFrame:
    """match by every automaton in turn, holding one at a time; between two of them the rows are written."""
    auto = next(autos)
    for following in autos:
        docs = cut(match(docs, auto, text, spans, items, n_words))
        auto = following
    return match(docs, auto, text, spans, items, n_words, keep_text)


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, max_words: int = MAX_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs.

    Rows are judged one by one: repeated and null ids repeat, whatever their texts, and the result
    does not depend on max_words. Null and empty texts have no words. An empty benchmark hits
    nothing; no rows give none. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = match_all(rows, automata(bench, window, max_words), "text", "spans", "items", "n_words", keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["s"])
    return out.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: str, spans: Spans) -> str:
    """The text without the words in spans (and what stands between them)."""
    import re

    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_MAP))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]].rstrip(b" "))
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _with_text(b: pa.RecordBatch, at: int, size: int | None, new: list[str | None]) -> pa.RecordBatch:
    """The batch with new texts and, where a text changed, its new length."""
    old = b.column(at).to_pylist()
    if size is not None:
        fresh_sizes = [len(x) if x != y else z for x, y, z in zip(new, old, b.column(size).to_pylist(), strict=True)]
        b = b.set_column(size, b.schema.field(size), pa.array(fresh_sizes, b.schema.field(size).type))
    return b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str | None = "n_chars", max_words: int = MAX_WORDS) -> DataFrame:
    """docs without benchmark passages, in the same columns.

    Every hit span goes from the text; a row of whose words more than max_coverage are hit goes as a
    whole. Taking a span out can join words into a new passage, so a text is matched again until it
    is clean. n_chars, if present, is set anew where the text changed. Other rows, null and empty
    texts, repeated rows and other columns stay as they are. The result does not depend on max_words:
    coverage and removal are decided on the spans of all automata together.
    """
    autos = automata(bench, window, max_words)
    auto = next(autos)
    second = next(autos, None)
    at = docs.columns.index(text)
    size = docs.columns.index(n_chars) if n_chars in docs.columns else None
    if second is None:
        return _clean_by_one(docs, auto, max_coverage, at, size)
    spans, items, n_words, left = fresh(docs, "spans", "items", "n_words", "left")
    columns = docs.columns

    def every() -> Iterator[SuffixAutomaton]:
        yield from automata(bench, window, max_words)

    first, done, rest = True, [], docs
    while True:
        found = match_all(rest, every(), text, spans, items, n_words, keep_text=True)
        if first:
            n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["s"])
            found = found.filter(n_hit <= max_coverage * F.col(n_words))
        found = found.drop(items, n_words)
        at_spans = found.columns.index(spans)

        def remove(batches, at_spans=at_spans):
            for b in batches:
                new = [remove_spans(t, [(x["s"], x["e"]) for x in sp]) if sp else t for t, sp in zip(b.column(at).to_pylist(), b.column(at_spans).to_pylist(), strict=True)]
                yield _with_text(b, at, size, new)

        found = cut(found.mapInArrow(remove, found.schema).withColumn(left, F.size(spans) > 0).drop(spans))
        done.append(found.filter(~F.col(left)).select(*columns))
        rest = found.filter(left).select(*columns)
        first = False
        if rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _clean_by_one(docs: DataFrame, auto: SuffixAutomaton, max_coverage: float, at: int, size: int | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches):
        a = shared.value
        for b in batches:
            keep, new, changed = [], [], False
            for t in b.column(at).to_pylist():
                w = words(t)
                spans, _ = a.hits(w)
                keep.append(sum(e - s for s, e in spans) <= max_coverage * len(w))
                while spans and keep[-1]:
                    t = remove_spans(t, spans)
                    spans, _ = a.hits(words(t))
                    changed = True
                new.append(t)
            if changed:
                b = _with_text(b, at, size, new)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT w.doc_id, ws, k.n, unnest(generate_series(1, len(ws) - k.n + 1)) AS i FROM w, (SELECT DISTINCT n FROM bw) k WHERE len(ws) >= k.n)
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
