r"""Operator 12, URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks: a rule of m literals takes m + 1 bits, bit i
standing for "the first i literals are read, and what follows a star so far". One step over a byte c is

    D = ((D << 1) & B[c]) | (D & L[c])

with B[c] the bits whose literal is c and L[c] the bits that a star after them lets stay on c, so all
rules advance at once, whatever stars they hold. A batch of URLs is stepped together, longest first,
so that the rows still being read are always the first ones.

Globs: `*` is any run of bytes but `/`, `?` and `#`; `**` any run; `?` one character; a backslash
takes the next character as it is. They are held against the canonical URL: a dot, the host with A-Z
lower-cased, the path, and `?` with the query if there is one. Scheme and fragment don't count. The
dot lets `*.example.com/` stand for a host and all its subdomains.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

WORDS = 1 << 10  # 64-bit words of one automaton; more rules make several, stepped one after another
CELLS = 1 << 20  # rows * words stepped at once

_U = np.uint64
_HOST_STOPS = b"/?#"


@dataclass(frozen=True)
class Rule:
    """`name` is what the result shows. Of the rules that fit, the first in a list ordered by rank() wins."""

    action: str
    glob: str
    name: str | None = None

    def __post_init__(self):
        if self.action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {self.action!r}")

    def literals(self) -> int:
        return sum(kind != "star" for kind, _ in parse(self.glob))


def site(action: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and for the paths that begin with path, which begins with a slash."""
    if not path.startswith("/"):
        raise ValueError("a site rule's path begins with a slash")
    quoted = "".join("\\" + c if c in "*?\\" else c for c in host + path)
    return Rule(action, f"*.{quoted}**", host + path)


def parse(glob: str) -> list[tuple[str, object]]:
    """("byte", b), ("any", None) for one character and ("star", False or True: over everything)."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            wide = glob.startswith("**", i)
            out.append(("star", wide))
            i += 1 + wide
            continue
        if c == "?":
            out.append(("any", None))
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += [("byte", b) for b in c.encode("utf-8", "surrogatepass")]
        i += 1
    return out


class Automaton:
    """Masks of a list of globs, and the set of globs that fit each of many strings."""

    def __init__(self, globs: list[str]):
        parsed = [parse(g) for g in globs]
        sizes = [1 + sum(kind != "star" for kind, _ in p) for p in parsed]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if globs else np.empty(0, np.int64)
        self.words = max(1, -(-sum(sizes) // 64))
        read = np.zeros((256, self.words), _U)
        stay = np.zeros((256, self.words), _U)
        narrow = np.array([c not in _HOST_STOPS for c in range(256)])
        tail = np.array([0x80 <= c < 0xC0 for c in range(256)])  # further bytes of a character
        for at, p in zip(starts.tolist(), parsed, strict=True):
            for kind, x in p:
                if kind != "star":
                    at += 1
                w, bit = at >> 6, _U(1) << _U(at & 63)
                if kind == "star":
                    stay[:, w] |= np.where(True if x else narrow, bit, _U(0))
                elif kind == "any":
                    read[:, w] |= np.where(tail, _U(0), bit)
                    stay[:, w] |= np.where(tail, bit, _U(0))
                else:
                    read[x, w] |= bit
        self.read, self.stay = read, stay
        self.first = self._mask(starts)
        self.last = starts + np.array(sizes, np.int64) - 1 if globs else starts

    def _mask(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, _U)
        np.bitwise_or.at(out, bits >> 6, _U(1) << (bits & 63).astype(_U))
        return out

    def fits(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bool (strings, globs) for the strings data[start : start + size]."""
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        d = np.repeat(self.first[None, :], len(order), 0)
        ends = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")  # rows of at least t bytes
        for t, n in enumerate(ends.tolist()):
            c, now = data[at[:n] + t], d[:n]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            d[:n] = (moved & self.read[c]) | (now & self.stay[c])
        hit = (d[:, self.last >> 6] >> (self.last & 63).astype(_U)) & _U(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


@dataclass(frozen=True)
class UrlFilter:
    """rules: what is asked for, the longest (most literals) wins; where none fits, the same among policy, and at last `default`.

    Of rules of one length that all fit, block wins over allow, then the least glob.
    """

    rules: tuple[Rule, ...]
    policy: tuple[Rule, ...] = ()
    default: str = "allow"
    words: int = WORDS
    ranked: tuple[Rule, ...] = field(init=False, default=())

    def __post_init__(self):
        rank = lambda r: (-r.literals(), r.action != "block", r.glob)
        object.__setattr__(self, "ranked", (*sorted(self.rules, key=rank), *sorted(self.policy, key=rank)))

    def automata(self) -> list[Automaton]:
        """In the order of the ranks; each of at most `words` words unless a single rule has more."""
        groups, bits = [[]], 0
        for r in self.ranked:
            n = 1 + r.literals()
            if groups[-1] and bits + n > 64 * self.words:
                groups.append([])
                bits = 0
            groups[-1].append(r.glob)
            bits += n
        return [Automaton(g) for g in groups if g]

    def first(self, automata: list[Automaton], urls: pa.Array) -> np.ndarray:
        """The place in `ranked` of the rule that decides each string; -1 if none fits."""
        urls = urls.cast(pa.large_binary())
        bounds = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1] if len(urls) else np.zeros(1, np.int64)
        data = np.frombuffer(urls.buffers()[2] or b"", np.uint8)
        start, size = bounds[:-1], np.diff(bounds)
        out, base = np.full(len(urls), -1, np.int64), 0
        for a in automata:
            step = max(1, CELLS // a.words)
            open_ = np.flatnonzero(out < 0)
            for i in range(0, len(open_), step):
                some = open_[i : i + step]
                hit = a.fits(data, start[some], size[some])
                out[some] = np.where(hit.any(1), hit.argmax(1) + base, -1)
            base += len(a.last)
        return out


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with its `?`) of a URL; all empty for null and where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2), part(3)


def filter_urls(pages: DataFrame, filter_: UrlFilter, url: str = "url") -> DataFrame:
    """All columns of pages with `host`, `path`, `rule` (name of the rule that decided; null if no rule but policy or default did) and `verdict`.

    Columns of these names are replaced. A null URL and one without `://` have an empty host and path
    and are judged as such; URLs of any length are read whole; an empty table gives no rows.
    """
    host, path, query = host_path(F.col(url))
    h, p, canon, k = fresh(pages, "host", "path", "canon", "k")
    split = pages.withColumns({h: host, p: path, canon: F.concat(F.lit("."), host, path, query)})
    ruled = len(filter_.rules)
    schema = T.StructType([f if f.name != canon else T.StructField(k, T.LongType()) for f in split.schema])

    def run(batches):
        automata = filter_.automata()
        for b in batches:
            at = b.schema.get_field_index(canon)
            yield b.set_column(at, k, pa.array(filter_.first(automata, b.column(at)), pa.int64()))

    found = split.mapInArrow(run, schema)
    names = F.array(*[F.lit(r.name or r.glob) for r in filter_.ranked[:ruled]], F.lit(None).cast("string"))
    actions = F.array(*[F.lit(r.action) for r in filter_.ranked], F.lit(filter_.default))
    row = F.when(F.col(k) < 0, F.lit(len(filter_.ranked))).otherwise(F.col(k)).cast("int")
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return found.select(
        *[F.col(f"`{c}`") for c in rest], F.col(h).alias("host"), F.col(p).alias("path"),
        F.when(F.col(k).between(0, ruled - 1), F.get(names, row)).alias("rule"), F.get(actions, row).alias("verdict"),
    )


#: The contract's rules, and a policy for all other URLs: pages that are no articles.
RULES = (
    site("allow", "com", "/"), site("block", "example.com", "/en/"), site("allow", "www.example.com", "/en/"), site("block", "net", "/es/"), site("block", "net", "/fr/"),
)
POLICY = tuple(Rule("block", g) for g in ("*/login/**", "*/cart/**", "*/search/**", "**/wp-admin/**", "*/**.exe", "*/**.zip", "*/**.jpg"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, UrlFilter(RULES, POLICY)).select("page_id", "host", "path", "rule", "verdict")


#: DuckDB equivalent: rules by length, then the policy's globs as regular expressions.
ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_full_match('.' || host || path || query, '(?s)[^/?#]*/((login|cart|search)/.*|.*\.(exe|zip|jpg))|.*/wp-admin/.*') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
