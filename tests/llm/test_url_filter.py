"""URL filters against regular expressions, and on odd URLs and tables."""

import random
import re

import numpy as np
import pyarrow as pa

from engramix.llm import url_filter
from engramix.llm.url_filter import Automaton, Rule, UrlFilter, filter_urls, site


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/?#]*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out, re.S)


def hits(automaton, texts):
    raw = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return automaton.fits(data, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


def test_all_globs_at_once_equal_regular_expressions():
    r = random.Random(7)
    letters = ["a", "b", "/", "?", "é", "*", "**", "\\*", "\\?", "."]
    globs = ["", "*", "**", "?"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = ["", "a" * 300, "/" * 70] + ["".join(r.choice("ab/?é*.#") for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = hits(Automaton(globs), texts)
    rules = [as_regex(g) for g in globs]
    for i, t in enumerate(texts):
        assert got[i].tolist() == [bool(x.fullmatch(t)) for x in rules], t
    assert got.sum() > 300


def test_several_automata_choose_as_one():
    r = random.Random(8)
    rules = tuple(Rule(r.choice(["allow", "block"]), "".join(r.choice(["a", "b", "*", "?"]) for _ in range(r.randint(1, 40)))) for _ in range(200))
    texts = pa.array(["".join(r.choice("ab") for _ in range(r.randint(0, 30))) for _ in range(200)])
    one, many = UrlFilter(rules), UrlFilter(rules, words=1)
    assert len(one.automata()) == 1 and len(many.automata()) > 20
    got = one.first(one.automata(), texts)
    assert got.tolist() == many.first(many.automata(), texts).tolist()
    for t, k in zip(texts.to_pylist(), got.tolist(), strict=True):
        fit = [i for i, x in enumerate(one.ranked) if as_regex(x.glob).fullmatch(t)]
        assert k == (fit[0] if fit else -1)
    sliced = texts.slice(50, 20)
    assert one.first(one.automata(), sliced).tolist() == got[50:70].tolist()


URLS = {
    "http://EXAMPLE.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
    "https://www.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.www.example.com/en/a?b#c": ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    "https://wwwexample.com/en/": ("wwwexample.com", "/en/", "com/", "allow"),
    "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com?x=.com/": ("example.com", "", None, "allow"),
    "http://example.org/a.net/es/": ("example.org", "/a.net/es/", None, "allow"),
    "ftp://net/es/": ("net", "/es/", "net/es/", "block"),
    "x://a.net/fr/?q": ("a.net", "/fr/", "net/fr/", "block"),
    "x://a.net/fr#q": ("a.net", "/fr", None, "allow"),
    "http://a.org/login/now": ("a.org", "/login/now", None, "block"),
    "http://a.org/b.exe": ("a.org", "/b.exe", None, "block"),
    "http://a.org/b.exe?x": ("a.org", "/b.exe", None, "allow"),
    "a//b.com/en": ("", "", None, "allow"),
    "http://a.com://b.net/es/": ("a.com:", "//b.net/es/", None, "allow"),
    "http://a\nb.com/\n/x": ("a\nb.com", "/\n/x", "com/", "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://ü.com/" + "z" * 100_000: ("ü.com", "/" + "z" * 100_000, "com/", "allow"),
}


def test_rules_on_odd_urls(spark):
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, Host string, verdict string, _k int")
    got = filter_urls(df, UrlFilter(url_filter.RULES, url_filter.POLICY))
    assert got.columns == ["page_id", "url", "_k", "host", "path", "rule", "verdict"]
    found = got.collect()
    assert len(found) == len(rows)
    for x in found:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == URLS[x["url"]], x["url"]
    assert filter_urls(df.limit(0), UrlFilter(url_filter.RULES)).count() == 0
    assert {x["verdict"] for x in filter_urls(df, UrlFilter((), default="block")).collect()} == {"block"}


def test_site_rules_take_wildcards_as_they_are(spark):
    df = spark.createDataFrame([(1, "http://a.org/x*y"), (2, "http://a.org/xzy"), (3, None)], "page_id long, url string")
    got = {x["page_id"]: x["rule"] for x in filter_urls(df, UrlFilter((site("block", "a.org", "/x*y"),))).collect()}
    assert got == {1: "a.org/x*y", 2: None, 3: None}
