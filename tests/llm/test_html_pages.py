"""Operator 3 on hand-written pages of other make than its generator's, on broken markup, and on deep and wide pages."""

import random
import re
import time

import pytest

from engramix.llm import html_extraction as h

HEAD = "<!doctype html><html><head><title>Weekly report</title><style>p{color:red}</style></head>"
P1 = "The council met on Tuesday evening to discuss the new bridge across the river, and most members spoke in favour of it."
P2 = "Work is expected to begin in spring. Engineers have measured the ground twice, and say that it will carry the load."
P3 = "Residents of the old quarter asked for a quieter road surface; the mayor promised to look into it before the vote."

PAGES = {
    "news": f'{HEAD}<body><header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/a">World</a><li><a href="/b">Sports</a></ul></nav></header><main><article class="story"><h1>New bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>Good news at last.</p></div></section></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Rain again</a></li><li><a href="/2">Market prices</a></li></ul></aside><footer><p>Copyright The Daily</p></footer></body></html>',
    "divs": f'<html><body><div id="top" class="navbar"><a href="/">Home</a> <a href="/about">About</a></div><div class="container"><div class="post-content"><h1>New bridge</h1><p>{P1}<p>{P2}<p>{P3}</div><div class="share"><a href="x">Tweet</a> <a href="y">Mail</a></div></div><div class="footer">All rights reserved.</div></body></html>',
    "nobody": f"<title>t</title><div class=\"menu\"><a href=/>Home</a> | <a href=/n>News</a></div><article><h1>New bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>",
}
WANT = f"New bridge\n\n{P1}\n\n{P2}\n\n{P3}"


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert h.extract([PAGES[name]], h.train()) == [WANT]


@pytest.mark.parametrize("piece", ["<option>A", "<select>A", "<svg><path/>", "<math><mi>x</mi>", "<video src=a>", "<object data=a>", "<canvas>", "<noscript>", "<iframe src=x>", "<textarea>", "<template>", "<datalist><option>a", "<svg/>", "<!-- note -->", "<script>var a='<p>x</p>'</script>", "<style>p{}</style>"])
def test_pieces_swallow_nothing(piece):
    page = f"<html><body><article><h1>New bridge</h1><p>{P1}</p><p>{P2} {piece}</p><p>{P3}</p></article></body></html>"
    got = h.extract([page], h.train())[0]
    assert all(x in got for x in ("New bridge", P1, P2, P3)) and "var a" not in got


CODES = ["<script>var x=1; function f(){return x<2 && '<p>no</p>'}", "<style>p{color:red} .a>b{margin:0}", "<script>// don't\nlet a=`<div>${b}</div>`; /* <p>old</p> */ go()", "<script type=x>if(a<b){}"]


@pytest.mark.parametrize("code", CODES)
def test_code_without_an_end_tag_is_no_text(code):
    cut_short = f"<html><body><article><h1>New bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>{code}"
    within = f"<html><body><article><h1>New bridge</h1>{code}<p>{P1}</p><p>{P2} {code}</p><p>{P3}</p></article></body></html>"
    head = f"<html><head>{code}<body><article><h1>New bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article></body></html>"
    for page in (cut_short, within, head):
        assert h.extract([page], h.train())[0] == WANT, page


def test_markup_equals_a_plain_reading():
    """Against one regular expression for each kind of piece, over random pages."""
    plain = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S)
    r = random.Random(3)
    pieces = ["<", ">", "<a ", "</b", '"', "'", "x", " ", "/", "<!--", "-->", "<![CDATA[", "]]>", "<!d", "<?x", "<p>", "=", "</ >", "<1>"]
    for _ in range(3000):
        page = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        markup, pos = h.Markup(page), 0
        while True:
            got, m = markup.next(pos), plain.search(page, pos)
            assert (got is None) == (m is None), page
            if m is None:
                break
            want = (m.start(), m.end(), m[1], m[2] or m[5] or "", m[3] or m[6] or "", m[4] if m[3] else m[7] or "")
            assert got == want, (page, pos)
            pos = m.end()


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<![CDATA[", '<a ">"', "<a '\"", "<!", "<", "</script ", "<script>", "<script>'", "<style>/*", "<script>\\'", "<b c='"])
@pytest.mark.parametrize("tail", ["", ">", "'>"])
def test_broken_markup_takes_linear_time(piece, tail):
    began = time.process_time()
    h.parse(piece * 100_000 + tail)
    assert time.process_time() - began < 4


def test_optional_end_tags_and_entities():
    page = f"<html><body><article><h1>A&amp;B &lt;x&gt; &#233;&nbsp;&euro;</h1><p>{P1}<p>{P2}<ul><li>{P3}<li>{P1}</ul><dl><dt>Term<dd>{P2}</dl><table><tr><td>{P3}<td>{P1}<tr><td>{P2}</table></article></body></html>"
    assert h.extract([page], h.train())[0].split("\n\n") == ["A&B <x> é €", P1, P2, P3, P1, "Term", P2, P3, P1, P2]


@pytest.mark.parametrize("page", [f"{P1}<br>{P2} <b>bold</b> <br>{P3}", f"<span>{P1}</span><br><font>{P2}</font><br>{P3}", f"<html><body><p>{P1}</p></body>{P2} {P3}"])
def test_text_outside_of_blocks(page):
    got = h.extract([page], h.train())[0]
    assert P1 in got and P2 in got and P3 in got


def test_long_articles_are_whole():
    paras = [f"{i}. {P1 if i % 3 else P2}" for i in range(400)]
    page = PAGES["divs"].replace(f"<p>{P2}", "".join(f"<p>{x}</p>" for x in paras))
    assert h.extract([page], h.train())[0] == f"New bridge\n\n{P1}\n\n" + "\n\n".join(paras) + f"\n\n{P3}"


def test_deep_and_wide_pages_take_linear_time():
    model = h.train()
    h.extract([PAGES["news"]], model)
    for make in (lambda n: "<div>" * n + P1 + "</div>" * n, lambda n: "<ul><li>" * n + P1, lambda n: "<p>a" * n, lambda n: "<svg>a " * n, lambda n: "<b><p>x" * n):
        took = []
        for n in (2000, 16000):
            began = time.process_time()
            h.extract([make(n)], model)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 1.0


def test_spark_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGES["news"], "x"), (1, "u", PAGES["news"], "y"), (None, None, PAGES["divs"], "z"), (2, "u", None, None), (3, "u", "", None), (4, "u", "<<<>", None)], "page_id long, url string, html string, text string")
    got = h.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = [(r["page_id"], r["n_chars"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, len(WANT)), (1, len(WANT)), (None, len(WANT)), (2, 0), (3, 0), (4, dict(rows)[4])], key=str)
    assert h.extract_pages(df.limit(0)).count() == 0
