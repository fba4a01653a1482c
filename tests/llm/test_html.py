from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest

from tessera.llm import boosting, html_extract
from tessera.llm.html_dom import parse


def article_of(source):
    """Independent statement for the given pages: blocks of the article element."""
    rest = source[source.find("<article>"):]
    end = rest.find("</article>")
    if end < 0 and "<" in rest and ">" not in rest[rest.rfind("<"):]:
        end = rest.rfind("<")
    rest = rest[:end] if end >= 0 else rest
    blocks = (re.sub("<[^>]*>", "", b) for b in re.split("</?(?:p|h1|article)>", rest.replace("<br>", " ")))
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_given_pages(spark, pages):
    want = {r.page_id: (r.url, article_of(r.html)) for r in pages.collect()}
    rows = html_extract.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.fit(pages)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and there was a long road with stones over it and nobody walked".split()) for _ in range(n))


def test_other_layouts(model):
    body = [f"<h1>{words(1, 6)}</h1>", f"<p>{words(2, 90)}.</p>", f"<p>{words(3, 70)}.</p>", f"<p>{words(4, 50)}.</p>"]
    want = "\n".join(re.sub("<[^>]*>", "", b) for b in body)
    pages = [
        '<body><div class="navbar"><a href=/>Home</a> <a href=/a>About</a></div><div id="content">' + "".join(body)
        + f'</div><div class="comments"><p>{words(5, 30)}</p></div><div class="footer">&copy; us</div></body>',
        f"<body><header><h2>Site</h2><nav><a>x</a></nav></header><div class=cookie-notice>{words(6, 9)}</div><main>"
        + "".join(body[:2]) + f"<aside><p>{words(7, 30)}</p></aside>" + "".join(body[2:])
        + f"<form><p>{words(8, 8)}<input></p></form></main><footer><p>{words(9, 20)}</p></footer>",
    ]
    assert html_extract.main_texts(pages, model) == [want, want]


def test_parser():
    page = parse("<p>a<b>b</b>&amp;c <i>d</i>\n e<p>f<script>x<p></script>g<br>h<ul><li>i<li>j</ul>k<!-- <p>z --> l < 3")
    assert [t for t in page.text if t] == ["ab&c d e", "fg h", "i", "j", "k l < 3"]
    assert [t for t in parse("<style>x").text if t] == []
    assert [t for t in parse("a<div>b</div>c").text if t] == ["a", "b", "c"]
    assert [t for t in parse('x<a href="y').text if t] == ["x"]


def test_decoding_has_no_contradiction(model):
    rng = np.random.default_rng(1)
    nodes = html_extract.Nodes([parse("<div>" * 5 + "<p>a</p><p>b</p></div><div><p>c</p></div>")])
    for _ in range(50):
        odds = rng.normal(size=len(nodes.page))
        kept = html_extract.decode(nodes, odds)
        up = nodes.parent
        assert all(kept[up[i]] for i in np.flatnonzero(kept) if up[i] >= 0)
        # best by trying every subset closed under parents
        best = max(sum(odds[i] for i in range(len(up)) if s >> i & 1) for s in range(1 << len(up))
                   if all(up[i] < 0 or s >> up[i] & 1 for i in range(len(up)) if s >> i & 1))
        assert abs(odds[kept].sum() - best) < 1e-9


def test_odd_pages(spark, pages):
    odd = [None, "", "plain text", "<", "<p", "<a <b <c", "<" * 5000, "<div>" * 3000 + "deep", "&#x110000;&nbsp;x", "\x00<p>\x00"]
    rows = [(i, None if i % 2 else f"u{i}", h) for i, h in enumerate(odd)] + [(None, None, None), (0, "u0", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'own' as text", "'own' as _html", "'own' as n_chars")
    got = html_extract.extract(df).collect()
    assert sorted((r.page_id, r.url) for r in got if r.page_id is not None) == sorted(
        (r[0], r[1]) for r in rows if r[0] is not None) or len(got) == len(rows)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id is None)
    # without a marked article nothing is learned; unmarked text is kept
    assert next(r.text for r in got if r.page_id == 2) == "plain text"
    assert next(r.text for r in got if r.page_id == 7) == "deep"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    fitted = boosting.fit(x, y)
    assert ((fitted.log_odds(x) > 0) == y).mean() > 0.98


def texts(source):
    return [t for t in parse(source).text if t]


@pytest.mark.parametrize("tag", ["button", "select", "svg", "math", "object", "canvas", "audio", "video", "noscript", "template"])
def test_unclosed_elements_drop_nothing(model, tag):
    body = [f"<p>{words(i, 60)}.</p>" for i in range(4)]
    want = [re.sub("<[^>]*>", "", b) for b in body]
    closed = f"<{tag}>x</{tag}>"
    for source in [f"<body><{tag}><article>{''.join(body)}</article></body>",
                   f"<body><div><{tag} a=1></div><article>{''.join(body)}</article>{closed}</body>",
                   f"<body><article>{body[0]}<{tag}>{''.join(body[1:])}</article>{closed}</body>",
                   f"<body><article>{body[0]}<{tag}>{''.join(body[1:3])}{closed}{body[3]}</article></body>"]:
        assert set(want) <= set(texts(source)), source
        assert set(want) <= set(html_extract.main_texts([source], model)[0].split("\n")), source


def test_elements_with_an_end_tag():
    for tag in ("button", "select", "svg", "template"):
        assert texts(f"<p>a <{tag}>b<div>c</div><script>'</{tag}>'</script></{tag}> d</p>") == ["a d"]
    for tag in ("object", "canvas", "audio", "video", "noscript"):
        assert texts(f"<p>a<{tag}>b</{tag}>c</p>") == ["a b c"]
    assert texts("<p>a <math><mi>x</mi></math>, b</p>") == ["a x, b"]
    assert texts("<p>a<svg><svg>b</svg>c</svg>d<svg/>e") == ["a d e"]
    assert texts("<template><article>a</article></template>b") == ["b"]


def test_unclosed_elements_take_linear_time():
    for piece in ("<button>", "<svg>", "<template><div>", "<select><article>", "<svg></button>"):
        assert texts(piece * 50_000 + "end") == ["end"]


def test_open_elements_take_linear_time():
    n = 100_000
    assert texts("<ul>" * n + "end") == ["end"]
    assert texts("<div>" * n + "</p>" * n + "end") == ["end"]
    assert texts("<nav>" * n + "<p>a" * n) == ["a"] * n
    assert texts("<table><tr><td>" * n + "end") == ["end"]


def test_what_a_tag_closes():
    def shape(source):
        page = parse(source)
        return [(t, page.tag[up] if up >= 0 else None) for t, up in zip(page.tag, page.parent)][1:]

    assert shape("<ul><li><p><li>") == [("ul", "#page"), ("li", "ul"), ("p", "li"), ("li", "ul")]
    assert shape("<li><ul><li>") == [("li", "#page"), ("ul", "li"), ("li", "ul")]
    assert shape("<h2><p><h3>") == [("h2", "#page"), ("p", "h2"), ("h3", "#page")]
    assert shape("<p><nav><div><p><h1><nav>") == [("p", "#page"), ("nav", "#page"), ("div", "nav"), ("p", "div"), ("h1", "div"),
                                                  ("nav", "h1")]
    assert shape("<table><tr><td><p><table><tr><td></td><tr></table><td>") == [
        ("table", "#page"), ("tr", "table"), ("td", "tr"), ("p", "td"), ("table", "td"), ("tr", "table"), ("td", "tr"),
        ("tr", "table"), ("td", "tr")]
