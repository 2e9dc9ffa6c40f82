"""Main text extraction: generated pages never trained on, the corpus's own pages, odd markup."""

import html
import random
import re
import time

import numpy as np
import pytest

from tidewell.llm.common import load
from tidewell.llm.html_text import MARK, blocks, boost, decode, extract_pages, main_text, nodes_of, parse, trained, training_page


def simple(source):
    """The text of pages that have one plain article of headings and paragraphs."""
    a = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", a[1].replace("<br>", " ")) if a else []
    return "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts) if x)


def test_corpus_pages(spark):
    pages = load(spark, "/root/testdata/sf0.01", "pages")
    rows = {r.page_id: r for r in extract_pages(pages).collect()}
    for p in pages.collect():
        want = simple(p.html)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_unseen_generated_pages():
    rng, model = random.Random(4242), trained()
    pages = [training_page(rng) for _ in range(300)]
    assert np.mean([main_text(s.replace(MARK, ""), model) == want for s, want in pages]) >= 0.97


def every_block(source):
    nodes = nodes_of(parse(source))
    return blocks(nodes, [True] * len(nodes))


@pytest.mark.parametrize("source,want", [
    ("", []),
    (None, []),
    ("plain &amp; text", ["plain & text"]),
    ("<p>a<p>b <b>c<br>d<p>e", ["a", "b c d", "e"]),
    ("<div>x<p>y</div>z", ["x", "y", "z"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("a<!-- <p>no --> b<!-- open", ["a b"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style>t<noscript>n</noscript>", ["t"]),
    ("1 < 2 &lt;b&gt; &#233;&eacute;&#x1F642; &bogus; &am", ["1 < 2 <b> éé🙂 &bogus; &am"]),
    ("<a title='a > b' href=\"<p>\">q</a> <p class=\"unclosed>r</p>s", ["q", "r", "s"]),
    ("x</nothing></p>y<p", ["xy"]),
    ("a\t\n  b", ["a b"]),
    ("<P>UP</P><DIV>per</div>", ["UP", "per"]),
])
def test_parser(source, want):
    assert every_block(source) == want


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(5)
    for _ in range(60):
        nodes = nodes_of(parse("".join(rng.choice(["<div>", "</div>", "<section>", "</section>", "x"]) for _ in range(9))))
        logits = rng.normal(0, 2, len(nodes))
        got = decode(nodes, logits)
        place = {id(n): i for i, n in enumerate(nodes)}
        up = [place[id(n.parent)] if n.parent else None for n in nodes]
        def allowed(bits):
            if bits[0]:
                return False
            for i, b in enumerate(bits):  # an article part's parent is article, or no ancestor is
                if b and not bits[up[i]]:
                    a = up[i]
                    while a is not None:
                        if bits[a]:
                            return False
                        a = up[a]
            return True
        def value(bits):
            return sum(-np.logaddexp(0, -x) if b else -np.logaddexp(0, x) for b, x in zip(bits, logits))
        assert allowed(got)
        best = max(value(b) for m in range(1 << len(nodes)) if allowed(b := [bool(m >> i & 1) for i in range(len(nodes))]))
        assert value(got) == pytest.approx(best)


def test_boosting_learns():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:2000], y[:2000], trees=40)
    assert ((model.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_odd_rows(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>" + "Long text, with words. " * 5000 + "</p></article></body></html>"
    rows = [(1, "u", None, "clash", 1), (2, None, "", "clash", 1), (None, "u", page, "clash", 1), (4, "u", page, "clash", 1), (4, "u", page, "clash", 1), (5, "u", "<nav><a href='x'>only</a></nav>", "clash", 1), (6, "u", "<div>" * 3000 + "deep", "clash", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract_pages(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[1].text == got[2].text == got[5].text == ""
    want = "Title here\n" + ("Long text, with words. " * 5000).strip()
    assert got[4].text == got[None].text == want and got[4].n_chars == len(want)
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", "noscript iframe template svg object canvas audio video".split())
def test_embedded_elements(tag):
    assert every_block(f"<p>a<{tag} x='>'><p>b</p>c") == ["a", "b", "c"]  # no end tag: the rest stays
    assert every_block(f"a<{tag}>no<p>no</{tag.upper()} >b<{tag}/>c") == ["abc"]
    assert every_block(f"a<{tag}>b<{tag}>no</{tag}>c") == ["abc"]
    assert every_block(f"a<{tag}>no<{tag}>no</{tag}>no</{tag}>b") == ["ab"]


def test_raw_elements_without_end_and_math():
    for tag in "script style title textarea".split():
        assert every_block(f"a<{tag}>no<p>no") == ["a"]
        assert every_block(f"a<{tag}>no</{tag}x></{tag} y>b") == ["ab"]
    assert every_block("<p>Let <math><semantics><mrow><mi>n</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>no</annotation></semantics></math> be<p>x") == ["Let n=2 be", "x"]
    assert every_block("<p>a<math><mi>n</mi><p>b") == ["an", "b"]


def test_stray_tags_take_linear_time():
    def seconds(n):
        begin = time.process_time()
        nodes_of(parse("<div>" * n + "</x>" * n + "<hr>" * n + "<p>end"))
        return time.process_time() - begin

    seconds(2000)
    assert seconds(40_000) < 60 * seconds(2000) + 0.2


#: Pages written by hand in the manner of common site templates, none of them made by the generator: (page, main text).
HAND_WRITTEN = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Tides</title><script>var a="<p>x</p>";</script></head>
<body class="home single"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Harbour Notes</a></p>
<nav id="site-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-12" class="post hentry"><h1 class="entry-title">Why the tide turns late</h1>
<div class="entry-content"><p>The harbour fills twice a day, and the second filling is <em>never</em> quite on time.</p>
<p>Old pilots kept a table of the delays; it ran to forty pages &mdash; and it was wrong by ten minutes at most.</p>
<h2>The delay</h2><p>Friction on the sandbanks holds the water back, so the outer gauge leads the inner one by half an hour.</p></div></article>
<div id="comments" class="comments-area"><h2>2 replies</h2><ol class="comment-list"><li class="comment"><p>Great read, thanks for sharing it.</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h3>Recent posts</h3><ul><li><a href="/1">Ropes</a></li><li><a href="/2">Knots</a></li></ul></section></aside></div>
<footer id="colophon"><p>Proudly kept by the harbour office.</p></footer></div></body></html>""",
        "Why the tide turns late\nThe harbour fills twice a day, and the second filling is never quite on time.\nOld pilots kept a table of the delays; it ran to forty pages \u2014 and it was wrong by ten minutes at most.\nThe delay\nFriction on the sandbanks holds the water back, so the outer gauge leads the inner one by half an hour.",
    ),
    (
        """<html><body><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<div class="topbar"><a href="/">News</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a></div>
<div class="main-content"><article class="story"><header><h1>Bridge opens after three years</h1><p>By the city desk, 4 May</p></header>
<p>The new bridge carried its first buses on Monday morning, three years after the old one was closed.</p>
<div class="ad-slot"><p>Buy two tickets, get one free!</p></div>
<figure><img src="b.jpg"><figcaption>The bridge seen from the east bank.</figcaption></figure>
<p>Engineers replaced all of the bearings, and the deck is a metre wider than before.</p>
<blockquote><p>We are glad that it is done, said the mayor.</p></blockquote>
<p>Cyclists get a lane of their own from June.</article>
<div class="related"><h3>More stories</h3><ul><li><a href="/a">Ferry strike ends</a></li><li><a href="/b">Tram line delayed</a></li></ul></div></div>
<div class="newsletter"><p>Get the morning letter.</p><form><input name="e"><button>Sign up</button></form></div>
<div class="footer">&copy; The Daily Bank</div></body></html>""",
        "Bridge opens after three years\nBy the city desk, 4 May\nThe new bridge carried its first buses on Monday morning, three years after the old one was closed.\nThe bridge seen from the east bank.\nEngineers replaced all of the bearings, and the deck is a metre wider than before.\nWe are glad that it is done, said the mayor.\nCyclists get a lane of their own from June.",
    ),
    (
        """<!DOCTYPE html><html><body><nav class="menu"><ul><li><a href="i.html">Install</a><li><a href="c.html">Configure</a><li><a href="r.html">Run</a></ul></nav>
<main role="main"><h1>Configure the pump</h1><p>The pump reads one file when it starts.</p><pre>rate = 12
limit = 40</pre><p>Each line sets one value; lines that begin with a hash are left out.</p>
<table><tr><th>Name<th>Meaning<tr><td>rate<td>strokes a minute</table><ul><li>Restart the pump after a change.<li>Check the gauge.</ul></main>
<footer>Manual, third edition. <a href="/legal">Legal notes</a></footer></body></html>""",
        "Configure the pump\nThe pump reads one file when it starts.\nrate = 12 limit = 40\nEach line sets one value; lines that begin with a hash are left out.\nName\nMeaning\nrate\nstrokes a minute\nRestart the pump after a change.\nCheck the gauge.",
    ),
    (
        """<body><div id="header"><h2>Recipes</h2></div><div id="sidebar"><h3>Seasons</h3><ul><li><a href="s">Spring</a></li><li><a href="w">Winter</a></li></ul></div>
<div id="content"><div class="post"><h1>Barley soup</h1><p>Soak the barley overnight, then drain it.</p><p>Fry an onion, add the barley and two litres of water, and let it simmer for an hour.</p><ol><li>Salt late.</li><li>Serve with dill.</li></ol></div></div>
<div class="share"><a href="t">Share</a><a href="m">Mail</a></div><div id="footer"><p>All recipes tested.</p></div></body>""",
        "Barley soup\nSoak the barley overnight, then drain it.\nFry an onion, add the barley and two litres of water, and let it simmer for an hour.\nSalt late.\nServe with dill.",
    ),
]


def test_hand_written_pages():
    model = trained()
    right = total = found = 0
    for page, want in HAND_WRITTEN:
        got, want = main_text(page, model).split("\n"), want.split("\n")
        right += len(set(got) & set(want))
        total += len(set(got))
        found += len(set(want))
    assert right / total >= 0.9 and right / found >= 0.9, (right, total, found)
