import itertools
import random

from perilscope.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p><article>";</script></head><body class="post-template">
<header class="site-header"><a href="/">Home</a><h1>The Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-consent" role="dialog"><p>We use cookies to give you the best experience. OK.</p></div>
<article><header><h1>Head &amp; line</h1></header>
<p>First&nbsp;paragraph with <b>bold</b> and
  a <a href="x">link</a>, long enough.
<p>Second, unclosed paragraph &lt;here&gt;.<br>After the break.
<div class="advert">Buy the best product now, it is very cheap today.</div>
<!-- <p>commented out</p> -->
<ul><li>item one<li>item two</ul>
<aside>Related: something quite different that you may like to read.</aside>
<form><p>Your name, please, and the address.</p><input><button>Send it</button></form>
<p>Short.</p></article>
<section class="comments"><article class="comment"><p>I liked this article very much, thanks for it.</p></article></section>
<div class="sidebar"><p>A long text about the author and their many other works.</p></div>
<footer>&copy; all rights reserved, of course.</footer></body></html>"""

TEXT = """Head & line
First paragraph with bold and a link, long enough.
Second, unclosed paragraph <here>. After the break.
item one
item two
Short."""


def test_article():
    assert html_text.main_text(PAGE) == TEXT


def test_page_without_article():
    body = "".join(f"<p>Sentence number {i} of the main story, with some words.</p>" for i in range(5))
    page = f"<div class=menu><a href=1>One</a> <a href=2>Two</a></div><div id=content>{body}</div><div class='footer'>Imprint and contact, all of it.</div>"
    assert html_text.main_text(page).count("\n") == 4


WORDY = " ".join(f"word{i}" for i in range(60)) + "."


def test_wrappers_with_layout_words_hold_content():
    texts = [WORDY.replace("word", f"w{i}x") for i in range(4)]
    side = '<div class="sidebar"><p>A text about the author and their many other works.</p></div>'
    plain = "".join(f"<p>{t}</p>" for t in texts)
    built = "".join(f'<div class="elementor-widget-container"><p>{t}</p></div>' for t in texts)
    for body in (f"{plain}{side}", f"<article><h2>Short</h2>{plain}</article>{side}"):
        page = f'<body><div class="layout sidebar-right">{body}</div></body>'
        lines = html_text.main_text(page).split("\n")
        assert [x for x in lines if x != "Short"] == texts
        assert ("Short" in lines) == ("Short" in page)
    assert html_text.main_text(f"<body>{built}{side}</body>").split("\n") == texts


def test_many_comments_are_no_wrapper():
    comments = "".join(f'<div class="comment"><p>{WORDY}</p></div>' for _ in range(9))
    page = f'<article><p>{WORDY} The end.</p></article><div class="comments">{comments}</div>'
    assert html_text.main_text(page) == f"{WORDY} The end."


def test_formulas_stay_in_their_paragraph():
    formula = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>a=1</annotation></semantics></math>"
    page = f"<article><p>As {formula} holds, it follows. <button>Copy</button></article>"
    assert html_text.main_text(page) == "As a=1 holds, it follows."


def test_broken_pages():
    assert html_text.main_text("") == ""
    assert html_text.main_text("just text, and a few words more.") == "just text, and a few words more."
    for odd in ("<", "<p", "</", "<a href='x", "<!--", "<script>x", "<p><p></p></p></div>", "&#0;&bogus;"):
        html_text.main_text(odd)
    deep = "<div>" * 3000 + "<article><p>Deep down there is a text.</p>" + "</div>" * 10
    assert html_text.main_text(deep) == "Deep down there is a text."
    long = "<article>" + "<p>word words worded.</p>" * 20_000
    assert html_text.main_text(long).count("\n") == 19_999


def cost(labels, gains, edges):
    total = sum(-g if g < 0 else 0 for g, s in zip(gains, labels, strict=True) if s)
    total += sum(g if g > 0 else 0 for g, s in zip(gains, labels, strict=True) if not s)
    return total + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {p: rng.uniform(0, 2) for p in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        best = min(cost(s, gains, edges) for s in itertools.product([True, False], repeat=n))
        assert abs(cost(html_text.minimum_cut(gains, edges), gains, edges) - best) < 1e-9


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<nav>menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_text.extract_pages(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [
        (1, "u", TEXT, len(TEXT)),
        (1, "u", TEXT, len(TEXT)),
        (2, None, "", 0),
        (None, "v", "", 0),
        (3, "w", "", 0),
    ]
    assert html_text.extract_pages(pages.filter("false")).collect() == []
