import itertools

import numpy as np
import pytest
from conftest import SF_CHECK
from flowrisk.llm import html_text
from flowrisk.llm.html_text import BOILER, CONTENT, TreeModel, parse

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_sum_product_equals_enumeration():
    """Marginals of a small tree against the sum over all labellings."""
    html = "<div>ab<p>some text here</p><nav>x<a href=y>link</a></nav></div><article><p>more text</p></article>"
    page, model = parse(html), TreeModel()
    n = len(page.tag)
    unary = np.exp(np.clip(html_text.features(page) @ model.weights, -2, 2))
    total = np.zeros((n, 3))
    for y in itertools.product(range(3), repeat=n):
        p = [1.0, 1e-9, 1e-9][y[0]]
        for i in range(n):
            if page.kind[i] == html_text.PLAIN and page.own[i] and y[i] == CONTENT:
                p *= unary[i]
            if i:
                p *= model.edge[page.kind[i], y[page.parent[i]], y[i]]
        for i in range(n):
            total[i, y[i]] += p
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(model.marginals(page), want, atol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href=/b>About</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-banner">We use cookies<button>OK</button></div>
<article class="post"><h1>Title &amp; more</h1><p>First   <b>bold</b>
line&nbsp;here &lt;tag&gt;<p>Second <a href=x>linked</a> one<br>after break.
<div class="ad">Buy now</div><ul><li>one<li>two</ul><aside>Related reading</aside><blockquote>Quoted &eacute;</blockquote>
<form><input name=q><label>Search</label></form><section class="comments"><article class="comment"><p>I disagree strongly with all of this</p></article></section>
<p>A comment on <i>notice</i> words stays.</p></article>
<div id="sidebar"><p>Long sidebar text, as long as an article has it, with commas, and more words, and so on.</p></div>
<footer>&copy; someone</footer></body></html>"""
TEXT = ["Title & more", "First bold line here <tag>", "Second linked one after break.", "one", "two", "Quoted é", "A comment on notice words stays."]


def test_extracts_the_article():
    assert TreeModel().extract(PAGE).split("\n\n") == TEXT


def test_extracts_after_learning():
    model = html_text.learn([PAGE] * 30)
    assert model.extract(PAGE).split("\n\n") == TEXT


def test_pages_without_marks_are_decided_by_the_model():
    page = "<body><div class=menu><a href=a>x</a></div><div id=text>" + "<p>A long paragraph of plain text that nobody marked as an article, just like that.</p>" * 6 + "</div><div class=footer>(c)</div></body>"
    got = html_text.learn([PAGE] * 30).extract(page)
    assert "(c)" not in got and "x" not in got.split("\n\n")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("<article>", ""),
        ("<article><p>a<p>b", "a\n\nb"),
        ("<main>x < y & z &amp; &#955;</main>", "x < y & z & λ"),
        ("<article><p>a</b></i></p></article></p></div>", "a"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table>t</article>", "1\n\n2\n\n3\n\nt"),
        ("<article><p>one<script>if (a<b) x</script> two</p><textarea>t</textarea></article>", "one two"),
        ("<article><p><b>bold<p>next</b> on</article>", "bold\n\nnext on"),
        ('<article><p title="a > b">q</p></article>', "q"),
        ("<article>" + "<div>" * 150 + "deep" + "</div>" * 150 + "</article>", "deep"),
    ],
)
def test_mark_up(html, want):
    assert TreeModel().extract(html) == want


def test_rows(spark):
    rows = [(1, "u", PAGE, "x", "y"), (2, None, None, None, None), (3, "v", "", "x", "y"), (None, "w", "<article>" + "<p>word</p>" * 50_000 + "</article>", "x", "y"), (1, "u", PAGE, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = html_text.extract(df, html_text.train(df))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got.collect()}
    assert by[1]["text"].split("\n\n") == TEXT and by[2]["text"] == "" and by[3]["n_chars"] == 0
    assert by[None]["text"].count("word") == 50_000
    assert got.count() == 5
    assert html_text.extract(df.limit(0), html_text.train(df.limit(0))).count() == 0


def test_pages_of_the_table(spark):
    """Every page marks its article: its blocks, cut out by hand, are the text."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, html_text.train(pages)).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_labels_of_marked_pages():
    page = parse(PAGE)
    labels = html_text.marked_labels(page)
    assert {page.tag[i] for i, y in enumerate(labels) if y == CONTENT} == {"article", "h1", "p", "ul", "li", "blockquote"}
    assert labels[page.tag.index("nav")] == BOILER
    assert html_text.marked_labels(parse("<p>x</p>")) is None


SENTENCE = "This is a sentence of an article, like any other. "


@pytest.mark.parametrize("learned", [False, True])
@pytest.mark.parametrize(
    "blocks",
    [[("div", 10)], [("div", 200)], [("p", 4)] * 2, [("div", 100)] * 3, [("h1", 1), ("p", 4), ("p", 8)]],
)
def test_unmarked_pages_give_their_article(blocks, learned):
    model = html_text.learn([PAGE] * 30) if learned else TreeModel()
    body = "".join(f"<{tag}>{SENTENCE * n}</{tag}>" for tag, n in blocks)
    want = "\n\n".join((SENTENCE * n).strip() for _, n in blocks)
    assert model.extract(f"<html><body><div>{body}</div></body></html>") == want
    around = '<nav><ul><li><a href="/a">Home</a></ul></nav>', '<div><a href="/b">One link</a> <a href="/c">Other link</a></div><div class="footer">(c)</div>'
    assert model.extract(f"<html><body>{around[0]}<div>{body}</div>{around[1]}</body></html>") == want


def test_pages_of_the_table_with_their_marks_hidden(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").orderBy("page_id").collect()]
    half = len(pages) // 2
    model = html_text.learn(pages[:half])
    for html in pages[half:]:
        bare = html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.marked_labels(parse(bare)) is None and model.extract(bare) == model.extract(html) != ""


def test_any_depth_of_nesting():
    for deep in (1_500, 2_500, 20_000):
        page = html_text.parse("<div>" * deep + "<nav>" + "<div>" * 1_600 + "Home About" + "</div>" * 1_600 + "</nav>" + "<p>text</p>")
        nav = page.tag.index("nav")
        for node, text in page.pieces:
            inside = False
            at = node
            while at > 0 and not inside:
                inside, at = at == nav, page.parent[at]
            assert text is None or inside == (text == "Home About")


def test_quotes_in_attributes():
    said = lambda html: [t for _, t in html_text.parse(html).pieces if t]
    assert said('<div class=a"b>one</div>two') == ["one", "two"]
    assert said("<p class=it's>one</p><p>two</p>") == ["one", "two"]
    assert said('<p class="it>one</p><p>two</p>') == ["one", "two"]  # never closed: ends with the tag
    assert said("<p title='a > b' class=\"c\"d=e>one</p>") == ["one"]
    assert said("one <b") == ["one "] and said("1 < 2 > 0") == ["1 < 2 > 0"]
    kinds = lambda html: html_text.parse(html).kind[1:]
    assert kinds("<div title='class=nav'>x</div><div CLASS = nav>y</div>") == [html_text.PLAIN, html_text.SHUNNED]
