from __future__ import annotations

import re

import duckdb
import pytest

from tabloom.llm.html_text import digest, main_text, smoothed

LONG = "Some running text of an article that goes on for a while, so that it is plainly content. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>The &amp; title</h1></header>
<p>First   <b>bold</b>&nbsp;text<br>more {LONG}
<p>Short.</p><div class="advert">Buy now</div><ul><li>item one<li>item <i>two</i></ul>
<table><tr><td>a</td><td>b</td></tr></table><form><p>name</p><input></form>
<section id="comments"><article><p>{LONG * 3}</p></article></section><footer>by me</footer></article>
<aside>{LONG}</aside><div role="navigation">menu</div><footer>&copy; 2020</footer>"""


def test_page():
    assert main_text(PAGE).split("\n") == ["The & title", f"First bold text more {LONG.strip()}", "Short.", "item one", "item two", "a", "b"]


def test_without_article():
    page = f"<body><div><a>x</a> <a>y</a></div><div><div><h2>Head</h2><p>{LONG * 2}</p><p>{LONG}</p><p>end</p></div></div><div><a>z</a><a>u</a></div></body>"
    assert main_text(page).split("\n") == ["Head", (LONG * 2).strip(), LONG.strip(), "end"]


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- a", ""), ("<article><p>one</article", "one"), ("a < b &lt; c", "a < b < c"), ("<p hidden>x</p><p>y</p>", "y")])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_smoothing():
    assert smoothed([2.0] * 5, 1.0) == pytest.approx([2.0] * 5)
    assert smoothed([0, 0, 9, 0, 0], 1.0)[2] == max(smoothed([0, 0, 9, 0, 0], 1.0))


def plain(html):
    """The article element of the simple test pages, by patterns."""
    import html as h

    body = re.search(r"<article>(.*?)</article", html, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|article)[^>]*>", re.sub(r"<br>", " ", body))
    texts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_table(spark, sf):
    rows = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    pages = spark.createDataFrame([*rows, (-1, None, None), (-1, None, None)], "page_id long, url string, html string")
    got = sorted(map(tuple, digest(pages).collect()), key=lambda r: r[0])
    want = [(i, u, plain(t), len(plain(t))) for i, u, t in sorted(rows)]
    assert got == [(-1, None, "", 0)] * 2 + want
    assert digest(pages.where("false")).collect() == []
