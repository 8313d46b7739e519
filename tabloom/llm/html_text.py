"""The main text of web pages from a stream of parser events.

The standard library's parser reports tags and text in page order. Block tags end a line; each
line has its characters and its tags, and their ratio, smoothed along the page by a Gaussian,
is high in running text and low in menus. Lines above a threshold (a share of the deviation of
the smoothed ratios) are grouped into clusters, and the clusters choose the region of the page
that is its content: the article elements that hold some, or else the smallest element around
most of their text. Inside the region every block counts, short ones too, but for elements
that by their tag, role or name are menus, headers, footers, sidebars, notices, adverts, forms
or comments.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import map_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture".split()
)
# elements without article text, whatever is in them
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea fieldset iframe object embed "
    "svg math canvas audio video dialog menu datalist option".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
# words in class and id that name such elements
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail comment comments "
    "respond reply replies disqus cookie cookies consent gdpr notice notices alert alerts warning menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer share sharing social related recommended recommendations widget widgets popup modal "
    "overlay newsletter subscribe subscription signup login search pagination pager copyright disclaimer skip".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies".split())
CLOSES = {  # an opening tag that ends an open element of the same kind
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table tbody thead article main section div body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[a-z]+")


class Line:
    __slots__ = ("chars", "path", "region", "tags", "text")

    def __init__(self, path: tuple[int, ...], region: int):
        self.text: list[str] = []
        self.chars = 0
        self.tags = 0
        self.path = path  # the open block elements, by number
        self.region = region  # the article or main element around it, 0 for none


class Events(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool, int]] = []  # tag, number, dropped here, region
        self.number = 0
        self.dropped = 0  # open elements that are dropped
        self.region = 0
        self.articles: set[int] = set()
        self.line = Line((), 0)

    def end_line(self) -> None:
        if self.line.text:
            self.lines.append(self.line)
            self.line = Line(tuple(n for _, n, _, _ in self.open), self.region)
        else:
            tags = self.line.tags
            self.line = Line(tuple(n for _, n, _, _ in self.open), self.region)
            self.line.tags = tags

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return not (tag == "header" and self.region)
        if not attrs or tag in ("html", "body", "main"):
            return False
        names = COMMENT_NAMES if tag == "article" else NAMES
        for key, value in attrs:
            if key in ("class", "id"):
                if value and not names.isdisjoint(WORD.findall(value.lower())):
                    return tag not in INLINE
            elif key == "role":
                if value and value.lower() in ROLES:
                    return True
            elif key == "hidden" or (key == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag in VOID:
            if tag == "br" and self.line.text:
                self.line.text.append(" ")
            elif tag not in INLINE:
                self.end_line()
            return
        if tag in CLOSES:
            self.close_open(CLOSES[tag])
        drop = self.unwanted(tag, attrs)
        if tag in INLINE and not drop:
            return
        region = self.region
        self.number += 1
        if tag in ("article", "main") or ("role", "main") in attrs:
            if tag == "article":
                drop = drop or region in self.articles  # an article in an article is a comment on it
                if not drop:
                    self.articles.add(self.number)
            region = self.number
        self.end_line()
        self.open.append((tag, self.number, drop, self.region))
        self.dropped += drop
        self.region = region
        self.line.path = tuple(n for _, n, _, _ in self.open)
        self.line.region = region

    def close_open(self, tags: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.end_line()
                self.pop_to(k)
                return
            if self.open[k][0] in SCOPES:
                return

    def pop_to(self, k: int) -> None:
        for _, _, drop, region in reversed(self.open[k:]):
            self.dropped -= drop
            self.region = region
        del self.open[k:]
        self.line.path = tuple(n for _, n, _, _ in self.open)
        self.line.region = self.region

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in INLINE or tag in VOID:
            if not any(t == tag for t, _, _, _ in self.open):
                return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.end_line()
                self.pop_to(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.line.text.append(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the weights beyond an end fall on the values that are there."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8, around: float = 0.7) -> str:
    """Blocks of the content region, one per line.

    sigma: deviation of the Gaussian in lines. share: part of the deviation of the smoothed
    ratios that content lines reach. around: part of the content that the region holds where
    the page names no article."""
    if not html:
        return ""
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and re.match(r"<[a-zA-Z/!?]", html[last : last + 2]):
        html = html[:last]  # a tag that the page's end cuts off
    events = Events()
    events.feed(html)
    events.close()
    events.end_line()
    lines, texts = [], []
    for line in events.lines:
        text = " ".join("".join(line.text).split())
        if text:
            lines.append(line)
            texts.append(text)
    if not lines:
        return ""
    ratios = smoothed([len(t) / max(1, line.tags) for t, line in zip(texts, lines)], sigma)
    mean = sum(ratios) / len(ratios)
    bar = share * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    content = [k for k, r in enumerate(ratios) if r >= bar] or list(range(len(lines)))
    named = events.articles or {line.region for line in lines if line.region}
    inside = [k for k, line in enumerate(lines) if not named.isdisjoint(line.path)]
    if inside:
        held = {n for k in content for n in lines[k].path if n in named}
        chosen = [k for k in inside if held.isdisjoint(named) or not held.isdisjoint(lines[k].path)]
    else:
        total: dict[int, int] = {}
        for k in content:
            for n in lines[k].path:
                total[n] = total.get(n, 0) + len(texts[k])
        need = around * sum(len(texts[k]) for k in content)
        region = max((n for n, size in total.items() if size >= need), default=0)  # the last opened is the smallest
        chosen = [k for k, line in enumerate(lines) if not region or region in line.path]
    return "\n".join(texts[k] for k in chosen)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of the pages (default: all) and their main text. NULL and empty pages
    have an empty text; broken markup is read as far as it goes."""

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            return [pa.array([main_text(h) for h in columns[0].to_pylist()], pa.string())]

        return work

    return map_columns(pages, [html_col], [(name, T.StringType())], make, keep=keep)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    out = extract(pages.select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
