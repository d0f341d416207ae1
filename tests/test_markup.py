"""Elements of pages against a slow parser that builds the whole tree."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from storyspark.sources import files
from storyspark.sources.markup import VOID, elements

SELECTORS = ("main", "article", ".chapter", ".content", "#content", "body", "h1")


class Tree(HTMLParser):
    """Every element with its attributes and the pieces of text in it."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.open, self.all, self.mute = [], [], ""
        self.feed(html)
        self.close()

    def add(self, text):
        for e in self.open:
            e[2].append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute = tag
            return
        self.add(" ")
        e = (tag, dict(reversed(attrs)), [])
        self.all.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.add(" ")
        self.all.append((tag, dict(reversed(attrs)), []))

    def handle_endtag(self, tag):
        if tag == self.mute:
            self.mute = ""
            return
        at = [k for k, e in enumerate(self.open) if e[0] == tag]
        if at:
            self.open = self.open[: at[-1]]
        self.add(" ")

    def handle_comment(self, data):
        self.add(" ")

    def handle_data(self, data):
        if not self.mute:
            self.add(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def first(self, s):
        for tag, attrs, text in self.all:
            if s == tag or (s[0] == "." and s[1:] in (attrs.get("class") or "").split()) or (s[0] == "#" and s[1:] == attrs.get("id")):
                return "".join(text)
        return None


def test_random_pages():
    rng = random.Random(7)
    parts = ["<div>", "</div>", "<p>", "</p>", "<main>", "</main>", "<article class=x>", "</article>", "<DIV Class='a chapter'>", '<section class="content b">', "</section>", "<div id=content>", "<body>", "</body>"]
    parts += ["<br>", "<br/>", "<img alt='</div>'>", '<a title="a>b">', "</a>", "<!-- </main> -->", "<!-- x -->", "<script>var a = '</div><main>';</script>", "<style>p>a{}</style>", "<h1>", "</h1>", " text ", "more\n", "&amp;", "<p class='chapter' class='content'>"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        tree, got = Tree(html), elements(html, SELECTORS)
        assert got == {s: x for s in SELECTORS if (x := tree.first(s)) is not None}, html


def test_odd_markup():
    assert elements("<main>a < b and <b>c", ("main",)) == {"main": "a < b and  c"}
    assert elements("<main>a<!-- never closed </main>", ("main",)) == {"main": "a "}
    assert elements("<main>a<script>never closed </main>", ("main",)) == {"main": "a"}
    assert elements("no tags", ("main", "")) == {"": "no tags"}
    assert elements("", ("main", "")) == {"": ""}


def test_time_is_linear():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        for html in ("<div>" * n, "<a '" * n, "<" * n, "<p <p" * n, "<div>x</div>" * n):
            elements(html, SELECTORS)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_a_nested_advertisement_leaves_the_story(spark):
    story = "The story goes on for long enough to be kept. " * 4
    pages = [
        (1, f'<div class="chapter"><div class="ad">Buy</div><p>{story}</p></div><div>foot</div>'),
        (2, f"<h2>Two</h2><div id='content'>{story}<div>x</div></div>"),
        (3, f"<p>{story}</p>"),
        (4, None),
        (5, ""),
    ]
    got = {r.page_id: r for r in files.html_chapters(spark.createDataFrame(pages, "page_id long, html string").withColumn("title", F.lit("x"))).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].content.startswith("Buy") and got[1].content.endswith("to be kept.") and got[1].title is None
    assert got[2].title == "Two" and got[2].content.endswith("x")
