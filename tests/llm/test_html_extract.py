"""Blocks against the standard library's parser, pages of odd shapes and sizes, agreement on the pages of the test data."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from gatelens.llm import html_extract


class PlainText(HTMLParser):
    """All text outside of scripts, styles, templates, images and the head."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "svg", "head"):
            self.inside.append(tag)
        elif self.inside == []:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def random_page(rng):
    word = lambda: "".join(rng.choice("abcdeéß日𝄞") for _ in range(rng.randint(1, 7)))
    run = lambda: " ".join(word() for _ in range(rng.randint(1, 12))) + rng.choice([".", "", "\n", " &amp; co", " &lt;b&gt;", " &#233;", " 1 < 2 ", "&nbsp;x", " a&b"])
    attribute = lambda: rng.choice(["", " class=x", " id='a b'", ' data-x="1 > 0"', " title='<p>'", " hidden"])

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return run()
        if kind < 0.45:
            return rng.choice(["<!-- <p>gone</p> -->", "<script>if (a < b) x = '<p>';</script>", "<style>p > a {}</style>", "<noscript>off</noscript>", "<svg viewBox='0 0 1 1'><path d='M0'/></svg>", "<br>", "<img src=x alt='y'>", "<hr/>", "<template><p>t</p></template>"])
        tag = rng.choice("div p ul li h1 h2 section article aside nav a b i span em table tr td blockquote pre my-card figure".split())
        inner = "".join(node(depth - 1) for _ in range(rng.randint(0, 4)))
        return f"<{tag}{attribute()}>{inner}" + ("" if tag in ("p", "li", "tr", "td") and rng.random() < 0.3 else f"</{tag}>")

    body = "".join(node(4) for _ in range(rng.randint(1, 6)))
    return rng.choice(["", "<!DOCTYPE html><html>"]) + rng.choice(["", "<head><title>t</title><meta charset=utf-8></head>"]) + rng.choice(["<body>", ""]) + body + rng.choice(["</body></html>", ""])


def test_no_text_is_lost_or_added():
    rng = random.Random(14)
    for _ in range(1500):
        page = random_page(rng)
        plain = PlainText()
        plain.feed(page)
        plain.close()
        found = " ".join(text for _, text, _ in html_extract.blocks_of(page))
        assert "".join(found.split()) == "".join("".join(plain.out).split()), page


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<head><title>t</title><p>one</p>", ["one"]),
        ("<head><meta x><link y>text", ["text"]),
        ("<svg width=1/><p>one</p>two", ["one", "two"]),
        ("<svg-icon name=x><p>one</p></svg-icon>", ["one"]),
        ("<p>if a < b then c", ["if a < b then c"]),
        ("<noscript><p>one</p>two", ["one", "two"]),
        ("<template>one<p>two", ["one", "two"]),
        ("<p>x<scr", ["x"]),
        ("a &lt; b &amp;amp;", ["a < b &amp;"]),
        ("<p>one<!-- never closed <p>two", ["one"]),
        ("<p title='a > b'>one</p><p title=\"x>one\">two", ["one", "two"]),
        ("<p title='open>one</p><p>two</p>", ["one", "two"]),
    ],
)
def test_odd_shapes(page, texts):
    assert [t for _, t, _ in html_extract.blocks_of(page)] == texts


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "<p>" + "a < b " * 300_000, "<svg>" * 40_000 + "<p>x", "<head>" * 20_000 + "x", "<a href='" * 60_000, "<!--" * 200_000, "</p>" * 200_000, "<p title='" * 60_000 + "x", "&lt;" * 300_000, "<noscript>" * 2_000 + "x", "<ul>" + "<li><a href=x>word</a> more" * 60_000], ids=lambda p: p[:12])
def test_long_pages_in_bounded_time(page):
    extractor = html_extract.Extractor(*html_extract.train())
    start = time.perf_counter()
    extractor.text(page)
    assert time.perf_counter() - start < 20


def test_pages_of_the_test_data(spark):
    """Their articles are marked, so their structure labels the blocks; nothing of them is in the training pages."""
    extractor = html_extract.Extractor(*html_extract.train())
    right = total = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        blocks = html_extract.blocks_of(row.html)
        want = [any(p == "article" for p in path) for path, _, _ in blocks]
        right += sum(bool(a) == b for a, b in zip(extractor.labels(blocks), want))
        total += len(blocks)
    assert right >= 0.99 * total and total > 1000


def test_main_text_of_pages_without_any_known_name():
    article = "".join(f"<p>{html.escape(s)}</p>" for s in ["A first sentence of the story that goes on for a while & ends here.", "Then another one comes, with more to tell about what happened next.", "At last the story ends."])
    page = f"<body><div><ul><li><a href=/>Start</a></li><li><a href=/b>More</a></li></ul></div><div><h1>Title of it</h1>{article}</div><div><a href=/x>About</a> <a href=/y>Terms</a></div></body>"
    found = html_extract.Extractor(*html_extract.train()).text(page).split("\n")
    assert "At last the story ends." in found and "Start" not in found


@pytest.mark.parametrize("depth", [10, 64, 80, 5000])
def test_ancestors_count_at_any_depth(depth):
    page = "<body><div class=comments>" + "<div>" * depth + "<nav><b>x</b></nav></b></span>" + "</div>" * depth + "<p>inside</p></div><p>outside</p>"
    (deep, *_), (inside, *_), (outside, *_) = html_extract.blocks_of(page)
    assert {"tag:nav", "name:comments", "tag:div", "tag:body", "parent:nav"} <= set(html_extract.path_features(deep))
    assert inside == ("body", "div comments", "p") and outside == ("body", "p")
