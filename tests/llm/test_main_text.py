import html as entities
import math
import re
import time

import numpy as np
import pytest

from notesift.llm import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to give you the best of all experiences, so accept them all now.</div>
<div class="ad">Buy now, the best offer that there has been for many years, only today and only here.</div>
<article><h1>The &amp; title</h1><p>First   paragraph&nbsp;with <b>bold</b> and <a href="x">a link</a>.<br><p>Second one,
over two lines.</p><p>Ok.</p><form><input><button>Send</button>Your mail</form><ul><li>one point</li><li>two point</li></ul>
<aside>Read also this other story about something else that is long enough to look like text.</aside>
<p>Last &lt;tag&gt; &#233;.</p></article>
<section id="comments"><h3>Comments</h3><p>I think that this is a very good article, and I will tell everyone about it.</p></section>
<div class="sidebar"><p>Some text in the side bar that is rather long, too, as it happens now and then.</p></div>
<footer>&copy; site</footer></body></html>"""
TEXT = "The & title\nFirst paragraph with bold and a link.\nSecond one, over two lines.\nOk.\none point\ntwo point\nLast <tag> é."


def test_article_without_its_surroundings():
    assert main_text.extract(PAGE) == TEXT


def test_region_without_article_element():
    plain = PAGE.replace("<article>", '<div id="story">').replace("</article>", "</div>")
    assert main_text.extract(plain) == TEXT


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x()</script>", "<nav>only a menu</nav>"])
def test_no_text(html):
    assert main_text.extract(html) == ""


def test_bare_text_and_broken_markup():
    assert main_text.extract("just text &amp; more") == "just text & more"
    assert main_text.extract("<div><p>one<p>two</b></div></div><p>three words here") == "one\ntwo\nthree words here"
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 10
    assert main_text.extract(deep) == "deep text"


def test_supplied_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = main_text.main_text(pages).collect()
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|article|div|ul|li|h2)[^>]*>", body)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.id: r.text for r in rows} == want


def test_nulls_and_clashing_columns(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((str(r.id), r.text) for r in main_text.main_text(pages).collect()) == [("1", TEXT), ("1", TEXT), ("None", "")]
    assert main_text.main_text(pages.limit(0)).collect() == []


LONG = "This is a paragraph of the story, and it goes on for a good while, as paragraphs of stories do, until it comes to its end at last."


def test_a_teaser_in_an_article_is_not_the_region():
    story = "".join(f"<p>{LONG} Part {k}.</p>" for k in range(6))
    html = f"<body><div class='x'><article><h3>Other news</h3><p>A short teaser.</p></article></div><div class='story'>{story}</div></body>"
    assert main_text.extract(html) == "\n".join(f"{LONG} Part {k}." for k in range(6))


def test_articles_side_by_side_are_one_region():
    html = "<body><nav><a href='/'>Home</a></nav><main>" + "".join(f"<article><h2>Number {k}</h2><p>{LONG}</p></article>" for k in range(3)) + "</main><footer>end</footer></body>"
    assert main_text.extract(html) == "\n".join(f"Number {k}\n{LONG}" for k in range(3))


def test_a_class_that_may_be_part_of_the_article_is_left_to_the_cluster():
    html = f"<article><div class='header'><a href='/a'>A</a></div><p>{LONG}</p><section id='discussion'><h2>What follows from it</h2><p>{LONG} And more.</p></section></article>"
    assert main_text.extract(html).endswith(f"{LONG}\nWhat follows from it\n{LONG} And more.")


def test_the_smoothed_ratio_decides(monkeypatch):
    """A lone long line in the link list at the side counts without smoothing, beside its neighbours it doesn't."""
    links = "".join(f"<tr><td><b><i><a href='{k}'>go</a></i></b></td></tr>" for k in range(8))
    lone = "<tr><td>" + "a long line that stands alone among the links " * 9 + "</td></tr>"
    story = "".join(f"<div><p>{LONG}</p></div>" for _ in range(2))
    html = f"<body><table>{links}{lone}{links}</table><div class='text'>{story}</div></body>"
    smooth = main_text.extract(html)
    monkeypatch.setattr(main_text, "smoothed", lambda ratios: ratios)
    assert main_text.extract(html) != smooth


def plain_cluster(html):
    """Lines above the deviation of the smoothed ratios, one window after the other."""
    parser = main_text.Lines()
    parser.feed(html)
    parser.close()
    ratio = [len(x[0]) / max(1, x[1]) for x in parser.lines]
    weight = [math.exp(-(k * k) / 2) for k in range(-2, 3)]
    smooth = []
    for k in range(len(ratio)):
        near = [ratio[min(max(k + d, 0), len(ratio) - 1)] for d in range(-2, 3)]
        smooth.append(sum(a * w for a, w in zip(near, weight, strict=True)) / sum(weight))
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return ratio, smooth, [x[0] for x, s in zip(parser.lines, smooth, strict=True) if s >= min(deviation, max(smooth))]


def test_ratios_against_a_plain_version():
    ratio, smooth, cluster = plain_cluster(PAGE)
    assert main_text.smoothed(np.array(ratio)).tolist() == pytest.approx(smooth)
    assert "First paragraph with bold and a link." in cluster and "Home" not in cluster


@pytest.mark.parametrize(
    "html",
    ["<b>" * 20_000 + "<p>x" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "<td>" * 20_000, "</p>" * 50_000, "<li>x" * 20_000, "<table>" + "<tr><td><div>" * 10_000, "<a href=x>" * 20_000 + "x<br>" * 20_000],
    ids=["inline", "stray", "cells", "ends", "items", "rows", "links"],
)
def test_time_follows_the_length(html):
    began = time.process_time()
    main_text.extract(html)
    assert time.process_time() - began < 6


PROSE = "Some sentence of the article that is long enough to count as prose, with a second clause. " * 4


@pytest.mark.parametrize(
    "name",
    ["related-work", "social-impact", "notice-of-award", "share-price", "rail-travel", "hidden-costs", "skip-logic", "copyright-law", "comment-on-method", "popular-culture", "trending-topics", "alert-levels", "navigation-systems", "plain"],
)
def test_sections_named_after_their_subject_stay(name):
    page = f"<html><body><article><h1>Title</h1><p>{PROSE}</p><section class='{name}'><p>Inside. {PROSE}</p></section><div id='{name}'><p>Also. {PROSE}</p></div></article></body></html>"
    got = main_text.extract(page)
    assert "Inside." in got and "Also." in got


@pytest.mark.parametrize("name", ["related", "nav-bar", "site-nav", "ad-slot", "cookie-notice", "share-buttons", "related-posts", "comments", "sidebar main", "x newsletter_box", "social-links", "skip-to-content"])
def test_marks_still_drop(name):
    page = f"<html><body><article><h1>Title</h1><p>{PROSE}</p><div class='{name}'><p>Inside. {PROSE}</p></div></article></body></html>"
    assert "Inside." not in main_text.extract(page)
