"""Words in attributes that name a part of an article, and those that mark what is none."""

import re
import time

import pytest
from pyspark.sql import functions as F

from trackyard.llm import htmltext

P = "<p>A long enough paragraph, with commas, that is surely part of the article itself and %s.</p>"
SIDE = "<div class='sidebar'><p>%s</p></div>" % ("Other things to read, to buy, and to follow on this site. " * 8)


@pytest.mark.parametrize("block", [
    "<section id='discussion'><h2>Discussion</h2>%s</section>",
    "<div><h2 id='related-work'>Discussion</h2>%s</div>",
    "<div id='tools-and-methods'><h2>Discussion</h2>%s</div>",
    "<div><h2 id='social-history'>Discussion</h2>%s</div>",
    "<div class='post commentary'><h2>Discussion</h2>%s</div>",
    "<div class='post comments-open'><h1>Discussion</h1>%s</div>",
])
def test_parts_with_slugs_stay(block):
    text = htmltext.extract("<body><div>" + P % "first" + block % (P % "second" + P % "third") + "</div></body>")
    assert "Discussion" in text and "second" in text and "third" in text


@pytest.mark.parametrize("side", [SIDE, SIDE.replace("class='sidebar'", "id='cookie-notice'"), SIDE.replace("sidebar", "advert")])
def test_short_article_beside_long_sidebar(side):
    text = htmltext.extract("<body><div><h1>Title</h1><p>A short article of one line, no more.</p></div>" + side + "</body>")
    assert "one line" in text and "Other things" not in text


def test_wrappers_stay_and_comments_go():
    page = "<div class='sidebar-layout'><h1>Title</h1>" + P % "first" + P % "second" + P % "third" + "</div><div id='comments'>" + P % "mine" + "</div>"
    text = htmltext.extract("<body>" + page + "<div>All rights reserved by the owner of it.</div></body>")
    assert "first" in text and "mine" not in text


def test_compound_names_are_no_marks():
    text = htmltext.extract("<article><h1>Markets</h1>" + P % "first" + "<div class='share-price'><p>Share prices fell, and then they rose, all day long.</p></div><div class='share-strange'><a href=x>Share</a></div><div class='social-links'>" + P % "follow" + "</div></article>")
    assert "Share prices fell" in text and "first" in text and "Share\n" not in text + "\n" and "follow" not in text


def test_lists_of_sources_stay_and_menus_go():
    sources = "<ol><li><a href=1>A long title of a book, by its author, 1999</a></li><li><a href=2>Another long title of a paper, by two authors</a></li></ol>"
    text = htmltext.extract("<article><h1>T</h1>" + P % "first" + sources + "<ul><li><a href=3>Home</a><li><a href=4>News</a></ul></article>")
    assert "by its author" in text and "by two authors" in text and "Home" not in text


def test_headings_of_an_article_header_stay():
    text = htmltext.extract("<header><h1>Site</h1></header><article><header><h1>The Title</h1><p>By me, on a day, at a desk in town.</p></header>" + P % "first" + "</article>")
    assert text.startswith("The Title\n") and "By me" not in text and "Site" not in text


@pytest.mark.parametrize("part", ["<b><p>x, y", "<div class=ad>x", "<div class=share-price><p>some words, and more of them.", "<li><b>x", "</i><b>x", "<h1><div class=ad>", "<header><article>x", "<div class=comments><h1>x"])
def test_deep_pages_take_linear_time(part):
    began = time.time()
    htmltext.extract(part * 8000)
    assert time.time() - began < 3


def plain(html):
    """A second, simple reading of pages of one known shape: what the article's own blocks hold, tags taken out one by one."""
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    article = re.sub(r"<(script|form|aside)\b.*?</\1>|<!--.*?-->", "", article, flags=re.S)
    parts = re.split(r"</?(?:p|h1|h2|ul|li)\b[^>]*>", article)
    for a, b in (("&lt;", "<"), ("&eacute;", "é"), ("&nbsp;", "\xa0"), ("&#33;", "!"), ("&amp;", "&")):
        parts = [re.sub(r"<[^<>]*>", "", x).replace("<br>", " ") if a == "&lt;" else x for x in parts]
        parts = [x.replace(a, b) for x in parts]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_pages_against_a_plain_reading(spark):
    import random

    rng = random.Random(6)
    words = ["word", "caf&eacute;", "a&nbsp;b", "5 &lt; 6", "<i>it</i>", "R&amp;D", "wow&#33;", "and,"]
    block = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) + " as it was said, in the end, by all of them"
    rows = []
    for k in range(60):
        inner = "".join(rng.choice(["<p>%s</p>", "<p>%s", "<h2>%s</h2>", "<ul><li>%s</li></ul>"]) % block() + rng.choice(["", "<aside>no %s</aside>" % block(), "<form>f</form>", "<!-- c -->", "<script>x='<p>no'</script>"]) for _ in range(rng.randint(2, 9)))
        rows.append((k, f"<html><body><nav><ul><li><a href=x>menu {k}</a></li></ul></nav><div class=sidebar><p>{block()}</p></div><article><h1>Title {k}</h1>{inner}</article><footer>{block()}</footer></body></html>", "clash"))
    rows.append((60, "<article><h1>Long</h1>" + ("<p>" + block() + "</p>") * 5000 + "</article>", None))
    rows += rows[:2]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    found = htmltext.with_main_text(df)
    assert found.columns == ["page_id", "html", "main_text"]
    got = sorted((r[0], r[1]) for r in found.select("page_id", "main_text").collect())
    assert got == sorted((k, plain(h)) for k, h, _ in rows)
    assert htmltext.with_main_text(df.where(F.lit(False))).count() == 0
