"""Work that must stay linear, bounds that must hold, and parts of pages that one word must not decide."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackyard.llm import decontaminate, htmltext, linededup, scratch, siteprior

P = "<p>A long enough paragraph, with commas, that is surely part of the article itself and %s.</p>"
T = "A long enough paragraph, with commas, that is surely part of the article itself and %s."


# --- pages


@pytest.mark.parametrize("word", ["discussion", "tools", "social", "remarks", "related"])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>", "<main><section>%s</section></main>"])
def test_one_word_of_a_topic_decides_nothing(word, around):
    page = around % (P % "first" + f"<div class='{word}'>" + P % "second" + P % "third" + "</div>")
    assert htmltext.extract(f"<body>{page}</body>") == "\n".join(T % x for x in ("first", "second", "third"))


@pytest.mark.parametrize("part", [
    "<div class=discussion><div class=avatar></div><p>I read it, all of it, and I like it a lot.</p></div>",
    "<div class=discussion><p>I read it, all of it, and I like it a lot.</p><div class=comment>So do I, and at length.</div></div>",
    "<div class=remarks><p>I read it, all of it, and I like it a lot.</p><textarea></textarea></div>",
    "<div class=social><a href=x>Share this page with all of your friends</a></div>",
    "<div class=tools><button>Print this article in a large type</button></div>",
    "<form><p>Subscribe to our newsletter, and get it each week.</p><input></form>",
])
def test_readers_and_controls_go(part):
    assert htmltext.extract("<body><div>" + P % "first" + P % "second" + "</div>" + part + "</body>") == T % "first" + "\n" + T % "second"


def test_a_form_around_the_page_is_a_wrapper():
    page = "<form id=aspnetForm action=/x><input type=hidden name=v><nav><a href=1>Home</a></nav><div class=wide><h1>Title</h1>%s<select><option>x</option></select><button>Go</button></div><footer>Foot</footer></form>"
    assert htmltext.extract("<body>" + page % (P % "first" + P % "second") + "</body>") == "Title\n" + T % "first" + "\n" + T % "second"
    assert htmltext.extract("<form><div><p>Short article of one line, no more.</p></div></form>") == "Short article of one line, no more."
    # A form in a form is none; deep ones take linear time.
    began = time.time()
    htmltext.extract("<form><div><p>x, y and z, at some length, in it." * 8000)
    assert time.time() - began < 4


def plain_best(parts):
    """Blocks of the container, of those given as lists of paragraphs, with the most points: one a paragraph, one a comma, and up to three for length."""
    points = lambda t: 1 + t.count(",") + min(len(t) // 100, 3) if len(t) >= 25 else 0
    return max(parts, key=lambda p: sum(map(points, p)))


@pytest.mark.parametrize("seed", range(12))
def test_choice_of_container(seed):
    """Pages without an article element: the container with the most points wins, whatever its place."""
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta"]) for _ in range(n)).rstrip(",") + "."
    long = [line(rng.randint(20, 60)) for _ in range(rng.randint(3, 7))]
    short = [[line(rng.randint(1, 3))] for _ in range(3)]
    parts = [long, *short]
    rng.shuffle(parts)
    html = "<body>" + "".join("<div><div>" + "".join(f"<p>{t}</p>" for t in p) + "</div></div>" for p in parts) + "</body>"
    assert htmltext.extract(html) == "\n".join(plain_best(parts))


# --- benchmark windows


def test_repeated_words_are_linear():
    text = b"same words " * 8000
    began = time.time()
    tables = decontaminate.WuManber([("a", text), ("b", text)])
    doc, found = decontaminate.words(text), set()
    hit = bytearray(len(doc))
    tables.search(doc, hit, found)
    assert time.time() - began < 1 and sum(hit) == 16000 and found == {"a", "b"}


@pytest.mark.parametrize(("block", "most"), [(1 << 20, 32), (60, 100), (60, 2)])
def test_blocks_and_passes(spark, block, most):
    """One block, many in one pass, and many passes give the same."""
    rng = random.Random(4)
    items = [(f"i{k % 9}", " ".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 5, 14, 20])))) for k in range(12)] + [(None, "a b"), ("n", None)]
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(50, None), (51, "c b a " * 3000)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.with_contamination(brute.frame(spark, rows), bench, block_bytes=block, pass_blocks=most)
    got = sorted((r.doc_id, *r.contamination) for r in found.collect())
    assert got == sorted(tuple(r) for r in brute.contamination(rows, items))


# --- lines


def test_many_shared_lines_are_linear(spark):
    text = "\n".join(f"a line that is shared, number {k}" for k in range(40_000))
    docs = spark.createDataFrame([(k, text + f"\nown {k}") for k in range(3)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.dedup for r in linededup.with_line_dedup(docs).collect()}
    assert time.time() - began < 30
    assert [(found[k].n_lines, found[k].n_dropped) for k in range(3)] == [(40_001, 40_000), (40_001, 40_000), (40_001, 0)]
    assert [found[k].kept for k in (0, 1)] == ["own 0", "own 1"] and found[2].kept == text + "\nown 2"


def test_hot_lines_meet_their_documents_where_they_are(spark, monkeypatch):
    rows = [(k, f"the line that all documents share\nown line of document {k % 7} for sure\nx") for k in range(60)] + [(None, "the line that all documents share"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cold = sorted(map(str, linededup.with_line_dedup(docs).collect()))
    monkeypatch.setattr(linededup, "HOT", 5)
    assert sorted(map(str, linededup.with_line_dedup(docs).collect())) == cold
    assert {r.dedup.n_dropped for r in linededup.with_line_dedup(docs).where("doc_id = 3 AND text IS NULL").collect()} == {0}


# --- labels


@pytest.mark.parametrize("same", [True, False])
def test_labelled_rows_are_bounded(spark, same):
    """One labelled id has most rows: equal ones are one, different ones count against the bound."""
    docs = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("good words here "), F.when(F.lit(not same), F.col("id")).otherwise(F.col("id") % 400).cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen, keep = [], scratch.save

    def save(df, tag):
        out = keep(df, tag)
        if tag == "quality-sample":
            seen.append(out.count())
        return out

    siteprior.scratch.save, before = save, scratch.save
    try:
        siteprior.fit(docs, labels, limit=100)
    finally:
        siteprior.scratch.save = before
    assert seen == [100]


# --- tables


def test_tables_of_another_thread_stay(spark):
    mine = scratch.mark()
    kept = []
    other = threading.Thread(target=lambda: kept.append(scratch.save(spark.range(5), "other")))
    scratch.save(spark.range(3), "own")
    other.start()
    other.join()
    scratch.drop_since(spark, mine)
    assert kept[0].count() == 5 and scratch.mark() == mine
