"""The training-data operators against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import math
import random
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.llm import brute
from trackyard.llm import components, decontaminate, hostrules, htmltext, linededup, mixing, ngramtrie, oracles, queries, sharding, simhash, siteprior, suffixdedup

SF = "/root/testdata/sf0.001"


def odd_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "über", "ça", "a1", "x|y", "***", "Ω"] + [f"w{k}" for k in range(30)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))
    common = [line() + " a line that many documents share" for _ in range(4)]
    rows = []
    for k in range(n):
        lines = [rng.choice(common) if rng.random() < 0.3 else line() for _ in range(rng.randint(0, 9))]
        rows.append((k, "\n".join(lines)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n\r\f\x0b "), (n + 3, "one"), (n + 4, "One TWO"), (n + 5, "same words " * 4000), (None, rows[3][1]), (None, None), (7, rows[7][1]), (7, rows[7][1]), (n + 6, rows[9][1])]


ROWS = odd_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return brute.frame(spark, [])


# --- 1


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b &amp;amp; c&nbsp;d", "a\nb &amp; c d"), ("<ul><li><a href=x>menu</a></li></ul>", ""),
        ("<nav>n</nav><article><h1>T</h1><p><b>First, it is a long enough paragraph here.<br><p>Second\n one.</article><footer>f</footer>", "T\nFirst, it is a long enough paragraph here.\nSecond one."),
        ("<body><div class='sidebar'>Side, side, side, and some more words to be longer than all.</div><div id=content><p>Main text, with commas, and length enough to score.</p>tail <i>x</i></div><div class='comment-list'><p>I like this, I really do, and I write at length about it.</p></div></body>", "Main text, with commas, and length enough to score.\ntail x"),
        ("<article><p>Body text that is long enough, yes.</p><div class=ad>Buy</div><form>f<p>q</p></form><script>var a='<p>no</p>'</script><!-- c --></article>", "Body text that is long enough, yes."),
        ("<article><p>Cut off in the middle, of a tag, some", "Cut off in the middle, of a tag, some"),
        ("<div class=c><div><p>The first part, of two, in a page.</p><p>A.</p></div><div><p>The second part, of two, in a page.</p></div></div><ol class=commentlist><li>I read it, all of it, and I like it.</ol>", "The first part, of two, in a page.\nA.\nThe second part, of two, in a page."),
        ("<div class='wrap sidebar-left'><p>" + "All the text, of the page, is in here. " * 9 + "</p></div>", ("All the text, of the page, is in here. " * 9).strip()),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", "a\nb\nc\nx y"),
    ],
)
def test_html(html, text):
    assert htmltext.extract(html) == text


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, "<p>x</p>", None)], "page_id long, html string, text string")
    assert brute.ordered(htmltext.with_main_text(pages).select("page_id", "main_text", "text").collect()) == brute.ordered([(1, "", "u"), (1, "x", None)])
    assert htmltext.with_main_text(pages.limit(0)).count() == 0


def test_html_deep_nesting():
    assert htmltext.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


# --- 2


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 5), (1000, 1500), (1000, 10**9), (3000, 2**50)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.int64)
    values = np.unique(values)
    with tempfile.TemporaryFile() as file:
        e = ngramtrie.EliasFano(values, file)
        assert (e.get(np.arange(len(values))) == values).all()
        asked = np.concatenate((values, rng.integers(0, top, 300)))
        zero = np.zeros(len(asked), np.int64)
        found = e.find(asked, zero, zero + len(values))
        there = set(values.tolist())
        assert all((x >= 0) == (int(y) in there) and (x < 0 or values[x] == y) for x, y in zip(found, asked))


def test_quantise():
    p = 10.0 ** -np.linspace(0, 12, 1000)
    assert np.allclose(ngramtrie.restore(ngramtrie.quantise(p)), p, rtol=3e-4)


@pytest.mark.parametrize(("batch", "shard"), [(4_000_000, 1_000_000), (200, 90)])
def test_scores(spark, docs, monkeypatch, batch, shard):
    monkeypatch.setattr(ngramtrie, "SHARD", shard)
    monkeypatch.setattr(ngramtrie, "BATCH", batch)
    got = ngramtrie.with_scores(docs).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: (repr(tuple(r[:5])), round(r[5], 3), round(r[6], 2))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute.bigram_scores(ROWS), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 1e-4 * b[2]  # half a quantisation step a token


def test_scores_empty(empty):
    assert ngramtrie.with_scores(empty).count() == 0


# --- 3


def test_golay_is_perfect():
    code = simhash.Golay()
    found = np.bincount(code.decode(np.arange(1 << 23, dtype=np.int32)))
    assert found.min() == found.max() == 1 << 11


def test_keys_meet_for_all_near_pairs():
    code, rng = simhash.Golay(), np.random.default_rng(3)
    for f in rng.integers(0, 2**63, 150, dtype=np.uint64):
        g = f
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            g ^= np.uint64(1 << int(b))
        key, at, home = simhash.keys_of(np.array([f, g], np.uint64), code)
        assert set(key[(at == 0)]) & set(key[(at == 1) & home]) and set(key[(at == 1)]) & set(key[(at == 0) & home])


def test_near_dups(docs):
    got = [(r[0], "%016x" % (r[1] % (1 << 64)), r[2]) for r in simhash.with_components(docs).select("id", "fp", "component_id").collect()]
    want, roots = brute.near_components(ROWS)
    assert brute.ordered(got) == brute.ordered(want)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


@pytest.mark.parametrize("group", [20_000, 12, 5])
def test_links_in_tiles(spark, group):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = set()
    for _ in range(300):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = components.components(simhash.links(df, group))
    groups = collections.defaultdict(set)
    for r in found.collect():
        groups[r["root"]].add(r["node"])
    want = collections.defaultdict(set)
    for x in prints:
        want[find(x)].add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 50)] + [(7, 7), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 101 + 50 + 2 and all(got[k] == 0 for k in range(101)) and all(got[500 + k] == 500 for k in range(50)) and got[901] == 900


def test_near_dups_empty(empty):
    assert simhash.with_components(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# --- 4


def placed(df, shards=24):
    return [tuple(r) for r in sharding.assign(df, shards).select("__id", "__size", "__crc", "shard", "slot").collect()]


def test_shards_are_gapless_and_whole(docs):
    rows = placed(docs)
    assert collections.Counter(r[0] for r in rows) == collections.Counter(d for d, _ in ROWS)
    assert sum(r[1] for r in rows) == sum(len(brute.raw(t)) + 8 for _, t in ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r[3]].append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_shards_are_even_with_a_hot_group(spark):
    rng = random.Random(4)
    texts = [" ".join("w%d" % rng.randrange(9) for _ in range(rng.randint(5, 60))) for _ in range(2000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + k, "the one text of a third of all rows") for k in range(1000)]
    found = placed(brute.frame(spark, rows), 8)
    load, count = collections.Counter(), collections.Counter()
    for _, size, _, shard, _ in found:
        load[shard] += size
        count[shard] += 1
    assert max(load.values()) < 1.03 * min(load.values()) and max(count.values()) < 1.1 * min(count.values())


def test_pack_prefers_room():
    place = sharding.pack(np.array([[0.5, 0.1], [0.1, 0.5], [0.2, 0.2], [0.2, 0.2]]), 2)
    assert place[0] != place[1] or place[2] != place[0]


def test_shards_are_even_with_repeated_rows(spark):
    """A third of all rows are equal in id and text."""
    rng = random.Random(5)
    rows = [(k, " ".join("w%d" % rng.randrange(9) for _ in range(rng.randint(5, 60)))) for k in range(2000)] + [(5, "one text and one id, " * 9)] * 1000 + [(None, None)] * 20 + [(None, "")] * 20
    found = placed(brute.frame(spark, rows).repartition(5), 24)
    load, count, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for _, size, _, shard, slot in found:
        load[shard] += size
        count[shard] += 1
        slots[shard].append(slot)
    assert len(found) == len(rows) and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pack_is_the_rule(monkeypatch):
    """Each item goes where the dot product with the residual capacity is highest."""
    rng = np.random.default_rng(2)
    items = -np.sort(-rng.random((200, 3)), axis=0)
    items /= items.sum(axis=0)
    monkeypatch.setattr(sharding, "settle", lambda items, place, left: place)
    left, want = [[1 / 7] * 3 for _ in range(7)], []
    for x in items:
        dots = [sum(a * b for a, b in zip(x, own, strict=True)) for own in left]
        best = max(range(7), key=lambda k: (round(dots[k], 12), -k))
        want.append(best)
        left[best] = [b - a for a, b in zip(x, left[best], strict=True)]
    assert sharding.pack(items, 7).tolist() == want


def test_shards_empty(empty):
    assert placed(empty) == []


# --- 5


def test_features_read_whole_texts():
    assert b"last" in siteprior.features(b"x " * 50_000 + b"last") and siteprior.features(None)


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = siteprior.with_posteriors(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), F.col("id") == F.col("doc_id"))
    r = {(x["quality"], x["toxic"]): x for x in found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert r[1, 0]["kept"] > 0.99 and r[0, 0]["kept"] < 0.05 and r[1, 1]["kept"] < 0.4


def test_site_posteriors_shrink(spark):
    docs = brute.frame(spark, [(k, "good words in here " * 20 if k % 3 else "junk *** | | " * 20) for k in range(60)] + [(None, None)])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = siteprior.with_posteriors(docs, labels).collect()
    assert len(rows) == 61 and all(0 <= r["p_good"] <= 1 for r in rows)
    assert all(r["kept"] == bool(r["id"] % 3) for r in rows if r["id"] is not None)


def test_posteriors_are_the_formula(spark):
    """Strengths, posteriors and verdicts from the documents' own odds, level by level, in plain numbers."""
    rng = random.Random(8)
    good = lambda: " ".join("g%d" % rng.randrange(40) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["junk", "***", "b%d" % rng.randrange(40)]) for _ in range(30))
    rows = [(k, good() if rng.random() < (0.9, 0.5, 0.2)[k % 3] else bad(), rng.choice(["en", "de", None]), (["a", "b", None][k % 3] if k % 50 else "site%d" % k), 1, 0.5, True) for k in range(600)]
    rows += [rows[0]] * 5 + [(None, None, None, None, None, None, None), (5000, "", "en", "a", 0, 0.0, False), (5001, "g1 " * 60_000, "en", "b", 1, 0.0, False)]
    docs = spark.createDataFrame(rows, brute.DOCS + ", p_good double, kept boolean")
    labels = spark.createDataFrame([(r[0], int("g" in r[1]), 0) for r in rows[:300]] + [(1, 0, 0), (1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = siteprior.with_posteriors(docs, labels).collect()
    assert len(got) == len(rows)
    odds = lambda p: math.log(p) - math.log1p(-p)
    held = lambda p: max(1e-6, min(1 - 1e-6, p))

    def strength(groups):
        noise = sum(m * (1 - m) for m, _, _ in groups)
        between = (sum(n * (k / n - m) ** 2 for m, n, k in groups) - noise) / sum(n for _, n, _ in groups)
        return max(1.0, min(1000.0, noise / len(groups) / between - 1)) if between > 0 else 1000.0

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        hosts[r["host"]].append(r["p_doc"])
        paths[r["host"], r["path"]].append(r["p_doc"])
    mean = sum(r["p_doc"] for r in got) / len(got)
    s = strength([(mean, len(v), sum(v)) for v in hosts.values()])
    p_host = {h: (sum(v) + s * mean) / (len(v) + s) for h, v in hosts.items()}
    s = strength([(p_host[h], len(v), sum(v)) for (h, _), v in paths.items()])
    for r in got:
        v = paths[r["host"], r["path"]]
        path = held((sum(v) - r["p_doc"] + s * p_host[r["host"]]) / (len(v) - 1 + s))
        p = 1 / (1 + math.exp(-(odds(r["p_doc"]) + odds(path) - odds(held(mean)))))
        assert (r["p_host"], r["p_path"], r["p_good"]) == pytest.approx((p_host[r["host"]], path, p), rel=1e-6) and r["kept"] == (r["p_good"] >= 0.5)
    assert len({round(r["p_host"], 9) for r in got}) > 3


def test_posteriors_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in siteprior.with_posteriors(docs, labels).collect())
    assert siteprior.with_posteriors(empty, labels).count() == 0


# --- 6


def test_rules(docs):
    m = F.col("rules")
    got = hostrules.with_metrics(docs).select("doc_id", *[m[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]).collect()
    assert brute.ordered(got) == brute.ordered((d, *brute.rules(t)) for d, t in ROWS)


def test_bad_hosts_take_their_documents(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "short"
    rows = [(k, good if k % 5 else bad, "en", "fine", 1) for k in range(100)] + [(200 + k, good if k % 10 == 0 else bad, "en", "poor", 1) for k in range(100)] + [(400, good, "en", "one", 1), (401, good, "en", None, 1)]
    docs = spark.createDataFrame(rows, brute.DOCS).withColumn("host", F.lit("x"))
    kept = {r["doc_id"] for r in hostrules.keep_good(docs).collect()}
    assert kept == {k for k in range(100) if k % 5} | {400, 401}


def test_rules_empty(empty):
    assert hostrules.with_verdict(empty).count() == 0 and hostrules.keep_good(empty).columns == empty.columns


# --- 7

ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "short item"), (2, "short item"), (None, "w1 w2"), (3, None), (4, "..."), (5, "the"), (6, "w3 w3 w3")]


def test_contamination(spark, docs):
    rows = [*ROWS, (100, "x " + ITEMS[0][1].upper() + " y"), (101, "Alpha beta gamma"), (102, " ".join(ITEMS[0][1].split()[1:14])), (103, "a short, ITEM!" + " z" * 100)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    columns = ["doc_id", "contamination.n_words", "contamination.n_hit", "contamination.n_items", "contamination.items_sha256", "contamination.contaminated"]
    want = brute.ordered(brute.contamination(rows, ITEMS))
    for size in (1 << 20, 40):
        assert brute.ordered(decontaminate.with_contamination(brute.frame(spark, rows), items, block_bytes=size).select(columns).collect()) == want
    clean = decontaminate.decontaminate(brute.frame(spark, rows), items)
    assert clean.count() == sum(not r[-1] for r in want) and "size" in clean.columns


def test_contamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == len(ROWS)
    assert decontaminate.decontaminate(empty, none).count() == 0


# --- 8


def test_line_dedup(spark, docs):
    got = linededup.with_line_dedup(docs).select("doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2("dedup.kept", 256)).collect()
    assert brute.ordered(got) == brute.ordered(brute.line_dedup(ROWS))
    assert linededup.line_dedup(docs).columns == docs.columns


def test_line_dedup_empty(empty):
    assert linededup.with_line_dedup(empty).count() == 0


# --- 9


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, (3000, 19)).astype(np.uint8)
    data[rng.integers(0, 3000, 1500), :12] = 1
    words = suffixdedup.as_words(data)
    order = suffixdedup.multikey_quicksort(words, small=16)
    rows = [data[k].tobytes() for k in order]
    assert rows == sorted(data[k].tobytes() for k in range(3000))
    width = words.shape[1] * 8
    want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), width) for a, b in zip(rows, rows[1:], strict=False)]
    assert suffixdedup.common_prefix(words[order]).tolist() == want


@pytest.mark.parametrize(("length", "span", "hot"), [(400, 352, 256), (400, 256, 1), (40, 16, 3), (40, 25, 256), (40, 25, 0)])
def test_repeats(spark, monkeypatch, length, span, hot):
    for name, value in (("BLOCK", 1 << 12), ("TASK", 1 << 14), ("BUCKET", 300), ("ONCE", 50)):
        monkeypatch.setattr(suffixdedup, name, value)
    rng = random.Random(1)
    letters = "abcde é"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 200))) for _ in range(12)]
    rows = [(rng.choice([k, k, None]), "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 14)))) for k in range(100)]
    rows += [(1, None), (2, ""), (3, "a" * 3000), (4, "ab" * 900), (7, rows[7][1]), (7, rows[7][1]), (8, "a" * (length - 1)), (9, "xyz" * 15_000 + "q" * 700)]
    got = suffixdedup.with_repeats_removed(brute.frame(spark, rows), length=length, span=span, hot=hot).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256)).collect()
    assert brute.ordered(got) == brute.ordered(brute.repeats(rows, length))


def test_repeats_empty(empty):
    assert suffixdedup.with_repeats_removed(empty).count() == 0


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words that two documents share go from 400 bytes on, whole; shorter ones and documents without one stay. ``n_bytes`` is the input's size for all."""
    rng = random.Random(11)
    prose = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    long, short, rows = [prose(51 + k, 7) for k in range(10)], [prose(51, 6) for _ in range(10)], []
    assert min(len(x) for x in long) >= 400 > max(len(x) for x in short)
    for k in range(80):
        planted = f" {chr(65 + k)} {(long if k < 20 else short)[k // 2 % 10]} {chr(65 + k)} " if k < 40 else " "  # two documents each, never with the same bytes around it
        rows.append((k, prose(90, 6) + planted + prose(90, 6)))
    brute.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op9_suffix_array(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        # the two also share the space on either side
        gone = len(long[k // 2 % 10]) + 2 if k < 20 else 0
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["has_repeats"]) == (len(text), gone, int(k < 20), k < 20)


# --- 10


def test_targets_are_capped_and_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    caps, w = {"a": 30, "b": 3000, "c": 3000, None: 15, "d": 0}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want, free = {}, dict(w)
    while True:
        rest = 2015 - sum(want.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > caps[s]]
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            del free[s]
    want |= {s: (2015 - sum(v for k, v in want.items() if k not in free)) * x / sum(free.values()) for s, x in free.items()}
    assert t == pytest.approx(want)


def test_mix_meets_targets_and_repeats(spark, docs):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 60), "en", "s%d" % min(k % 7, 3), 1) for k in range(800)] + [(None, None, None, None, None), (5, "w w", "en", "s0", 1)]
    df = spark.createDataFrame(rows, brute.DOCS).withColumn("u", F.lit(1))
    found = mixing.with_mix(df, buckets=16)
    assert found.columns == [*df.columns, "mix"]
    got = found.select("doc_id", "source", "mix.*").collect()
    again = mixing.with_mix(df.repartition(5), buckets=16).select("doc_id", "source", "mix.*").collect()
    assert brute.ordered(got) == brute.ordered(again)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    assert all(abs(taken[s] - target[s]) <= 61 for s in target)
    assert mixing.mix(df, buckets=16).count() == sum(r["copies"] for r in got)
    assert mixing.with_mix(docs).count() == len(ROWS)


def test_mix_of_repeated_rows(spark):
    """Rows equal in id and text: as many go in as fit, and the SQL takes as many."""
    rng = random.Random(4)
    rows = [(7, "one two three four five", "en", "a", 1)] * 400 + [(k, "w " * rng.randint(1, 300), "en", "b", 1) for k in range(300)] + [(9, "x y", "en", "b", 1)] * 50 + [(k, "z " * 9, "en", None, 1) for k in range(30)]
    df = spark.createDataFrame(rows, brute.DOCS).repartition(7)
    for seed in ("mix", "b"):
        got = mixing.with_mix(df, seed=seed, buckets=8).select("doc_id", "source", "mix.*").collect()
        taken, target = collections.Counter(), {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= (301 if s == "b" else 10) for s in target), (taken, target)
        again = mixing.with_mix(df.coalesce(2), seed=seed, buckets=8).select("doc_id", "source", "mix.*").collect()
        assert brute.ordered(got) == brute.ordered(again)
    duck = duckdb.connect()
    duck.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source"), r, strict=False)) for r in rows]))
    got = mixing.with_mix(df, keep_text=False).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()
    assert oracle.rows_of(["a", "b", "c", "d", "e"], [tuple(r) for r in got]) == oracle.rows_of(["a", "b", "c", "d", "e"], duck.sql(oracles.OP10).fetchall())
    odds = collections.defaultdict(set)
    for r in mixing.with_mix(df).where("source = 'b'").select("mix.*").collect():
        odds[r["size"].bit_length()].add(r["copies"])
    assert len(set(map(frozenset, odds.values()))) > 1  # longer documents have other odds than short ones


def test_mix_empty(empty):
    assert mixing.with_mix(empty).count() == 0
