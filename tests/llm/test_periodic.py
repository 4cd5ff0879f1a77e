"""Periodic runs against a plain search of every lag."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trackyard.llm import periodic


def every_lag(words):
    """All runs of a list of words: lags in ascending order, a stretch counts for its smallest."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] == words[i - q]:
                a = i
                while i < n and words[i] == words[i - q]:
                    i += 1
                if i - a + q >= max(6, 4 * q):
                    seen.setdefault((a - q, i - a + q), q)
            else:
                i += 1
    return sorted((s, n, q) for (s, n), q in seen.items())


def described(words):
    runs = every_lag(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    head = (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    return (*head, "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in lost))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(1, 14)), max_size=5))
def test_runs(parts):
    words = [w for root, n in parts for w in root * n]
    assert periodic._described([b"a", " ".join(words).encode(), b"a a a a a a"])[1] == described(words)


def test_long_texts_are_not_square():
    for text, runs in ((b"a " * 300_000, 1), ((b"a " * 999 + b"b ") * 300, 301), (b"a b c " * 100_000, 1)):
        assert periodic._described([text])[0][0] == runs


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "x", "a a a a a a", "A a A a A a", "ü ü\nü\tü ü ü  ü", "a b " * 2000, " ".join(rng.choice("ab") for _ in range(3000)), "a a a a a a"]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "a a a a a a a", "x", "y"), (4, "a a a a a a", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string, n_runs string")
    found = periodic.with_runs(docs)
    assert found.columns == ["doc_id", "text", "n_runs", "periodic"]
    got = [(r.text, tuple(r.periodic)) for r in found.collect()]
    assert len(got) == len(rows)
    for text, row in got:
        assert row == described(periodic_words(text))
    assert periodic.with_runs(docs.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in periodic.collapse(docs).collect()}
    assert cut[5] == "A a A a A a" and cut[6] == "ü" and cut[0] is None and cut[2] == " \t\n"


def periodic_words(text):
    return [w.decode() for w in text.encode().split()] if text else []


def test_planted(spark):
    texts = [None, "", "one", "a b c d e f g h i j", "the words of a text that is somewhat longer than the others are " * 3]
    rows = [(k, texts[k % 5]) for k in range(300)] + [(None, texts[3])]
    found = periodic.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (k, text), r in zip(rows, found):
        words, h = periodic_words(text), zlib.crc32(str(k).encode())
        if k is None or h % 10 or not words:
            assert r.text == text
            continue
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        assert r.text.split() == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
