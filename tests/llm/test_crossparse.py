"""Cross-parsing against a plain search for the longest phrases, and its accuracy on documents it has not learned from."""

import random
import zlib

import pytest

from trackyard.llm import crossparse, queries

SF = "/root/testdata/sf0.01"


def plain_phrases(train, text):
    n = 0
    for k in range(0, len(text), crossparse.STRETCH):
        part, i = text[k : k + crossparse.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in train:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases():
    rng = random.Random(1)
    for _ in range(200):
        train = {x: bytes(rng.choice(b"abcd\n"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 60))) for x in "PQR"}
        texts = [bytes(rng.choice(b"abcdex") for _ in range(rng.choice([0, 1, 5, 50, 512, 513, 1300]))) for _ in range(5)]
        found = crossparse.Parser(train).phrases(texts)
        for k, x in enumerate("PQR"):
            assert [plain_phrases(train[x], t) for t in texts] == found[k].tolist()


def test_letters():
    assert crossparse.letters("Öl 3,50: x_Y\n") == "öl x y".encode()
    assert crossparse.letters(None) == crossparse.letters("") == crossparse.letters(" 12 ² _!") == b""


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_cross_parsing(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held) > 0
    again = queries.op13_cross_parsing(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_prediction_reads_text_alone(spark):
    """The same text has the same answer whatever its id, label and source."""
    docs = spark.createDataFrame([(k, "en" if k % 2 else None, "the cat and the dog are here", "s") for k in range(20)] + [(k, "de", "der hund und die katze sind hier", "t") for k in range(20, 40)], "doc_id long, lang string, text string, source string")
    found = crossparse.with_language(docs, crossparse.learn(docs.where(~crossparse.is_held_out("doc_id")))).collect()
    assert {(r.text, tuple(r.language)) for r in found} == {(t, (x, s)) for t, x, s in {(r.text, r.language.lang, r.language.score) for r in found}}
    assert {r.language.lang for r in found if r.text.startswith("the")} == {"en"} and {r.language.lang for r in found if r.text.startswith("der")} == {"de"}


def test_odd_rows(spark):
    rows = [(1, "en", None, 1), (2, "en", "", 1), (3, None, " 12 !", 1), (None, "de", "wort", 1), (5, "en", "the word " * 50_000, 1), (6, "x", "a", 1), (6, "x", "a", 1), (7, "z", "ζζ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, language int")
    texts = crossparse.learn(docs)
    assert set(texts) == {"en", "de", "x", "z"} and len(texts["en"]) <= crossparse.EACH
    found = crossparse.with_language(docs, texts)
    assert found.columns == ["doc_id", "lang", "text", "language"]
    got = {r.doc_id: r.language for r in found.collect()}
    assert [tuple(got[k]) for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[5].lang == "en" and got[7].lang == "z" and got[None].lang == "de"
    assert crossparse.learn(docs.limit(0)) == {} and crossparse.learn(docs.where("lang IS NULL")) == {}
    assert {tuple(r.language) for r in crossparse.with_language(docs, {}).collect()} == {("und", 0.0)}
    assert {r.language.score for r in crossparse.with_language(docs.where("doc_id = 5"), {"en": b"the word"}).collect()} == {1.0}
    assert crossparse.with_language(docs.limit(0), texts).count() == 0


@pytest.mark.parametrize("n", [1, 300])
def test_many_languages_share_the_bound(spark, monkeypatch, n):
    monkeypatch.setattr(crossparse, "ALL", 64 << 10)
    docs = spark.createDataFrame([(k, f"l{k % n}", f"{chr(97 + k % 26) * 3} word " * 400) for k in range(600)], "doc_id long, lang string, text string")
    texts = crossparse.learn(docs)
    assert len(texts) == min(n, crossparse.LANGUAGES) and sum(map(len, texts.values())) <= max(64, len(texts)) * (1025)
