"""Near-duplicates by similarity of five-word shingles, against all pairs."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm import brute
from trackyard.llm import simhash

SF = "/root/testdata/sf0.001"


def expected(rows, size=5, similarity=0.8):
    """Least ids of the groups that pairs of at least this Jaccard similarity join."""
    sets = []
    for _, t in rows:
        w = brute.words(brute.fold(t).decode())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def made():
    r = random.Random(5)
    rows = []
    for k in range(40):
        w = ["w%d" % r.randrange(3000) for _ in range(r.choice((60, 120, 300)))]
        rows.append((len(rows), " ".join(w)))
        for edits in (1, 2, 4, 8):
            v = list(w)
            for at in r.sample(range(len(v)), edits):
                v[at] = "x%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(v)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(("", " ", "one two", "ONE two", "one two three"))]


@pytest.mark.parametrize("tile", [4000, 3])
def test_similar_texts_are_one(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LED", tile - 1)
    rows = made()
    df = brute.frame(spark, rows)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == expected(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_similar_documents_are_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == expected(rows)
