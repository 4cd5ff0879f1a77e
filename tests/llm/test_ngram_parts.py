"""Scores of the n-gram model do not depend on how its contexts are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackyard.llm import ngramtrie

r = random.Random(3)
ROWS = [(k, " ".join(r.choice("a a a a the the b c d e f g h i j".split()) + r.choice(("", "", "x%d" % r.randrange(30))) for _ in range(r.randrange(1, 40)))) for k in range(60)]


@pytest.mark.parametrize(("batch", "shard"), [(4_000_000, 1_000_000), (200, 90), (150, 20)])
def test_one_discount_a_context(spark, monkeypatch, batch, shard):
    monkeypatch.setattr(ngramtrie, "SHARD", shard)
    monkeypatch.setattr(ngramtrie, "BATCH", batch)
    got = sorted(tuple(x) for x in ngramtrie.with_scores(brute.frame(spark, ROWS)).select("id", "n_tokens", "base_score", "score").collect())
    for a, b in zip(got, sorted(brute.bigram_scores(ROWS)), strict=True):
        assert a[:2] == (b[0], b[2]) and a[2] == pytest.approx(b[5], rel=1e-9) and abs(a[3] - b[6]) <= 1e-4 * b[2]


@pytest.mark.parametrize("kind", ["long", "string", "decimal(12,0)"])
def test_scores_do_not_depend_on_partitions(spark, monkeypatch, kind):
    monkeypatch.setattr(ngramtrie, "BATCH", 200)
    df = brute.frame(spark, ROWS).withColumn("doc_id", F.col("doc_id").cast(kind))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "64") if kind == "long" else ("4",):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((str(r[0]), r[1]) for r in ngramtrie.with_scores(df.repartition(3)).select("id", "score").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in got[1:]:
        assert [r[0] for r in other] == [r[0] for r in got[0]]
        assert [r[1] for r in other] == pytest.approx([r[1] for r in got[0]], rel=1e-4)
    assert len(got[0]) == len(ROWS)


@pytest.mark.parametrize(("frames", "frame"), [(3, 16), (7, 5), (1, 1 << 12)])
def test_several_shards_in_one_message(spark, monkeypatch, frames, frame):
    monkeypatch.setattr(ngramtrie, "SHARD", 20)
    monkeypatch.setattr(ngramtrie, "BATCH", 150)
    monkeypatch.setattr(ngramtrie, "FRAMES", frames)
    monkeypatch.setattr(ngramtrie, "FRAME", frame)
    got = sorted(tuple(x) for x in ngramtrie.with_scores(brute.frame(spark, ROWS)).select("id", "n_tokens", "base_score", "score").collect())
    for a, b in zip(got, sorted(brute.bigram_scores(ROWS)), strict=True):
        assert a[:2] == (b[0], b[2]) and a[2] == pytest.approx(b[5], rel=1e-9) and abs(a[3] - b[6]) <= 1e-4 * b[2]


def batch(tokens: int, words: int) -> tuple[bytes, np.ndarray]:
    """A batch of one text as :func:`ngramtrie._batches` keeps it, of words of which few are frequent, and its hashes."""
    rng = np.random.default_rng(5)
    joined = np.minimum((words * rng.random(tokens) ** 4).astype(np.int32), words - 1)
    joined[-1] = words
    hashes = np.sort(np.concatenate((rng.integers(0, 1 << 64, words, np.uint64), [np.uint64(ngramtrie.END)])))
    return ngramtrie.pack(hashes, joined, np.array([tokens], np.int32), np.zeros(1, np.uint8)), hashes


@pytest.mark.parametrize("shards", [1, 40, 9000])
def test_questions_and_what_shards_read(shards):
    data, hashes = batch(20_000, 3000)
    wide = {int(hashes[0]): min(shards, 7), int(hashes[5]): min(shards, 3)}
    pairs = ngramtrie._Pairs(data, shards, ngramtrie.frame_width(shards), wide)
    asked, sent = [], []
    for f in pairs.frames.tolist():
        own = pairs.of(f)
        sent += zip(pairs.shard[own].tolist(), pairs.hashes[pairs.context[own]].tolist(), (pairs.hashes[pairs.word[own]] >> np.uint64(24)).tolist(), pairs.count[own].tolist(), strict=True)
        for k, (contexts, sizes, words, counts) in enumerate(ngramtrie.by_shard(pairs.question(f))):
            asked += zip([f * pairs.width + k] * len(words), np.repeat(contexts, sizes).tolist(), words.tolist(), counts.tolist(), strict=True)
    assert asked == sent and len(sent) == len(pairs.count)


def test_messages_do_not_grow_with_shards():
    data, _ = batch(300_000, 40_000)
    sizes = []
    for shards in (26, 4740, 50_000):
        pairs = ngramtrie._Pairs(data, shards, ngramtrie.frame_width(shards), {})
        sizes.append(sum(len(pairs.question(f)) for f in pairs.frames.tolist()))
    assert max(sizes) <= 1.5 * min(sizes)
