"""The corpus pipeline, stage by stage against plain versions, and the queries that SQL can express."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_similar import expected
from tests.oracle import connect, same
from trackyard.llm import queries, scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF).sql(queries.ORACLE_SQL[name]))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    good = scratch.save(stages["quality_rules"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    assert sorted(r[0] for r in rows(good)) == sorted(d for d, t in rows(docs) if not brute.rules(t)[-1])  # no host is rejected here

    single = scratch.save(stages["simhash_near_dedup"](spark, good, SF), "t")
    assert sorted(r[0] for r in rows(single)) == expected(rows(good)) and single.columns == docs.columns

    clean = scratch.save(stages["decontamination"](spark, single, SF), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(rows(single), items) if r[-1]}
    assert sorted(r[0] for r in rows(clean)) == sorted(d for d, _ in rows(single) if d not in bad) and clean.columns == docs.columns

    mixed = scratch.save(stages["mixing"](spark, clean, SF), "t")
    assert mixed.columns == docs.columns
    times = collections.Counter(r[0] for r in rows(mixed))
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in rows(clean)}
    size = {r[0]: len(brute.words(r[1])) for r in rows(clean)}
    assert abs(sum(n * size[d] for d, n in times.items()) - sum(size.values())) <= 20 * max(size.values())

    shards = stages["sharding"](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in shards) == times
    slots = collections.defaultdict(list)
    for r in shards:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_through_all_stages(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names."""
    r = random.Random(2)
    text = lambda n: " ".join("w%d" % r.randrange(5000) for _ in range(n))
    long, same = text(40_000), text(80)
    rows = [(k, text(60), "en", "s%d" % (k % 3), 1) for k in range(40)] + [(50, None, None, None, None), (51, "", "en", "s0", 0), (None, text(70), None, None, None), (52, long, "en", "s1", 1), (None, None, None, None, None)]
    rows += [(60 + k, same, "en", "s2", 1) for k in range(5)] + [rows[3]] * 4 + [(70, "one two three", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    docs = docs.withColumns({c: F.lit(c) for c in ("size", "mix", "rules", "contamination", "shard", "slot", "u", "id", "h", "q", "bits", "tie")})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch.save(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
    ids = {x["doc_id"] for x in kept.collect()}
    assert ids >= {None, 52, 60, 3} and not ids & {50, 51, 61, 64, 70}
    assert kept.where("doc_id = 52").first()["text"] == long
    placed = corpus_pipeline.apply(spark, docs, SF)
    assert placed.count() == kept.count() and {x["doc_id"] for x in placed.collect()} == ids


def test_empty_table_through_all_stages(spark):
    assert corpus_pipeline.apply(spark, brute.frame(spark, []), SF).count() == 0
