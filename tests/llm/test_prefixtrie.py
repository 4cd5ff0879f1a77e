"""The prefix trie against a plain one in dictionaries, with one block and with many, and over parts of any size."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from trackyard.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def ordered(rows):
    """Turns (role, text) by conversation."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, md5(md5(role or "") + md5(text or "")), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in found.items()}


def shared(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    return out


def plain(convs):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) of each prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(p, [])]
        own = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        sums[p] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    rows = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        rows.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n, longest=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        text = [rng.choice(["a", "b c", "d e f", None, ""]) if rng.random() < 0.8 else f"own {rng.randint(0, 5)}" for _ in range(min(longest, rng.choice([1, 2, 3, 5, 9])))]
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), t) for k, t in enumerate(text)]
    rows += [(401, k, "user", "a") for k in range(longest)] + [(402, k, "user", "a") for k in range(longest - 2)] + [(403, 0, None, ""), (403, 0, None, "")]
    rows += [(500 + c, k, "user", "a b") for c in range(80) for k in range(min(longest, 7))]  # a conversation that is repeated very often
    return rows + rows[:5] + [(None, 0, "user", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "block", "share"), [(1, 1024, True), (2, 2, True), (3, 3, False)])
def test_trie(spark, seed, block, share):
    rows = made(seed, 60, min(60, 2 * block + 1))
    convs = ordered(rows)
    assert found(prefixtrie.with_prefixes(frame(spark, rows).repartition(7), shared=share, block=block)) == plain(shared(convs) if share else convs)


def test_parts_of_one_row(spark, monkeypatch):
    """Every part holds few sequences, so almost all nodes are shared by parts."""
    monkeypatch.setattr(prefixtrie, "PART_BYTES", 400)
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    rows = made(5, 30)
    assert found(prefixtrie.with_prefixes(frame(spark, rows))) == plain(shared(ordered(rows)))


def test_forest_of_one_part():
    """One part alone: the paths of its first and last sequence are shared, all other nodes whole."""
    digest = {x: hashlib.md5(x.encode()).digest() for x in "abc"}
    seqs = sorted(["a", "ab", "abc", "abb", "b", "bc", "c"], key=lambda s: b"".join(digest[x] for x in s))
    table = pa.table({
        "c": list(range(7)), "root": [""] * 7, "next": pa.array([None] * 7, pa.string()), "seq": [b"".join(digest[x] for x in s) for s in seqs], "n": pa.array([[1] * len(s) for s in seqs], pa.list_(pa.int64())),
        **{k: pa.array([None] * 7, pa.int64()) for k in ("more_children", "more_leaves", "more_saved")},
    })
    rows = [dict(zip(prefixtrie.FIELDS, r, strict=True)) for r in prefixtrie.Forest(0, table).build()]
    edge = {s[:d] for s in (seqs[0], seqs[-1]) for d in range(len(s) + 1)}
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert sum(r["kind"] == prefixtrie.NODE for r in rows) == len(prefixes - edge)
    assert len({r["key"] for r in rows if r["kind"] == prefixtrie.SHARED}) == len(edge)


def test_empty_and_turnless(spark):
    assert found(prefixtrie.with_prefixes(frame(spark, []))) == []
    # A conversation whose own turns all give way to a base that is not there has none.
    short = next(c for c in range(1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "a")]
    assert found(prefixtrie.with_prefixes(frame(spark, rows))) == plain({short: []}) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_long_conversation_spans_parts(spark):
    """Turns of one conversation are numbered over several parts."""
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(2, k, "user", f"t{k}") for k in range(5)]
    turns = prefixtrie.turns_of(frame(spark, rows).repartition(5))
    got = sorted((r.c, r.pos) for r in turns.collect())
    assert got == [(1, k) for k in range(3000)] + [(2, k) for k in range(5)]
