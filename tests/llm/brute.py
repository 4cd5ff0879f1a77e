"""Plain versions of the operators, straight from their contracts, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=True):
    """Documents from (doc_id, text), with the other columns of the table and one of a clashing name."""
    full = [(d, t, "en", "s%d" % (k % 3), None if t is None else len(t), 7) for k, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(full, DOCS + ", size int")
    return df if extra else df.drop("size")


def raw(text):
    return (text or "").encode()


def words(text):
    return WORD.findall(raw(text))


def fold(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text))


def bigram_scores(rows):
    """Discounted bigrams over smoothed unigrams: one discount a context."""
    tokens = [WORD.findall(fold(t)) + [b""] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for w, h in zip(tokens, held):
        if not h:
            one.update(w)
            two.update(zip([b""] + w[:-1], w))
    total, kinds = sum(one.values()), len(one)
    seen, once, twice = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        seen[a] += 1
        once[a] += c == 1
        twice[a] += c == 2
    taken = {x: (once[x] + 0.5) / (once[x] + 2 * twice[x] + 1) for x in seen}
    low = lambda x: (one[x] + 0.1) / (total + 0.1 * (kinds + 1))
    out = []
    for (d, _), w, h in zip(rows, tokens, held):
        score = 0.0
        for a, b in zip([b""] + w[:-1], w):
            p = low(b)
            if one[a]:
                p = ((two[a, b] - taken[a] if two[a, b] else 0) + taken[a] * seen[a] * low(b)) / one[a]
            score += math.log10(p)
        out.append((d, h, len(w), sum(one[x] > 0 for x in w), total, sum(math.log10(low(x)) for x in w), score))
    return out


def simhash(text):
    w = WORD.findall(fold(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, "%016x" % prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def rules(text):
    w = words(text)
    t = raw(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split(b"\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contamination(docs, items):
    windows = []
    for name, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        windows += [("" if name is None else str(name), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(name)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def line_dedup(rows):
    key = lambda x: fold(x.strip(" \t\n\x0b\f\r")).decode()
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    lost = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = raw(t)
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = raw(t)
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1])) + (int(gone[0]) if len(gone) else 0)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
