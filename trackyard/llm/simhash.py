"""Operator 3: near-duplicates by SimHash, with candidate keys from Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackyard.llm import scratch
from trackyard.llm.components import components

SEED = 42
#: Differing bits that still link two fingerprints.
NEAR = 3
#: The 64 bits in three segments, each no longer than a Golay word: (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0b101011100011
#: Rows of a key compared in one task; larger ones are dealt to tiles.
GROUP = 20_000
#: Min-hashes of a text in bands: of pairs at similarity 0.8 all but some 50 in a million have a band in common.
BANDS, ROWS = 25, 5
#: Texts of a chunk of a candidate group; a task compares at most two chunks.
TILE = 4000
#: Most bytes of texts of a chunk.
TILE_BYTES = 8 << 20
#: Texts of a group from which on it is cut in chunks all the same, up to four, so that no task has most of the work.
SPREAD = 500
#: Texts, and bytes of them, that are held against the first text of their group in one task.
LED, LED_BYTES = 200, 8 << 20


# --- fingerprints -----------------------------------------------------------------------------------------------


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, in order; of all words if there are fewer. No words: none."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - size + 1)


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; those of a single hash, 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; a bit is set if it is in over half of their XXH64. No words: 0."""
    return _majority(_shingles(_words(text), size))


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))


# --- Golay code -------------------------------------------------------------------------------------------------


class Golay:
    """Nearest codewords of the perfect code: every 23-bit word is within 3 bits of exactly one."""

    def __init__(self):
        def rest(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            return x

        self.by_byte = [np.array([rest(b << s) for b in range(1 << w)], np.int32) for s, w in ((0, 8), (8, 8), (16, 7))]
        bits = [1 << k for k in range(23)]
        errors = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]
        self.error = np.zeros(2048, np.int32)
        for e in errors:
            self.error[rest(e)] = e

    def decode(self, x: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each word."""
        syndrome = self.by_byte[0][x & 255] ^ self.by_byte[1][x >> 8 & 255] ^ self.by_byte[2][x >> 16]
        return (x ^ self.error[syndrome]) >> 11

    def nearby(self, x: np.ndarray, bits: int) -> np.ndarray:
        """(n, bits + 1): the index of each word, then of each word with one bit changed; repeats become -1.

        Words that differ in one bit hold each other's own index among these.
        """
        flips = np.concatenate(([0], 1 << np.arange(bits))).astype(np.int32)
        found = self.decode(x[:, None] ^ flips)
        ordered = np.argsort(found, axis=1, kind="stable")
        there = np.take_along_axis(found, ordered, 1)
        again = np.zeros(found.shape, bool)
        again[:, 1:] = there[:, 1:] == there[:, :-1]
        back = np.empty_like(again)
        np.put_along_axis(back, ordered, again, 1)
        found[back] = -1
        return found


def keys_of(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position in ``prints``, is_home) of each fingerprint's candidate keys.

    Three or fewer errors over three segments leave two segments with at most one error each. A key joins the codeword
    indices of two segments. At home a fingerprint has its own indices; it also looks under nearby indices: for the
    first two segments under all pairs, for the other two pairs under those with one own index. That meets every error pattern:
    a segment without error pairs with a segment of at most one, and one error in each is met in the first two.
    """
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int32) for s, n in SEGMENTS]
    near = [code.nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    out = []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = near[i], near[j]
        home = np.zeros((a.shape[1], b.shape[1]), bool)
        home[0, 0] = True
        used = np.ones_like(home)
        if tag:
            used[1:, 1:] = False
        ia, ib = np.nonzero(used)
        key = np.int64(tag) << 24 | a[:, ia].astype(np.int64) << 12 | b[:, ib]
        at, col = np.nonzero((a[:, ia] >= 0) & (b[:, ib] >= 0))
        out.append((key[at, col], at, home[ia, ib][col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for part in parts:
        prints = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(prints), 4096):
            own = prints[k : k + 4096]
            key, at, home = keys_of(own, code)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[at].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])


# --- links ------------------------------------------------------------------------------------------------------


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one key as all their links would: one at most for each fingerprint.

    Breadth first: a fingerprint is compared with those not reached yet, so a dense group costs little more than one pass.
    """
    left, a, b = prints, [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                near = np.bitwise_count(left ^ x) <= NEAR
                if near.any():
                    found, left = left[near], left[~near]
                    a.append(np.full(len(found), x, np.uint64))
                    b.append(found)
                    queue.append(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _small_groups(key: np.ndarray, prints: np.ndarray, home: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, by comparing rows at distance 1, 2, ... in order."""
    a, b = [], []
    for d in range(1, int(sizes.max(initial=1))):
        same = (key[d:] == key[:-d]) & (home[d:] | home[:-d])
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= NEAR]
        a.append(prints[i])
        b.append(prints[i + d])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(limit: int):
    """For rows (key, fp, home) in order of key: links (a, b), or the rows of larger groups as they came (a = fp, key set)."""

    def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        later = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), later], names=["a", "b", "key"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the last key so far
        over = None  # a key with too many rows, whose rows go on
        for part in _and_end(parts):
            if part is None:
                key = prints = home = None
                if not held:
                    continue
            else:
                key, prints, home = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                prints = prints.view(np.uint64)
                if over is not None:
                    n = int(np.searchsorted(key, over, "right"))
                    if n:
                        yield rows(prints[:n], prints[:n], key[:n])
                    key, prints, home = key[n:], prints[n:], home[n:]
                    if not len(key):
                        continue
                    over = None
            block = [x for x in (*held, (key, prints, home)) if x[0] is not None]
            k, p, h = (np.concatenate(x) for x in zip(*block, strict=True))
            held = []
            last = len(k) if part is None else int(np.searchsorted(k, k[-1], "left"))
            if len(k) - last > limit:
                over = k[-1]
                yield rows(p[last:], p[last:], k[last:])
            elif last < len(k):
                held = [(k[last:], p[last:], h[last:])]
            k, p, h = k[:last], p[:last], h[:last]
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.concatenate((first, [len(k)])))
            many = np.repeat((size > 1) & (size <= 64), size)
            yield rows(*_small_groups(k[many], p[many], h[many], size[(size > 1) & (size <= 64)]))
            for s, n in zip(first[size > 64], size[size > 64], strict=True):
                if n > limit:
                    yield rows(p[s : s + n], p[s : s + n], k[s : s + n])
                else:
                    yield rows(*forest(np.unique(p[s : s + n])))

    return run


def _and_end(parts: Iterator) -> Iterator:
    yield from parts
    yield None


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` that differ in at most three bits; enough of them to join what all would join.

    Rows (key, fp) are dealt by key and sorted; a task streams over its keys. Keys with over ``group`` rows pass through and are then
    dealt to tiles, pairs of chunks of the key's rows, so that no task compares or holds more than two chunks.
    """
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A fingerprint becomes some fifty rows: spread them before, as Spark would deal few small ones to few tasks.
    keyed = prints.select("fp").repartition(n, "fp").mapInArrow(_key_rows, "key long, fp long, home boolean")
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key")
    found = scratch.save(dealt.mapInArrow(_links(group), "a long, b long, key long"), "simhash-links")
    near = found.where("key IS NULL").select("a", "b")
    late = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp")).distinct()
    if late.isEmpty():
        return near
    sizes = late.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("chunks"))
    rows = late.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int"))
    tiles = rows.select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select("key", "fp", F.least("c", "o").alias("t1"), F.greatest("c", "o").alias("t2"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(frame["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return near.union(tiles.groupBy("key", "t1", "t2").applyInPandas(tile, "a long, b long"))


# --- the operator -----------------------------------------------------------------------------------------------


def with_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", extra: tuple = ()) -> DataFrame:
    """(id, fp, component_id, *extra) for each row: its fingerprint and the smallest id reachable over links of at most three bits.

    Equal fingerprints are one node, whatever the number of documents. Null texts and texts without words have fingerprint 0 and link
    like others. A null id is never the smallest; a component with null ids only has none. Repeated rows each have a row.
    """
    scratch.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.pandas_udf(_fingerprints, "long")(F.col(text).cast("binary")).alias("fp"), *extra)
    rows = scratch.save(rows, "simhash-rows")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = scratch.save(named.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), "simhash-roots")
    return rows.join(by_print, "fp", "left")


# --- similarity of shingles -------------------------------------------------------------------------------------


def _min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of ``BANDS * ROWS`` odd factors."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for k in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[k : k + 8192, None] * factors).min(axis=0), out=least)
    return least


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def _nodes(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((_node(_words(t)) for t in texts), np.uint64, len(texts)).view(np.int64))


def _keys(size: int):
    """Of each text a hash of its words, the fingerprint of its shingles, and a key for each band of its min-hashes."""

    def run(texts: pd.Series) -> pd.DataFrame:
        node, fp, keys = [], [], []
        for t in texts:
            words = _words(t)
            h = _shingles(words, size)
            bands = _min_hashes(h).reshape(BANDS, ROWS)
            node.append(_node(words))
            fp.append(_majority(h))
            keys.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)] if len(h) else [], np.uint64).view(np.int64))
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return pd.DataFrame({"node": signed(node), "fp": signed(fp), "keys": keys})

    return run


def similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the sets of hashes (each in order, without repeats) as all pairs of at least this Jaccard similarity would.

    Breadth first, as in :func:`forest`. Pairs whose min-hashes agree in a quarter less than that are not compared.
    """
    sizes = np.array([len(x) for x in sets])
    marks = np.array([_min_hashes(x) for x in sets]).reshape(len(sets), BANDS * ROWS)
    left, a, b = np.arange(len(sets)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            maybe = np.minimum(sizes[left], sizes[x]) >= similarity * np.maximum(sizes[left], sizes[x])
            maybe[maybe] = (marks[left[maybe]] == marks[x]).mean(axis=1) >= 0.75 * similarity
            near = np.zeros(len(left), bool)
            for k in np.flatnonzero(maybe):
                y = sets[left[k]]
                both = len(np.intersect1d(sets[x], y, assume_unique=True))
                near[k] = both >= similarity * (len(sets[x]) + len(y) - both) - 1e-9
            found, left = left[near].tolist(), left[~near]
            a += [x] * len(found)
            b += found
            queue += found
    return a, b


def _near(size: int, similarity: float):
    """Of a chunk of a group with the group's first text: whether the others are similar to that."""

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["node"] == frame["root"]
        own = np.unique(_shingles(_words(frame.loc[first, "text"].iloc[0]), size))
        others = frame[~first]
        out = []
        for text in others["text"]:
            x = np.unique(_shingles(_words(text), size))
            both = len(np.intersect1d(own, x, assume_unique=True))
            out.append((len(text), both >= similarity * (len(own) + len(x) - both) - 1e-9))
        return pd.DataFrame({"root": others["root"].to_numpy(), "node": others["node"].to_numpy(), "size": np.array([n for n, _ in out], np.int64), "near": np.array([y for _, y in out], bool)})

    return near


def with_similar(docs: DataFrame, id_col: str, text: str, size: int, similarity: float, extra: tuple = ()) -> DataFrame:
    """(id, root, *extra) for each row: rows with one root are joined by pairs of texts whose sets of ``size``-word shingles have at least this Jaccard similarity.

    Texts of equal words are one node. Candidates are nodes with Golay keys in common whose fingerprints differ in at most three bits, and nodes that share a band of min-hashes.
    What candidates join is a group. Its texts are held to the exact similarity with the group's first text; those that are not similar to it meet all texts of
    the group, in tiles of at most two chunks of :data:`TILE` texts or :data:`TILE_BYTES` bytes, or one longer text. So a group of copies costs as many comparisons as it has texts, and
    no pair of it is lost: two texts that are both similar to the first are joined by it.
    """
    scratch.bound_batches(docs.sparkSession)
    content = F.col(text).cast("binary")
    schema = "node long, fp long, keys array<long>"
    made = docs.select(F.col(id_col).alias("id"), F.pandas_udf(_keys(size), schema)(content).alias("k"), *extra)
    rows = scratch.save(made.select("id", "k.*", *[c for c in made.columns if c not in ("id", "k")]), "similar-rows")
    # Equal nodes have equal keys: the least of each is that of all.
    nodes = scratch.save(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys")), "similar-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = scratch.lookup(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "similar-bands")
    prints = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    near = links(prints)
    ends = [prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in "ab"]
    by_print = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = nodes.join(prints, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    by_band = keyed.join(shared, "key").select("a", F.col("node").alias("b"))
    group = scratch.save(components(by_print.union(equal).union(by_band).where("a <> b")), "similar-groups")
    wanted = scratch.lookup(group, "similar-wanted")
    texts = docs.select(F.pandas_udf(_nodes, "long")(content).alias("node"), content.alias("text")).join(wanted, "node")
    single = scratch.save(texts.groupBy("node", "root").agg(F.first("text").alias("text")), "similar-texts")

    # Each text against the first of its group, which is sent to each chunk: in a group of copies that settles nearly all.
    number = lambda n, size, of, most: F.greatest(F.lit(1), F.ceil(F.greatest(n / of, size / most)), F.least(F.lit(4), F.ceil(n / SPREAD))).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = scratch.lookup(single.groupBy("root").agg(number(F.count("*"), F.sum(F.octet_length("text")), LED, LED_BYTES).alias("parts")), "similar-parts")
    own = single.join(parts, "root")
    led = own.where("node <> root").select("root", "node", "text", dealt("parts").alias("t")).union(own.where("node = root").select("root", "node", "text", each("parts").alias("t")))
    led = led.groupBy("root", "t").applyInPandas(_near(size, similarity), "root long, node long, size long, near boolean")
    led = scratch.save(led, "similar-led")
    # The rest meets all texts of its group, in tiles of a chunk of the rest and a chunk of all.
    left, of_left = F.sum((~F.col("near")).cast("long")), F.sum(F.when(~F.col("near"), F.col("size")))
    chunks = led.groupBy("root").agg(number(F.count("*") + 1, F.sum("size"), TILE, TILE_BYTES).alias("chunks"), left.alias("left"), number(left, of_left, TILE, TILE_BYTES).alias("rest"))
    chunks = scratch.lookup(chunks.where("left > 0").select("root", "chunks", "rest"), "similar-chunks")
    far = led.where(~F.col("near")).select("root", "node")
    every = single.join(chunks, "root").select("root", "node", "text", each("rest").alias("t1"), dealt("chunks").alias("t2"))
    rest = single.join(far, ["root", "node"]).join(chunks, "root").select("root", "node", "text", dealt("rest").alias("t1"), each("chunks").alias("t2"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        a, b = similar([np.unique(_shingles(_words(t), size)) for t in frame["text"]], similarity)
        node = frame["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[a], "b": node[b]}, dtype=np.int64)

    found = every.union(rest).groupBy("root", "t1", "t2").applyInPandas(tile, "a long, b long")
    roots = components(found.union(led.where("near").select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return rows.drop("fp", "keys").join(scratch.lookup(roots, "similar-roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """One document of each component, the one of the smallest id (then of the smallest hash of its columns), with its own columns.

    Components are those of fingerprints (:func:`with_components`), or with ``similarity`` those of sets of ``size``-word shingles (:func:`with_similar`).

    A row is known by two 64-bit hashes of all its columns; of equal rows one stays. Texts are shuffled once: the choice among equal rows is made where the join has put them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    own = (first.alias("row"), second.alias("row2"))
    found = with_components(docs, id_col, text, own) if similarity is None else with_similar(docs, id_col, text, size, similarity, own)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"), F.col("row2"))
    kept = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias("__row"), F.col("best.row2").alias("__row2"))
    marked = docs.withColumns({"__own": first, "__own2": second})
    joined = marked.join(kept, (F.col("__own") == F.col("__row")) & (F.col("__own2") == F.col("__row2")))
    place = F.row_number().over(Window.partitionBy("__own", "__own2").orderBy(F.lit(1)))
    return joined.withColumn("__first", place).where("__first = 1").select(*columns)
