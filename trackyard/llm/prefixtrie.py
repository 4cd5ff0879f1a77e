"""Operator 11: the trie of conversation prefixes, from union-find over common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackyard.llm import scratch
from trackyard.llm.mixing import words_in

#: Turns of a conversation in one row; a longer one has a row for each so many turns.
BLOCK = 1024
#: Bytes of sorted rows that a task works on.
PART_BYTES = 16 << 20
#: Bytes of conversation ids in one row, where those that end at a node are spread over tasks.
CHUNK = 64 << 10
#: Bytes of a turn's digest.
WIDE = 16

#: Kinds of rows that a task leaves: whole nodes, parts of nodes that other tasks may share, ids that end at such nodes.
NODE, SHARED, ENDS = 0, 1, 2
FOREST = (
    "kind int, part int, key string, up string, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "words long, next string, more_children long, more_leaves long, more_saved long, ends string, nth int"
)
FIELDS = [x.split()[0] for x in FOREST.split(", ")]


# --- sequences of turns -----------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, d, n) for each turn: its place in its conversation, a digest of role and text, the words of its text.

    Order is by turn, null first, then by digest. Turns are range-partitioned by conversation and order and numbered where they lie; a conversation that goes on in the next
    part is lifted by one row a part, so one that holds a third of all turns is no hot group.
    """
    spark = conversations.sparkSession
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.md5(F.concat(F.md5(filled(role)), F.md5(filled(text)))).alias("d"), words_in(F.col(text)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "c", "turn", "d").sortWithinPartitions("c", "turn", "d").withColumn("part", F.spark_partition_id()).select("part", "c", "d", "n")
    placed = scratch.save(ranged.mapInArrow(_numbered, "part int, c long, d string, n long, pos long"), "trie-turns")
    ends = placed.groupBy("part").agg(F.min("c").alias("first"), F.max("c").alias("last"), (F.max_by("pos", F.struct("c", "pos")) + 1).alias("rows"))
    run = Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = ends.withColumn("upto", F.sum("rows").over(run))
    by_part = Window.orderBy("part")  # a row for each part
    before = before.withColumn("lift", F.when(F.lag("last").over(by_part) == F.col("first"), F.lag("upto").over(by_part)))
    lifts = scratch.lookup(before.where("lift > 0").select(F.col("part").alias("p"), F.col("first").alias("f"), "lift"), "trie-lifts")
    joined = placed.join(lifts, (F.col("part") == F.col("p")) & (F.col("c") == F.col("f")), "left")
    return joined.select("c", (F.col("pos") + F.coalesce("lift", F.lit(0))).alias("pos"), "d", "n")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place among the rows of their conversation in this part."""
    last, count = None, 0
    for batch in batches:
        c = batch["c"].to_numpy(zero_copy_only=False)
        if not len(c):
            continue
        fresh = np.flatnonzero(np.concatenate(([c[0] != last], c[1:] != c[:-1])))
        pos = np.arange(len(c))
        head = fresh[0] if len(fresh) else len(c)
        starts = np.repeat(fresh, np.diff(np.append(fresh, len(c))))
        pos = np.concatenate((pos[:head] + count, pos[head:] - starts))
        last, count = c[-1], int(pos[-1]) + 1
        yield batch.append_column("pos", pa.array(pos, pa.int64()))


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(c, i, d, n) of the conversations that :func:`with_prefixes` describes: each begins with turns of the first one of its group.

    Conversation c takes the first h turns of c - c % ``group`` (as many as there are), then its own turns after its first h; h is the CRC-32 of c as text modulo ``most``.
    Each conversation also has a row with i = -1 and no turn.
    """
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("long")
    convs = turns.where("pos = 0").select("c", (F.col("c") - F.col("c") % group).alias("base"), h.alias("h"))
    heads = turns.where(F.col("pos") < most - 1).select(F.col("c").alias("base"), "pos", "d", "n")
    sizes = heads.groupBy("base").agg(F.count("*").alias("m"))
    shift = convs.join(sizes, "base", "left").select("c", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"))
    own = turns.join(shift, "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("i"), "d", "n")
    led = convs.join(heads, "base").where("pos < h").select("c", F.col("pos").alias("i"), "d", "n")
    return own.unionByName(led).unionByName(convs.select("c", F.lit(-1).cast("long").alias("i"), F.lit("").alias("d"), F.lit(0).cast("long").alias("n")))


def in_order(turns: DataFrame) -> DataFrame:
    """(c, i, d, n) of conversations as they are, with the row i = -1 of each."""
    none = turns.where("pos = 0").select("c", F.lit(-1).cast("long").alias("i"), F.lit("").alias("d"), F.lit(0).cast("long").alias("n"))
    return turns.select("c", F.col("pos").alias("i"), "d", "n").unionByName(none)


def blocks_of(sequences: DataFrame, block: int) -> DataFrame:
    """(c, block, seq, n): the digests and words of each ``block`` turns, in order."""
    dealt = sequences.withColumn("block", F.floor(F.greatest("i", F.lit(0)) / block).cast("int")).repartition("c", "block")
    packed = dealt.groupBy("c", "block").agg(F.sort_array(F.collect_list(F.struct("i", "d", "n"))).alias("t"))
    return packed.select("c", "block", F.unhex(F.array_join("t.d", "")).alias("seq"), F.transform(F.filter("t", lambda x: x["i"] >= 0), lambda x: x["n"]).alias("n"))


def named_blocks(blocks: DataFrame, last: int) -> DataFrame:
    """``blocks`` with ``root``, which names the turns before a block, and ``next``, the root of the block that follows (null: none)."""
    if not last:
        return blocks.withColumns({"root": F.lit(""), "next": F.lit(None).cast("string")})
    upto = Window.partitionBy("c").orderBy("block")
    before, through = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(Window.unboundedPreceding, 0)
    name = lambda w: F.concat_ws("-", *[F.hex(F.bit_xor(f"h{k}").over(w)) for k in (1, 2)])
    narrow = blocks.select("c", "block", *[F.xxhash64(F.lit(k), "block", "seq").alias(f"h{k}") for k in (1, 2)])
    names = narrow.select("c", "block", F.when(F.col("block") > 0, name(before)).otherwise(F.lit("")).alias("root"), F.when(F.lead("block").over(upto).isNotNull(), name(through)).alias("next"))
    return blocks.join(names, ["c", "block"])


# --- the forest of a part ---------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Digests that two sequences have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * WIDE : mid * WIDE] == b[low * WIDE : mid * WIDE] else (low, mid - 1)
    return low


class _Tree:
    """The subtree of neighbouring sequences ``first`` to ``last`` below its top node at ``depth``; sums are over whole children only."""

    __slots__ = ("c", "children", "depth", "end", "first", "last", "leaves", "n", "saved", "whole")

    def __init__(self, item: int, depth: int, c: int, n: int):
        self.first = self.last = self.end = item
        self.depth, self.c, self.n = depth, c, n
        self.children = self.leaves = self.saved = 0
        self.whole: list[list] = []  # rows of whole children, which wait for the id of their parent


class Forest:
    """Nodes of the sorted sequences of one part, by union-find over edges of neighbours in descending common length.

    Every edge joins two trees: each grows upwards to one turn below the common length, node by node, and becomes a child of the node at that length, which one of them may be already.
    Nodes with the part's first or last sequence below them may go on in other parts: they come as parts of nodes, contracted to what their whole children sum to.
    """

    def __init__(self, part: int, table: pa.Table):
        self.part = part
        ids, roots, seqs, nexts = (table[x].to_pylist() for x in ("c", "root", "seq", "next"))
        more = list(zip(*(table[x].to_pylist() for x in ("more_children", "more_leaves", "more_saved")), strict=True))
        lists = table["n"].combine_chunks()
        words, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # Equal sequences are one item; ids ascend within it.
        new = [k == 0 or seqs[k] != seqs[k - 1] or roots[k] != roots[k - 1] for k in range(len(ids))]
        at = [k for k, x in enumerate(new) if x]
        self.root, self.seq = [roots[k] for k in at], [seqs[k] for k in at]
        self.words = [words[starts[k] : starts[k + 1]] for k in at]
        self.ends: list[list[int]] = []
        self.next: list[str | None] = []
        self.more: list[tuple] = []
        self.trees: list[_Tree] = []
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            here = range(a, b)
            self.ends.append([ids[j] for j in here if nexts[j] is None])
            on = next((j for j in here if nexts[j] is not None), None)
            self.next.append(None if on is None else nexts[on])
            self.more.append((0, 0, 0) if on is None else tuple(x or 0 for x in more[on]))
            self.trees.append(_Tree(k, len(self.seq[k]) // WIDE, ids[a], b - a))
        self.over = list(range(len(at)))
        self.rows: list[list] = []
        self.keys: dict[tuple[int, int], str] = {}
        for k in {0, len(at) - 1} if at else ():
            chain = hashlib.md5(self.root[k].encode() + b"/")
            self.keys[k, 0] = chain.hexdigest()
            for d in range(len(self.seq[k]) // WIDE):
                chain.update(self.seq[k][d * WIDE : (d + 1) * WIDE])
                self.keys[k, d + 1] = chain.copy().hexdigest()

    def build(self) -> list[list]:
        n = len(self.seq)
        edges = [_common(self.seq[k], self.seq[k + 1]) if self.root[k] == self.root[k + 1] else -1 for k in range(n - 1)]
        for k in np.argsort(-np.array(edges, np.int64), kind="stable").tolist():
            if edges[k] < 0:
                break
            self._join(self._find(k), self._find(k + 1), edges[k])
        for k in range(n):
            if self._find(k) == k:
                self._done(self._grow(self.trees[k], 0))
        return self.rows

    def _find(self, k: int) -> int:
        while self.over[k] != k:
            self.over[k] = self.over[self.over[k]]
            k = self.over[k]
        return k

    def _join(self, a: int, b: int, depth: int) -> None:
        x, y = self._grow(self.trees[a], depth), self._grow(self.trees[b], depth)
        self.over[b] = a
        x.last, x.c, x.n = y.last, min(x.c, y.c), x.n + y.n
        x.children, x.leaves, x.saved = x.children + y.children, x.leaves + y.leaves, x.saved + y.saved
        x.whole += y.whole
        x.end = x.end if x.end is not None else y.end
        self.trees[b] = None

    def _grow(self, tree: _Tree, depth: int) -> _Tree:
        """The tree with its top at ``depth``: what was its top, and all nodes between, are done."""
        while tree.depth > depth:
            row = self._done(tree)
            tree.depth -= 1
            tree.end = None
            if row is None:
                tree.children = tree.leaves = tree.saved = 0
                tree.whole = []
            else:
                tree.children, tree.leaves, tree.saved, tree.whole = 1, row[FIELDS.index("n_leaves")], row[FIELDS.index("saved_tokens")], [row]
        return tree

    def _shared(self, tree: _Tree) -> int | None:
        """The part's first or last sequence if it is in the tree."""
        return 0 if tree.first == 0 else tree.last if tree.last == len(self.seq) - 1 else None

    def _done(self, tree: _Tree) -> list | None:
        """The row of a tree's top, if no other part can add to it; else a part of it, and None.

        A whole node at depth 0 or 1 has the name of its root as its key; a part of a node at depth 0 has it as ``next``.
        """
        edge, end = self._shared(tree), tree.end
        words = int(self.words[tree.first][tree.depth - 1]) if tree.depth else 0
        ids = self.ends[end] if end is not None else []
        more, on = (self.more[end], self.next[end]) if end is not None else ((0, 0, 0), None)
        if edge is None:
            children = tree.children + more[0]
            leaves = tree.leaves + more[1] + (0 if children else 1)
            saved = tree.saved + more[2] + (tree.n - 1) * words
            root = self.root[tree.first] if tree.depth <= 1 else None
            row = [NODE, self.part, root, None, tree.depth, tree.c, None, tree.n, children, leaves, saved, words, on, 0, 0, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0]
            for child in tree.whole:
                child[FIELDS.index("parent_conv_id")] = tree.c
            self.rows.append(row)
            return row
        key, up = self.keys[edge, tree.depth], self.keys[edge, tree.depth - 1] if tree.depth else None
        for child in tree.whole:
            child[FIELDS.index("up")] = key
        on = on if tree.depth else self.root[tree.first]
        self.rows.append([SHARED, self.part, key, up, tree.depth, tree.c, None, tree.n, tree.children, tree.leaves, tree.saved, words, on, *more, None, 0])
        text = ",".join(map(str, ids))
        for nth, k in enumerate(range(0, len(text), CHUNK)):
            self.rows.append([ENDS, self.part, key, None, tree.depth, *[None] * 11, text[k : k + CHUNK], nth])
        return None


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not sum(map(len, held)):
        return
    table = pa.Table.from_batches(held)
    rows = Forest(table["part"][0].as_py(), table).build()
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FOREST.split(", ")])
    for k in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)


# --- across parts -----------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, read in order: of a key only the running hash is held."""
    name, running, part = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([running.hexdigest()])], ["key", "ends"])

    for batch in batches:
        for key, p, text in zip(batch["key"].to_pylist(), batch["part"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if key != name:
                if name is not None:
                    yield row()
                name, running = key, hashlib.sha256()
            elif p != part:
                running.update(b",")
            part = p
            running.update(text.encode())
    if name is not None:
        yield row()


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtree of each shared node as far as its rows lie in one part: the deepest first, each added to the node above."""
    frame = frame.sort_values("depth", ascending=False)
    leaves, saved = dict(zip(frame["key"], frame["leaves"], strict=True)), dict(zip(frame["key"], frame["saved"], strict=True))
    for key, up in zip(frame["key"], frame["up"], strict=True):
        if up in leaves:
            leaves[up] += leaves[key]
            saved[up] += saved[key]
    return pd.DataFrame({"key": list(leaves), "leaves": list(leaves.values()), "saved": list(saved.values())})


def _merged(forests: DataFrame) -> DataFrame:
    """Nodes that parts share, each in one row, from their parts in all forests."""
    shared = forests.where(F.col("kind") == SHARED)
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    maxima = ("words", "next", "more_children", "more_leaves", "more_saved")
    nodes = shared.groupBy("key", "up", "depth").agg(F.min("part").alias("home"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    nodes = scratch.save(nodes, "trie-shared")
    below = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("shared_children"))
    children = F.col("n_children") + F.col("more_children") + F.coalesce("shared_children", F.lit(0))
    own_words = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.join(below, "key", "left").withColumn("n_children", children)
    nodes = nodes.withColumn("own_leaves", F.col("n_leaves") + F.col("more_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("own_saved", F.col("saved_tokens") + F.col("more_saved") + own_words)
    nodes = scratch.save(nodes.drop("n_leaves", "saved_tokens"), "trie-shared")
    at_home = lambda c: F.when(F.col("part") == F.col("home"), F.col(c)).otherwise(0)
    spines = shared.select("part", "key", "up", "depth").join(nodes.select("key", "home", "own_leaves", "own_saved"), "key").select("part", "key", "up", "depth", at_home("own_leaves").cast("long").alias("leaves"), at_home("own_saved").cast("long").alias("saved"))
    # A part has at most two shared paths, and a node adds its own numbers in one part alone.
    totals = spines.groupBy("part").applyInPandas(_summed, "key string, leaves long, saved long").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ids = forests.where(F.col("kind") == ENDS).select("key", "part", "nth", "ends").repartition("key").sortWithinPartitions("key", "part", "nth")
    ends = ids.mapInArrow(_digests, "key string, ends string")
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.when(F.col("depth") == 0, F.col("next")).alias("root"))
    found = nodes.join(totals, "key").join(ends, "key", "left").join(parents, "up", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return scratch.save(found.select("key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "next", "root", F.coalesce("ends", none).alias("ends")), "trie-shared")


def trie(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each distinct prefix of the sequences (c, i, d, n).

    Sequences are range-partitioned by their digests, then by id, so equal ones spread over parts too, and sorted in each. A part builds its forest by union-find over
    the common lengths of neighbours (:class:`Forest`). Nodes on the paths of its first and last sequence are contracted to partial sums and merged by key over all parts, all others are whole.
    Sequences of over ``block`` turns are cut in blocks; blocks with the same turns before them are one more trie, whose root is a node of the trie before. The last blocks come first,
    and a root's sums go on to that node. The driver sees the number of blocks and of bytes.

    The ids that end at one node are one SHA-256, a chain by its nature: parts join their ids to texts of ``CHUNK`` bytes, and one task reads those of a node in order, holding the running hash alone.
    """
    spark = sequences.sparkSession
    blocks = scratch.save(blocks_of(sequences, block), "trie-blocks")
    last, size = blocks.agg(F.max("block"), F.sum(F.octet_length("seq") + 8 * F.size("n") + 64)).first()
    last, parts = last or 0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))
    blocks = scratch.save(named_blocks(blocks, last), "trie-blocks") if last else named_blocks(blocks, last)
    columns = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "next", "root", "ends")
    more = ("more_children", "more_leaves", "more_saved")
    levels: list[DataFrame] = []
    for b in range(last, -1, -1):
        here = blocks.where(F.col("block") == b).drop("block")
        if levels:
            roots = levels[-1].where("depth = 0").select("next", *[F.col(c).alias(m) for c, m in zip(("n_children", "n_leaves", "saved_tokens"), more, strict=True)])
            here = here.join(scratch.lookup(roots, "trie-roots"), "next", "left")
        else:
            here = here.withColumns(dict.fromkeys(more, F.lit(None).cast("long")))
        here = scratch.save(here, "trie-blocks") if last else here
        ranged = here.repartitionByRange(parts, "root", "seq", "c").sortWithinPartitions("root", "seq", "c").withColumn("part", F.spark_partition_id())
        forests = scratch.save(ranged.mapInArrow(_forests, FOREST), "trie-forests")
        shared = _merged(forests)
        parents = scratch.lookup(shared.select(F.col("key").alias("up"), F.col("conv_id").alias("shared_parent")), "trie-parents")
        whole = forests.where(F.col("kind") == NODE).join(parents, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_parent"))
        whole = whole.withColumns({"next": F.when(F.col("depth") == 0, F.col("key")).otherwise(F.col("next")), "root": F.when(F.col("depth") == 1, F.col("key"))})
        levels.append(scratch.save(whole.select(*columns).unionByName(shared.select(*columns)), "trie-nodes"))
    levels.reverse()
    out = []
    for b, nodes in enumerate(levels):
        if b:
            # First turns of a block: their parent is a last turn of the block before.
            ends = levels[b - 1].where((F.col("depth") > 0) & F.col("next").isNotNull()).select(F.col("next").alias("root"), F.col("conv_id").alias("p"))
            nodes = nodes.where("depth > 0").join(scratch.lookup(ends, "trie-parents"), "root", "left").withColumn("parent_conv_id", F.coalesce("p", "parent_conv_id"))
        out.append(nodes.select("conv_id", (F.col("depth") + b * block).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")))
    found = out[0]
    for more_nodes in out[1:]:
        found = found.unionByName(more_nodes)
    return found


def with_prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shared: bool = True, block: int = BLOCK) -> DataFrame:
    """A row for each distinct prefix of the conversations (:func:`trie`); with ``shared`` of the conversations that :func:`rebuilt` makes of them.

    Null roles and texts are empty ones. Turns are in order, a null turn first; equal turn numbers are ordered by the MD5 of role and text. Repeated rows are turns of their own. Rows without a conversation id
    belong to none. A conversation without turns is a member of the root alone. An empty table has no root, and gives no rows. Other columns are not read.
    """
    turns = turns_of(conversations, conv, turn, role, text)
    return trie(rebuilt(turns) if shared else in_order(turns), block)
