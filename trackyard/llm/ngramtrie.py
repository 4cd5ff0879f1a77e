"""Operator 2: texts scored by a bigram model kept in Elias-Fano tries."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackyard.llm import scratch

#: Tokens of a batch of documents, and of a shard of the model.
BATCH, SHARD = 2_000_000, 1_000_000
#: Most frequent words that a batch reports, to find the contexts that are too large for one shard.
HEADS = 1 << 14
#: Most contexts that are dealt by word, and most tasks that shards are dealt to.
WIDE, TASKS = 1 << 16, 20_000
#: Messages of a batch, from which on one holds the questions to several shards, and most shards of one message.
FRAMES, FRAME = 1 << 12, 16
#: Bytes of a word's hash that tell it from the other words after one context.
SHORT = 5
#: What a text ends with; no word is empty.
END = xxhash.xxh64_intdigest(b"", 42)
#: Steps of a quantised log10: 1 / 5000 each, down to 10 to the -13.1.
STEPS, LOWEST = 5000, 65_534


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities above 0; 0 is kept for none."""
    return (1 + np.clip(np.rint(-np.log10(p) * STEPS), 0, LOWEST)).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** (-(code.astype(np.float64) - 1) / STEPS))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string of bytes."""
    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join((head, b"".join(a.tobytes() for a in arrays))))


def unpack(data: bytes) -> list[np.ndarray]:
    head, _, body = zstandard.ZstdDecompressor().decompress(data).partition(b"\n")
    out, at = [], 0
    for item in head.decode().split(";"):
        kind, n = item.split(",")
        dtype = np.dtype(kind)
        out.append(np.frombuffer(body, dtype, int(n), at))
        at += int(n) * dtype.itemsize
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold the largest."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of numbers, those of one place after each other: they are alike and pack well."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").ravel()


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers that rise in stretches, which begin at ``first``: what each adds to the one before, and the first ones as they are."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def from_steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What :func:`steps` was made of, given the sizes of the stretches; sums wrap at 64 bits, and so do their differences."""
    sums = np.cumsum(values, dtype=np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), sums))[np.cumsum(sizes) - sizes]
    return sums - np.repeat(before, sizes)


# --- the trie ---------------------------------------------------------------------------------------------------


class EliasFano:
    """A sequence of numbers that does not fall: low bits as they are, high parts as a bit string in unary.

    Parts are written to ``file`` and mapped, so that the system can page them.
    """

    def __init__(self, values: np.ndarray, file):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = (values & np.int64((1 << self.bits) - 1)).astype(np.int64)
        plane = np.zeros((self.n, self.bits), np.uint8)
        for b in range(self.bits):
            plane[:, b] = low >> b & 1
        high = (values >> self.bits) + np.arange(self.n, dtype=np.int64)
        marks = np.zeros((int(high[-1]) if self.n else 0) // 64 * 64 + 128, np.uint8)
        marks[high] = 1
        self.low = mapped(np.concatenate((np.packbits(plane.ravel(), bitorder="little"), np.zeros(16, np.uint8))), file)
        # Eight bytes from any byte on, read as one number.
        self.low_words = np.ndarray((len(self.low) - 8,), "<u8", self.low, strides=(1,))
        self.high = mapped(np.packbits(marks, bitorder="little").view(np.uint64), file)
        ones = np.cumsum(np.bitwise_count(self.high).astype(np.int64))
        self.ones = mapped(np.concatenate(([0], ones)), file)
        self.zeros = mapped(np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones, file)

    @staticmethod
    def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the one with the given rank in each word, by halving."""
        at, rank = np.zeros(len(word), np.int64), rank.copy()
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            over = rank >= below
            rank -= np.where(over, below, 0)
            at += np.where(over, width, 0)
            word = np.where(over, word >> np.uint64(width), word)
        return at

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.bits
        word = self.low_words[bit >> 3]
        return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given positions."""
        block = np.searchsorted(self.ones, at, "right") - 1
        where = block * 64 + self._in_word(self.high[block], at - self.ones[block])
        return (where - at) << self.bits | self.lows(at)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below each of ``high``: what stands before the zero that ends the part before."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        rank = high[some] - 1
        block = np.searchsorted(self.zeros, rank, "right") - 1
        inside = block < len(self.high)
        out[some[~inside]] = self.n
        some, rank, block = some[inside], rank[inside], block[inside]
        where = block * 64 + self._in_word(~self.high[block], rank - self.zeros[block])
        out[some] = np.minimum(where - rank, self.n)
        return out

    def find(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Successor search: the position in [first, end) of the first number not below ``value``; -1 if it is another number."""
        high, low = value >> self.bits, value & np.int64((1 << self.bits) - 1)
        at, stop = np.maximum(self._bucket(high), first), np.minimum(self._bucket(high + 1), end)
        # Numbers of one high part rise in their low parts: halve the stretch until the successor is found.
        end_at = stop.copy()
        todo = np.flatnonzero(at < stop)
        while len(todo):
            middle = (at[todo] + stop[todo]) >> 1
            less = self.lows(middle) < low[todo]
            at[todo[less]] = middle[less] + 1
            stop[todo[~less]] = middle[~less]
            todo = todo[at[todo] < stop[todo]]
        there = np.flatnonzero(at < end_at)
        there = there[self.lows(at[there]) == low[there]]
        found = np.full(len(value), -1, np.int64)
        found[there] = at[there]
        return found


def mapped(values: np.ndarray, file) -> np.ndarray:
    """``values`` written to ``file`` and mapped from there, as a plain array over the mapping."""
    if not values.size:
        return values
    at = file.seek(-(-file.seek(0, 2) // 16) * 16)
    file.write(values.tobytes())
    file.flush()
    return np.asarray(np.memmap(file, values.dtype, "r", at, values.shape))


class Trie:
    """Contexts and their successors, with discounted probabilities.

    Level 1: hashes of context words in order, with their counts, weights of the lower order and pointers to their successors. Level 2:
    successors by context, as numbers context * words + word, which rise through the level. Pointers and successors are Elias-Fano
    sequences; probabilities and weights are quantised.

    A seen pair has (c - d) / c(context) of its own. d is the context's (n1 + 1/2) / (n1 + 2 n2 + 1), from its numbers of pairs seen once and twice.
    What is taken off goes to the lower order: d * pairs / c(context).
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, file):
        """Pairs in order of (context, word), each once, counts above 0."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        kinds = np.diff(np.concatenate((first, [len(context)])))
        rank = np.repeat(np.arange(len(first)), kinds)
        self.contexts = mapped(context[first], file)
        words, own = np.unique(word, return_inverse=True)
        self.words = mapped(words, file)
        total = np.bincount(rank, weights=count, minlength=len(first))
        once = np.bincount(rank[count == 1], minlength=len(first))
        twice = np.bincount(rank[count == 2], minlength=len(first))
        d = (once + 0.5) / (once + 2 * twice + 1)
        self.counts = mapped(total.astype(np.int64), file)
        self.lower = mapped(quantise(np.maximum(d * kinds / np.maximum(total, 1), 1e-12)), file)
        self.pointers = EliasFano(np.concatenate((first, [len(context)])).astype(np.int64), file)
        self.successors = EliasFano(rank * np.int64(max(1, len(words))) + own, file)
        self.own = mapped(quantise((count - d[rank]) / total[rank]), file)
        self.seen = mapped(np.asarray(count, np.int64), file)
        #: Of each context its pairs, and those seen once and twice.
        self.spread = (kinds, once, twice)

    def context(self, hashes: np.ndarray) -> np.ndarray:
        return _position(self.contexts, hashes)

    def query(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Positions of pairs among the successors; -1 if a pair isn't seen. ``contexts`` are positions or -1, each with ``sizes`` pairs of the given words."""
        known = np.maximum(contexts, 0)
        there = contexts >= 0
        first = np.repeat(np.where(there, self.pointers.get(known), 0) if self.pointers.n > 1 else np.zeros(len(known), np.int64), sizes)
        end = np.repeat(np.where(there, self.pointers.get(known + 1), 0) if self.pointers.n > 1 else np.zeros(len(known), np.int64), sizes)
        word = _position(self.words, words)
        place = np.full(len(word), -1, np.int64)
        ask = np.flatnonzero((first < end) & (word >= 0))
        value = np.repeat(known, sizes)[ask] * np.int64(max(1, len(self.words))) + word[ask]
        place[ask] = self.successors.find(value, first[ask], end[ask])
        return place


def _position(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in ``ordered``; -1 if it doesn't."""
    if not len(ordered):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


# --- batches of documents ---------------------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _batches(kind: pa.DataType, most: int):
    """Texts as numbers: a row for each batch of documents, of ``most`` tokens and one text more."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = 0
        numbers, ids, held, tokens, size = _Numbers(), [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal made, numbers, ids, held, tokens, size
            hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w, 42) for w in numbers), np.uint64, len(numbers))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            lengths = np.fromiter(map(len, tokens), np.int32, len(tokens))
            joined = np.concatenate(tokens)
            data = pack(hashes[order], place[joined], lengths, np.array(held, np.uint8))
            counts = np.bincount(joined, minlength=len(hashes))
            heads = np.argpartition(-counts, HEADS)[:HEADS] if len(counts) > HEADS else np.arange(len(counts))
            out = pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([data], pa.binary()), pa.array([size], pa.int64()), pa.array([hashes[heads].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[heads]], pa.list_(pa.int64()))], names=["batch", "ids", "data", "tokens", "heads", "counts"])
            made += 1
            numbers, ids, held, tokens, size = _Numbers(), [], [], [], 0
            return out

        for part in parts:
            for name, text, out in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.lower().split() if text else []
                words.append(None)  # the end
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(name)
                held.append(out)
                size += len(words)
                if size >= most:
                    yield row()
        if ids:
            yield row()

    return run


class _Pairs:
    """The distinct (context, word) pairs of a batch, in order, and the shards that they go to.

    A context goes to the shard of its hash. One in ``wide`` (hash to parts) is dealt by word to as many shards from there on.
    Shards that follow each other share a frame, that is a message.
    """

    def __init__(self, data: bytes, shards: int, width: int, wide: dict[int, int]):
        self.width = width
        self.hashes, self.tokens, self.lengths, held = unpack(data)
        self.train = np.repeat(held == 0, self.lengths)
        end = int(np.searchsorted(self.hashes, np.uint64(END)))
        # Numbers within a batch are kept in 32 bits, and long arrays are dropped once used.
        key = np.concatenate(([end], self.tokens[:-1])).astype(np.int64)
        key *= len(self.hashes)
        key += self.tokens
        pair, place = np.unique(key, return_inverse=True)
        del key
        self.of_token = place.astype(np.int32)
        del place
        self.context, self.word = (pair // len(self.hashes)).astype(np.int32), (pair % len(self.hashes)).astype(np.int32)
        self.count = np.bincount(self.of_token[self.train], minlength=len(pair)).astype(np.int32)
        del pair
        shard = ((self.hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
        parts = np.ones(len(self.hashes), np.int32)
        self.wide = [int(k) for k in np.flatnonzero(np.isin(self.hashes, np.array(list(wide), np.uint64)))]
        for k in self.wide:
            parts[k] = wide[int(self.hashes[k])]
        own = ((self.hashes[self.word] >> np.uint64(8)) % parts[self.context].astype(np.uint64)).astype(np.int32)
        own += shard[self.context]
        own %= shards
        self.shard = own
        self.order = np.argsort(own, kind="stable").astype(np.int32)
        #: The frames that the batch sends, at most one a pair.
        self.frames, first = np.unique(own[self.order] // self.width, return_index=True)
        self.bounds = np.concatenate((first, [len(own)]))

    def of(self, frame: int) -> np.ndarray:
        """Positions of the pairs that go in a frame, by shard, context and word."""
        k = int(np.searchsorted(self.frames, frame))
        return self.order[self.bounds[k] : self.bounds[k + 1]]

    def contexts_of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among pairs of one frame at which the contexts of its shards begin, and how many pairs each has."""
        context, shard = self.context[own], self.shard[own]
        first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (shard[1:] != shard[:-1]))))
        return first, np.diff(np.concatenate((first, [len(own)])))

    def question(self, frame: int) -> bytes:
        """What the batch asks the shards of a frame: contexts of each shard, their hashes and sizes, then for each pair its word and its count in training texts.

        Contexts have all 64 bits; a word is told by :data:`SHORT` bytes, as it is only held to others after the same context.
        So a pair costs the same bytes whatever the number of shards.
        """
        own = self.of(frame)
        first, sizes = self.contexts_of(own)
        kinds = np.bincount(self.shard[own[first]] - frame * self.width, minlength=self.width)
        contexts, words = self.hashes[self.context[own[first]]], self.hashes[self.word[own]] >> np.uint64(64 - 8 * SHORT)
        starts = np.flatnonzero(np.diff(self.shard[own[first]], prepend=-1))
        return pack(narrow(kinds), planes(steps(contexts, starts), 8), narrow(sizes), planes(steps(words, first), SHORT), narrow(self.count[own]))


def frame_width(shards: int) -> int:
    """Shards of a frame."""
    return min(FRAME, -(-shards // FRAMES))


def by_shard(question: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each shard of a frame: hashes of contexts, how many pairs each has, and the pairs' words and counts."""
    kinds, contexts, sizes, words, counts = unpack(question)
    kinds, sizes = kinds.astype(np.int64), sizes.astype(np.int64)
    contexts = from_steps(from_planes(contexts, 8), kinds[kinds > 0])
    words = from_steps(from_planes(words, SHORT), sizes)
    ends = np.cumsum(kinds)
    pairs = np.concatenate(([0], np.cumsum(sizes)))
    return [(contexts[a:b], sizes[a:b], words[pairs[a] : pairs[b]], counts[pairs[a] : pairs[b]]) for a, b in zip((ends - kinds).tolist(), ends.tolist(), strict=True)]


def _ask(shards: int, width: int, wide: dict[int, int]):
    """Each batch's pairs, a row for each frame of shards that it asks: no more rows than pairs, whatever the number of shards."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                pairs = _Pairs(data, shards, width, wide)
                frames = pairs.frames.tolist()
                for k in range(0, len(frames), 64):
                    some = frames[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([pairs.question(f) for f in some], pa.binary())], names=["frame", "batch", "asked"])

    return run


def _answer(wide: dict[int, int]):
    """For rows in order of frame: build the trie of each of its shards from what all batches ask, and answer each."""
    known_wide = np.array(list(wide), np.uint64)

    def answer(asked: list[tuple]) -> tuple[list[tuple], int, int, list]:
        """One shard's answers to each batch, its tokens, its contexts, and of contexts that other shards share the sums."""
        context = np.concatenate([np.repeat(c, n) for c, n, *_ in asked])
        word = np.concatenate([w for _, _, w, _ in asked])
        count = np.concatenate([x.astype(np.int64) for *_, x in asked])
        seen = count > 0
        order = np.flatnonzero(seen)[np.lexsort((word[seen], context[seen]))]
        c, w = context[order], word[order]
        first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))) if len(c) else np.zeros(0, np.int64)
        sums = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
        out = []
        with tempfile.TemporaryFile() as file:
            trie = Trie(c[first], w[first], sums, file)
            for contexts, sizes, words, _ in asked:
                place = trie.context(contexts)
                known = place >= 0
                counts = np.where(known, trie.counts[place] if len(trie.counts) else 0, 0)
                lower = np.where(known, trie.lower[place] if len(trie.lower) else 0, 0).astype(np.uint16)
                pair = trie.query(place, sizes, words)
                there = pair >= 0
                codes, exact = np.zeros(len(pair), np.uint16), np.zeros(len(pair), np.int64)
                codes[there], exact[there] = trie.own[pair[there]], trie.seen[pair[there]]
                # Pairs of a context that other shards share go back as counts: its discount is that of all parts.
                dealt = np.repeat(np.isin(contexts, known_wide), sizes)
                out.append((counts, lower, codes[~dealt], exact[dealt]))
            shared = np.flatnonzero(np.isin(trie.contexts, known_wide))
            total, kinds = int(trie.counts.sum()), len(trie.contexts) - len(shared)
            some = np.column_stack((trie.contexts[shared].view(np.int64), trie.counts[shared], *(x[shared] for x in trie.spread))).astype(np.int64).tolist()
        return out, total, kinds, some

    def answers(frame: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        done = [answer(list(shard)) for shard in zip(*(by_shard(d) for _, d in rows), strict=True)]
        packed = []
        for k in range(n):
            counts, lower, codes, exact = (np.concatenate(x) for x in zip(*(out[k] for out, *_ in done), strict=True))
            packed.append(pack(narrow(counts), lower, codes, narrow(exact)))
        sums = [sum(x) for x in zip(*(d[1:3] for d in done), strict=True)]
        names = ["batch", "frame", "answer", "total", "kinds", "wide"]
        columns = [pa.array([b for b, _ in rows], pa.int64()), pa.array([frame] * n, pa.int32()), pa.array(packed, pa.binary()), *(pa.array([x] + [0] * (n - 1), pa.int64()) for x in sums)]
        columns.append(pa.array([[w for d in done for w in d[3]]] + [[]] * (n - 1), pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for part in parts:
            for frame, batch, data in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if frame != at and rows:
                    yield answers(at, rows)
                    rows = []
                at = frame
                rows.append((batch, data))
        if rows:
            yield answers(at, rows)

    return run


def _score(shards: int, width: int, wide: dict[int, int], spread: dict[int, tuple[int, int, int, int]], total: int, kinds: int, kind: pa.DataType):
    """For rows in order of (batch, frame), a batch's texts first: scores of its documents.

    ``spread`` has of each wide context the sums over its parts: tokens, pairs, pairs seen once and twice. They give it one discount, as if it were whole.
    """

    def score(ids: list, data: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        pairs = _Pairs(data, shards, width, wide)
        n = len(pairs.hashes)
        counts, lower, own = np.zeros(n), np.ones(n), np.zeros(len(pairs.context))
        for frame, answer in answers:
            c, low, codes, exact = unpack(answer)  # in the order in which the batch asked
            of = pairs.of(frame)
            first, sizes = pairs.contexts_of(of)
            at = pairs.context[of[first]]
            counts[at] = c
            lower[at] = np.where(low > 0, restore(low), 1.0)
            dealt = np.repeat(np.isin(at, pairs.wide), sizes)
            own[of[~dealt]], own[of[dealt]] = restore(codes), exact
        if pairs.wide:
            d = np.zeros(n)
            for k in pairs.wide:
                counts[k], some, once, twice = spread.get(int(pairs.hashes[k]), (0, 0, 0, 0))
                d[k] = (once + 0.5) / (once + 2 * twice + 1)
                lower[k] = restore(quantise(np.array([max(d[k] * some / counts[k], 1e-12)])))[0] if counts[k] else 1.0
            shares = np.flatnonzero(np.isin(pairs.context, pairs.wide) & (own > 0))
            of = pairs.context[shares]
            own[shares] = restore(quantise((own[shares] - d[of]) / counts[of]))
        base = (counts + 0.1) / (total + 0.1 * (kinds + 1))
        pair = np.log10(own + lower[pairs.context] * base[pairs.word])
        ends = np.cumsum(pairs.lengths)
        starts = ends - pairs.lengths
        sums = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: E731  every text has its end, so no stretch is empty
        known, log_base = counts > 0, np.log10(base)
        columns = [pa.array(ids, kind), pa.array(pairs.lengths.astype(np.int64)), sums(known[pairs.tokens].astype(np.int64)), sums(log_base[pairs.tokens]), sums(pair[pairs.of_token]), pa.array(~pairs.train[starts])]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_known", "base_score", "score", "held_out"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, answers = None, []
        for part in parts:
            for frame, ids, data in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if frame < 0:
                    if texts:
                        yield score(*texts, answers)
                    texts, answers = (ids, data), []
                else:
                    answers.append((frame, data))
        if texts:
            yield score(*texts, answers)

    return run


def with_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Learns from rows whose crc32 of the id as text is no multiple of 10, and scores all. The model interpolates discounted bigrams with the unigrams
    of ``base_score``; the first word and the end of a text have the end before and after them.

    Texts become numbers in batches of some two million tokens, kept as a table. The model is cut into shards by context word, each a trie
    (:class:`Trie`) built in one task from the distinct pairs of all batches and mapped from a temporary file of that task. Batches send their distinct pairs, not
    their tokens, and get codes back, so traffic is a few bytes a token: a context's hash has eight bytes, each word after it five, whatever the number of shards. A context with over half a shard of tokens is dealt by word to several shards,
    whose sums give it one discount, so scores do not depend on shards or partitions; the list of those, :data:`WIDE` at most, and two sums are all that goes to the driver. Words are known by their 64-bit XXH64, those after one context by its first 40 bits.

    A null text is the end alone; a null id counts as the empty string for the split, which holds it out. Rows that repeat an id are scored each. An empty table gives an empty one;
    extra columns are not looked at.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"), held.alias("held"))
    name = rows.schema["id"].dataType.simpleString()
    kind = to_arrow_type(rows.schema["id"].dataType)
    batches = scratch.save(rows.mapInArrow(_batches(kind, BATCH), f"batch long, ids array<{name}>, data binary, tokens long, heads array<long>, counts array<long>"), "lm-batches")
    total, made = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-total // SHARD))
    width = frame_width(shards)
    # Contexts of over half a shard, the largest of them; any other has less than one in WIDE of all tokens.
    heads = batches.select(F.explode(F.arrays_zip("heads", "counts")).alias("h")).groupBy("h.heads").agg(F.sum("h.counts").alias("n")).where(F.col("n") * 2 * shards > total).orderBy(F.desc("n"), "heads").limit(WIDE).collect()
    wide = {r["heads"] % (1 << 64): min(shards, -(-r["n"] * 2 * shards // total)) for r in heads}

    asked = batches.select("batch", "data").mapInArrow(_ask(shards, width, wide), "frame int, batch long, asked binary")
    dealt = asked.repartition(min(-(-shards // width), TASKS), "frame").sortWithinPartitions("frame")
    answers = scratch.save(dealt.mapInArrow(_answer(wide), "batch long, frame int, answer binary, total long, kinds long, wide array<array<long>>"), "lm-answers")
    sums = answers.agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).first()
    train = sums["total"] or 0
    parts = answers.select(F.explode("wide").alias("w")).groupBy(F.col("w")[0].alias("context")).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(1, 5)]).collect()
    spread = {r[0] % (1 << 64): tuple(r[1:]) for r in parts}
    kinds = (sums["kinds"] or 0) + len(spread)

    none = F.lit(None).cast(f"array<{name}>").alias("ids")
    both = batches.select("batch", F.lit(-1).alias("frame"), "ids", "data").union(answers.select("batch", "frame", none, F.col("answer").alias("data")))
    # Few large rows: twice as many tasks as batches, so that few get two.
    dealt = both.repartition(max(least, 2 * made), "batch").sortWithinPartitions("batch", "frame")
    scored = dealt.mapInArrow(_score(shards, width, wide, spread, train, kinds, kind), f"id {name}, n_tokens long, n_known long, base_score double, score double, held_out boolean")
    return scored.withColumn("train_tokens", F.lit(train).cast("long"))
