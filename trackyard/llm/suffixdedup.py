"""Operator 9: byte strings that occur twice are removed, found in a sparse suffix array of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Length of the strings; starts that share an anchor lie within SPAN bytes before it.
LENGTH, SPAN = 400, 352
#: Bytes of texts hashed at once.
BLOCK = 1 << 20
#: Suffixes sorted in one bucket, bytes of stretches compared in one task, and stretches compared at once.
BUCKET, TASK, ONCE = 250_000, 32 << 20, 16_384
#: Runs of more different stretches are dealt out string by string.
HOT = 1000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Rolling:
    """64-bit polynomial hashes of any stretch of a block of bytes."""

    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._power) < n:
            for name, base in (("_power", _BASE), ("_inverse", _INVERSE)):
                x = np.full(max(n, BLOCK + BLOCK // 4), base, np.uint64)
                x[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(x))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * Rolling._inverse[start])


# --- suffixes ---------------------------------------------------------------------------------------------------


def anchors(data: bytes, ends: np.ndarray, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes within the texts that end at ``ends`` in ``data``.

    The anchor of a string is the position of the least 8-byte hash in its first ``span`` positions, the last one on ties: it depends on the string
    alone, so equal strings have equal anchors at equal distance. Strings in a row share anchors, so about 2 in ``span`` positions are one.
    Returns per anchor: first start, number of starts, the anchor.
    """
    n = len(data)
    text = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = np.ndarray((n,), "<u8", text.data, strides=(1,))
    low = np.uint64((1 << 24) - 1)
    least = (_mix(word * np.uint64(_BASE)) & ~low) | (low - np.arange(n, dtype=np.uint64))
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: step - span], least[span - step :])
    sizes = np.diff(np.concatenate(([0], ends)))
    last = np.repeat(ends, sizes)  # end of the text of each position
    start = np.flatnonzero(np.arange(n) + length <= last)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    at = (low - (least[start] & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    return start[first], np.diff(np.concatenate((first, [len(start)]))), at[first]


def _blocks(texts: list[bytes | None], length: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(index of the first text, offset in it, joined bytes, ends) of texts in a row, BLOCK bytes or one longer text at once.

    Texts over eight blocks come in pieces that overlap by ``length`` - 1 bytes, so each string is in one piece.
    """
    first, size = 0, 0
    for k, text in enumerate([*texts, None]):
        n = len(text) if text is not None else 0
        if k == len(texts) or size and size + n > BLOCK:
            part = [t or b"" for t in texts[first:k]]
            if len(part) == 1 and size > 8 * BLOCK:
                for at in range(0, size - length + 1, 8 * BLOCK):
                    piece = part[0][at : at + 8 * BLOCK + length - 1]
                    yield first, at, piece, np.array([len(piece)])
            elif size:
                yield first, 0, b"".join(part), np.cumsum([len(t) for t in part])
            first, size = k, 0
        size += n


def _count(length: int, span: int):
    """Number of suffixes in each batch of texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = sum(len(anchors(data, ends, length, span)[0]) for _, _, data, ends in _blocks(part.column(0).to_pylist(), length))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _suffixes(length: int, span: int):
    """For (id, row, text): a row for each anchor, with the bytes from there on that all its strings have, and a hash of the whole stretch they cover."""
    key = length - span + 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, offset, data, ends in _blocks(part.column(2).to_pylist(), length):
                begin, count, anchor = anchors(data, ends, length, span)
                n = len(begin)
                if not n:
                    continue
                text = np.frombuffer(data, np.uint8)
                lead = np.lib.stride_tricks.sliding_window_view(text, key)[anchor].tobytes()
                rolling = Rolling(text)
                whole = rolling.of(begin, begin + count - 1 + length) ^ _mix((anchor - begin).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
                row = np.searchsorted(ends, begin, "right")
                base = np.concatenate(([0], ends))[row]
                taken = pa.array(row + k)
                leads = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * key + 1, key, dtype=np.int32)), pa.py_buffer(lead)])
                yield pa.RecordBatch.from_arrays(
                    [
                        leads, pa.array(whole.view(np.int64)), part.column(0).take(taken), part.column(1).take(taken),
                        pa.array((begin - base + offset).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((anchor - begin).astype(np.int32)),
                    ],
                    names=["lead", "whole", "id", "row", "at", "n", "off"],
                )

    return run


def as_words(data: np.ndarray) -> np.ndarray:
    """Rows of bytes (n, w) as rows of big-endian 64-bit numbers, zeros after the end: they order as the bytes do."""
    n, w = data.shape
    wide = np.zeros((n, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = data
    return wide.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, small: int = 2048) -> np.ndarray:
    """Order of the rows of ``words``: parted in three by a pivot in one word, equal rows go on with the next word.

    Parts of at most ``small`` rows end with one sort over the words that are left.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        own = order[low:high]
        if high - low <= small:
            order[low:high] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        x = words[own, depth]
        pivot = np.sort(x[:: max(1, len(x) // 64)])[len(x[:: max(1, len(x) // 64)]) // 2]
        less, more = x < pivot, x > pivot
        order[low:high] = np.concatenate((own[less], own[~(less | more)], own[more]))
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def common_prefix(words: np.ndarray) -> np.ndarray:
    """Bytes that each row of sorted ``words`` has in common with the row before; 0 for the first."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        other = words[1:] != words[:-1]
        first = np.argmax(other, axis=1)
        at = np.arange(len(first))
        x = words[1:][at, first] ^ words[:-1][at, first]
        zeros = sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        out[1:] = np.where(other[at, first], first * 8 + zeros, words.shape[1] * 8)
    return out


def _joined(parts: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a task as one table; none if there are none."""
    table = pa.Table.from_batches(parts) if (parts := list(parts)) else None
    return table.combine_chunks() if table is not None and table.num_rows else None


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row starts, with the end of the last."""
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    at = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4).astype(np.int64)
    return np.frombuffer(own.buffers()[2] or b"", np.uint8), at


def _sort_bucket(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket of suffixes by multikey quicksort; keep those whose neighbour has the same leading bytes, a run.

    kind 0: its whole stretch occurs again; 1: one of its kind, to be compared with the others of its run; 2: one
    for all of a stretch that occurs again, to compare with; 3: one for each stretch in the first or last run of the bucket, which may go on in
    the next, with the number of times it was seen, 2 standing for more.
    """
    table = _joined(parts)
    if table is None:
        return
    data, at = _bytes_of(table.column("lead"))
    whole = table.column("whole").to_numpy().view(np.uint64)
    words = np.column_stack((as_words(data[at[0] : at[-1]].reshape(len(whole), -1)), whole))
    order = multikey_quicksort(words)
    words = words[order]
    equal = words[1:] == words[:-1]
    run_starts = np.concatenate(([True], ~equal[:, :-1].all(axis=1)))
    class_starts = np.concatenate(([True], ~equal.all(axis=1)))
    run, group = np.cumsum(run_starts) - 1, np.cumsum(class_starts) - 1
    in_run, in_group = np.bincount(run), np.bincount(group)
    classes = np.bincount(run[class_starts])
    singles = np.bincount(run[class_starts], weights=in_group == 1)
    open_ = (run == 0) | (run == run[-1])
    again = in_group[group] > 1
    mixed = (classes[run] > 1) & (singles[run] > 0)
    columns = ["id", "row", "at", "n", "off"]
    for kind, which in (
        (0, again),
        (1, ~open_ & ~again & (in_run[run] > 1)),
        (2, ~open_ & again & mixed & class_starts),
        (3, open_ & class_starts),
    ):
        found = np.flatnonzero(which)
        for k in range(0, len(found), 50_000):
            own = found[k : k + 50_000]
            rows = table.take(pa.array(order[own]))
            lead = rows.column("lead") if kind else pa.nulls(len(own), pa.binary())
            made = [lead, rows.column("whole"), *[rows.column(c) for c in columns], pa.array(classes[run[own]].astype(np.int64)), pa.array(np.full(len(own), kind, np.int32)), pa.array(np.minimum(in_group[group[own]], 2).astype(np.int32))]
            yield from pa.table(made, names=["lead", "whole", *columns, "classes", "kind", "seen"]).combine_chunks().to_batches()


def _across(open_: DataFrame) -> DataFrame:
    """The kinds of stretches whose run may lie in several buckets: a row for each stretch and bucket, not for each suffix."""
    groups = open_.groupBy("lead", "whole").agg(F.sum("seen").alias("m"), F.min(F.struct("id", "row", "at", "n", "off")).alias("one"))
    runs = groups.groupBy("lead").agg(F.count("*").alias("c"), F.sum("m").alias("t"), F.max((F.col("m") == 1).cast("int")).alias("s")).where("t > 1")
    groups = groups.join(runs, "lead")
    back = groups.select(*[F.col(c).alias(f"_{c}") for c in ("lead", "whole")], "m", "c")
    rows = open_.where("seen = 1").join(back, (F.col("lead") == F.col("_lead")) & (F.col("whole") == F.col("_whole")))
    own = rows.select("lead", "id", "row", "at", "n", "off", F.col("c").alias("classes"), F.when(F.col("m") > 1, 0).otherwise(1).cast("int").alias("kind"))
    one = groups.where("m > 1 AND c > 1 AND s = 1").select("lead", "one.id", "one.row", "one.at", "one.n", "one.off", F.col("c").alias("classes"), F.lit(2).alias("kind"))
    return own.union(one)


#: A string without its bytes: its hash, the place of its document in the row's list, its start, its weight.
STRING = np.dtype([("h", "<u8"), ("place", "<i4"), ("start", "<i4"), ("weight", "<i4")])


# --- stretches that agree at the anchor, but not as a whole -----------------------------------------------------


def _spans(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, span) of starts that follow each other: a span is its first start and its number of starts."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))) if len(owner) else np.zeros(0, np.int64)
    return owner[first], start[first] << 32 | np.diff(np.concatenate((first, [len(owner)])))


def _stretches(length: int, hot: int, deals: int):
    """For (id, row, text, wanted): the wanted stretches, dealt by run.

    Strings of a run of over ``hot`` different stretches are dealt by their own hash instead, without bytes: a row for each batch and deal holds those of the batch (kind -1).
    Strings that a batch holds twice are settled there (kind 0) and go on once, with weight 2, so an equal string is met once a batch at most.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            plain: list[tuple] = []
            hashes, owners, starts, kinds = [], [], [], []
            for k, (text, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                rolling = None
                for w in wanted:
                    if w["classes"] <= hot:
                        plain.append((w["run"], k, w["kind"], w["at"], w["n"], w["off"], text[w["at"] : w["at"] + w["n"] - 1 + length]))
                        continue
                    rolling = rolling or Rolling(np.frombuffer(text, np.uint8))
                    own = np.arange(w["at"], w["at"] + w["n"])
                    hashes.append(rolling.of(own, own + length))
                    owners.append(np.full(len(own), k))
                    starts.append(own)
                    kinds.append(np.full(len(own), w["kind"]))

            def made(run, owner, kind, at, n, off, text, ids=None, rows=None, part=part) -> pa.RecordBatch:
                taken, none = pa.array(owner, pa.int64()), pa.array(np.zeros(len(run) + 1, np.int32))
                ids = ids or pa.ListArray.from_arrays(none, part.column(0).slice(0, 0))
                rows = rows or pa.ListArray.from_arrays(none, part.column(1).slice(0, 0))
                numbers = [pa.array(x, pa.int32()) for x in (kind, at, n, off)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(run, pa.int64()), part.column(0).take(taken), part.column(1).take(taken), *numbers, pa.array(text, pa.binary()), ids, rows],
                    names=["run", "id", "row", "kind", "at", "n", "off", "text", "ids", "rows"],
                )

            for k in range(0, len(plain), 4000):
                yield made(*zip(*plain[k : k + 4000], strict=True))
            if not hashes:
                continue
            h, owner, start, kind = (np.concatenate(x) for x in (hashes, owners, starts, kinds))
            _, first, at = np.unique(h, return_index=True, return_inverse=True)
            weight = np.bincount(at, weights=kind)
            twice = (weight > 1)[at] & (kind == 1)
            at_owner, span = _spans(owner[twice], start[twice])
            zero = np.zeros(len(span), np.int32)
            yield made((_mix(span.view(np.uint64)) ^ _mix(at_owner.view(np.uint64))).view(np.int64), at_owner, zero, span >> 32, span & 0xFFFFFFFF, zero, [None] * len(span))
            deal = (h[first] % np.uint64(deals)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(deal[order])) + 1, [len(order)]))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                own = first[order[low:high]]
                held, place = np.unique(owner[own], return_inverse=True)
                packed = np.rec.fromarrays([h[own], place, start[own], np.minimum(weight[order[low:high]], 2)], dtype=STRING).tobytes()
                taken = pa.array(held)
                offsets = pa.array([0, len(held)], pa.int32())
                yield made([int(deal[order[low]])], held[:1], [-1], [0], [0], [0], [packed], pa.ListArray.from_arrays(offsets, part.column(0).take(taken)), pa.ListArray.from_arrays(offsets, part.column(1).take(taken)))

    return run


def _padded(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Bytes at ``at``, ``at + step`` and so on, ``size`` of them at most, zeros after."""
    k = np.arange(width)
    there = k < size[:, None]
    return np.where(there, data[np.where(there, at[:, None] + k * step, 0)], 0)


def repeated(run: np.ndarray, data: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, start in it) of the strings that occur again in another stretch of their run.

    Stretch k is ``data`` from ``at[k]`` to ``at[k + 1]``: strings start at its first ``n[k]`` bytes; the anchor is its byte ``off[k]``. Stretches are sorted by what follows the anchor, and by what precedes it, backwards,
    each with the bytes in common with its neighbour. Strings that start a bytes before the anchor are equal if they have a bytes before it and length - a bytes after it
    in common: no neighbour between the two in either order has less.
    """
    size = np.diff(at)
    sides = []
    for words in (as_words(_padded(data, at[:-1] + off, size - off, length)), as_words(_padded(data, at[:-1] + off - 1, off, max(1, int(off.max())), -1))):
        words = np.column_stack((run.view(np.uint64), words))
        order = multikey_quicksort(words)
        common = common_prefix(words[order]) - 8  # below 0 between runs
        most = np.empty(len(order), np.int64)
        most[order] = np.maximum(common, np.concatenate((common[1:], [-8])))
        sides.append((order, common, most))
    (right, after, most_after), (left, before, most_before) = sides
    found, starts = [], []
    by_right, by_left = np.empty(len(run), np.int64), np.empty(len(run), np.int64)
    for a in range(int(off.max()) + 1):
        own = np.flatnonzero((off - n < a) & (a <= off) & (most_after >= length - a) & (most_before >= a))
        if len(own) < 2:
            continue
        by_right[right] = np.cumsum(after < length - a)
        by_left[left] = np.cumsum(before < a)
        _, at_class = np.unique(by_right[own] * (len(run) + 1) + by_left[own], return_inverse=True)
        again = own[(np.bincount(at_class, weights=weight[own]) > 1)[at_class] & (weight[own] == 1)]
        found.append(again)
        starts.append(off[again] - a)
    return (np.concatenate(found), np.concatenate(starts)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(length: int):
    """Spans of starts, in stretches of kind 1, whose string occurs again among the rows of this task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _joined(parts)
        if table is None:
            return
        text = table.column("text")
        key, kind, at, n, off = (table.column(c).to_numpy() for c in ("run", "kind", "at", "n", "off"))
        rows, spans = [], []
        own = np.flatnonzero(kind > 0)
        if len(own):
            own = own[np.argsort(key[own], kind="stable")]
            ends = np.concatenate((np.flatnonzero(key[own][1:] != key[own][:-1]) + 1, [len(own)]))
            low = 0
            while low < len(own):  # whole runs
                high = ends[max(np.searchsorted(ends, low, "right"), np.searchsorted(ends, low + ONCE, "right") - 1)]
                some = own[low:high]
                data, bounds = _bytes_of(text.take(pa.array(some)))
                stretch, start = repeated(key[some], data, bounds, n[some].astype(np.int64), off[some].astype(np.int64), kind[some], length)
                owner, span = _spans(some[stretch], at[some[stretch]] + start)
                rows.append(owner)
                spans.append(span)
                low = high
        done = np.flatnonzero(kind == 0)
        rows.append(done)
        spans.append(at[done].astype(np.int64) << 32 | n[done])
        taken, spans = pa.array(np.concatenate(rows)), pa.array(np.concatenate(spans))
        yield from pa.table({"id": table.column("id").take(taken), "row": table.column("row").take(taken), "span": spans}).combine_chunks().to_batches(max_chunksize=50_000)
        packed = table.filter(pa.array(kind == -1)).combine_chunks()
        if packed.num_rows:
            each = [np.frombuffer(x, STRING) for x in packed.column("text").to_pylist()]
            base = np.concatenate(([0], np.cumsum([len(x) for x in packed.column("ids").to_pylist()])))
            owner = np.concatenate([x["place"] + b for x, b in zip(each, base, strict=False)])
            one = np.concatenate(each)
            _, at_class = np.unique(one["h"], return_inverse=True)
            again = (np.bincount(at_class, weights=one["weight"]) > 1)[at_class] & (one["weight"] == 1)
            owner, spans = _spans(owner[again], one["start"][again])
            taken = pa.array(owner)
            yield from pa.table({"id": pc.list_flatten(packed.column("ids")).take(taken), "row": pc.list_flatten(packed.column("rows")).take(taken), "span": pa.array(spans)}).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def _cut(length: int):
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            text = b"" if text is None else text
            if own is None or not len(own):
                rows.append((len(text), 0, 0, text))
                continue
            own = np.asarray(own, np.int64)
            begin, end = own >> 32, (own >> 32) + (own & 0xFFFFFFFF) - 1 + length
            depth = np.cumsum(np.bincount(begin, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1))[: len(text)]
            gone = depth > 0
            edges = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((len(text), int(gone.sum()), edges, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def with_repeats_removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "cut", length: int = LENGTH, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """``docs`` with a struct column ``out``: n_bytes, n_removed, n_spans, kept (bytes).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another; strings do not cross texts.

    A suffix array of all positions would sort ``length`` bytes for each byte of text. This one is sparse: only suffixes at
    anchors (see :func:`anchors`), chosen by content, so two equal strings always have their suffixes among them, at equal distance. Suffixes carry the
    ``length`` - ``span`` + 1 bytes that all strings of the anchor have. They
    are range-partitioned by sampled splitters on those bytes, then a hash of the whole stretch, and row;
    buckets sort locally by multikey quicksort (:func:`multikey_quicksort`) and keep suffixes with the same leading bytes as a neighbour; the first and last run of each bucket are compared across
    boundaries. Splitters may fall inside a run, so a very frequent passage is spread over buckets. Stretches that occur again as a whole are done.
    Where stretches agree at the anchor but differ further out, their bytes are sorted outwards from the anchor, both ways, and neighbours compared (:func:`repeated`),
    in tasks of about :data:`TASK` bytes; runs of over ``hot`` different stretches are dealt out string by string, by hash.

    Null and empty texts and those under ``length`` bytes lose nothing. Rows with equal texts lose all strings. Rows equal in
    id and text are two documents. An empty table gives an empty one. Extra columns pass through; an existing column ``out`` is replaced.
    Texts are shuffled twice: to the stretches that are compared, and to the spans cut out.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    docs = docs.drop(out).withColumn("__row", F.xxhash64(text))
    rows = docs.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") >= length)
    kind = rows.schema["id"].dataType.simpleString()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = rows.select("text").mapInArrow(_count(length, span), "n long").agg(F.sum("n")).first()[0] or 0
    found = rows.mapInArrow(_suffixes(length, span), f"lead binary, whole long, id {kind}, row long, at int, n int, off int")
    dealt = found.repartitionByRange(max(least, suffixes // BUCKET), "lead", "whole", "id", "row", "at")
    marked = scratch.save(dealt.mapInArrow(_sort_bucket, f"lead binary, whole long, id {kind}, row long, at int, n int, off int, classes long, kind int, seen int"), "suffix-runs")
    across = scratch.save(_across(marked.where("kind = 3")), "suffix-open")
    marked = marked.where("kind < 3").select(across.columns).union(across)

    compared = marked.where("kind > 0")
    load = compared.agg(F.sum(F.when(F.col("classes") <= hot, F.col("n") + length).otherwise(F.col("n") * 24))).first()[0] or 0
    wanted = compared.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct(F.xxhash64("lead").alias("run"), "at", "n", "off", "classes", "kind")).alias("wanted"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("id", "row", "text", "wanted")
    tasks = max(least, load // TASK)
    stretches = texts.mapInArrow(_stretches(length, hot, tasks), f"run long, id {kind}, row long, kind int, at int, n int, off int, text binary, ids array<{kind}>, rows array<long>")
    parts = stretches.repartition(tasks, "run").mapInArrow(_compare(length), f"id {kind}, row long, span long")

    full = marked.where("kind = 0").select("id", "row", F.expr("shiftleft(cast(at as long), 32) | n").alias("span"))
    spans = full.union(parts).groupBy(F.col("id").alias("__sid"), F.col("row").alias("__srow")).agg(F.collect_set("span").alias("__spans"))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__sid")) & (F.col("__row") == F.col("__srow")), "left")
    cut = F.pandas_udf(_cut(length), "n_bytes long, n_removed long, n_spans long, kept binary")
    return joined.withColumn(out, cut(F.col(text).cast("binary"), F.col("__spans"))).drop("__row", "__sid", "__srow", "__spans")
