"""Operator 12: periodic runs of words, found by match lengths on sparse diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: A run has at least this many words, and at least this many times its period.
LEAST, TIMES = 6, 4

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def diagonals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in a sequence of word numbers; a number never stands in two texts of the sequence.

    A word is matched with earlier occurrences of itself, its lags. Of a lag q below g and of at least g / 2 (g a power of two) only the nearest earlier occurrence of the
    g words that end here can belong to a run: a run of smallest period q that has reached q + g words repeats them after exactly q words, no sooner, as its root is primitive.
    So a word adds one to at most one active lag for each power of two, and places where no g words recur are left out of all later powers; the work is
    n log n for any text, where all pairs of equal words would be the square. A lag whose matches stop here is a whole run, starting q + g - 1 words
    before its first match; it is emitted if it is long enough.
    """
    name, at = words.astype(np.int64), np.flatnonzero(np.bincount(words)[words] > 1) if len(words) else np.empty(0, np.int64)
    found, g = [], 2
    once = np.ones(len(words), bool)
    once[at] = False
    name[once] = -1
    while len(at):
        half = g // 2
        at = at[at >= half]
        at = at[name[at - half] >= 0]
        if not len(at):
            break
        pair = name[at - half] * (int(name[at].max()) + 1) + name[at]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        again = np.concatenate(([False], ranked[1:] == ranked[:-1]))
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(again[1:], at[order[1:]] - at[order[:-1]], 0)
        # Active lags: matches at words that follow each other, with the same lag.
        ends = np.concatenate((np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0)), [len(at) - 1]))
        first = np.concatenate(([0], ends[:-1] + 1))
        q = lag[first]
        length = ends - first + q + g
        runs = (q >= half) & (q < g) & (length >= np.maximum(LEAST, TIMES * q))
        found.append((at[first[runs]] - q[runs] - g + 1, length[runs], q[runs]))
        # The next power takes names of the g words that end at a place, where they recur.
        recurs = again | np.concatenate((again[1:], [False]))
        number = np.cumsum(~again) - 1
        name[:] = -1
        name[at[order[recurs]]] = number[recurs]
        at = np.sort(at[order[recurs]])
        g *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _described(texts: list[bytes | None]) -> list[tuple]:
    """A row of :data:`RESULT` for each text."""
    split = [t.split() if t else [] for t in texts]
    numbers, bounds, base = np.empty(sum(map(len, split)), np.int64), [0], 0
    for words in split:
        known: dict[bytes, int] = {}
        numbers[bounds[-1] : bounds[-1] + len(words)] = [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
        bounds.append(bounds[-1] + len(words))
    start, length, period = diagonals(numbers)
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.subtract.at(cover, start + length, 1)
    dropped = np.cumsum(cover) > 0
    cuts = np.searchsorted(start, bounds)
    out = []
    for k, words in enumerate(split):
        here = slice(cuts[k], cuts[k + 1])
        runs = list(zip((start[here] - bounds[k]).tolist(), length[here].tolist(), period[here].tolist(), strict=True))
        if not runs:
            out.append((0, None, None, None, None, "", b" ".join(words).decode("utf-8", "replace")))
            continue
        best = runs[0]
        for r in runs[1:]:
            if r[1] * best[2] > best[1] * r[2]:  # in order of start, then period: ties keep the first
                best = r
        kept = [w for w, x in zip(words, dropped[bounds[k] : bounds[k + 1]].tolist(), strict=True) if not x]
        out.append((len(runs), *best, 1000 * best[1] // best[2], "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(kept).decode("utf-8", "replace")))
    return out


def _runs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        found = pd.DataFrame(_described(list(batch)), columns=names)
        yield found.astype(dict.fromkeys(names[1:5], "Int64"))


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``out``: n_runs; start, length, period, exponent_milli of the run with the greatest length over period; runs; collapsed.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch with smallest period q of at least ``LEAST`` words and ``TIMES`` periods
    that no neighbouring word extends. ``runs`` has a line ``start,length,period`` for each, by start and period; ``collapsed`` is the text without the words that a run
    holds after its first period, joined by one space. Of equal exponents the smallest start, then period, is the best.

    Each text is read on its own, so no rows are shuffled, and a task holds one Arrow batch of at most 8 MB or one text. A null, empty or blank text has no words, no runs, and four nulls. Repeated rows
    each have a row; an existing column ``out`` is replaced, others pass through; an empty table gives an empty one.
    """
    scratch.bound_batches(docs.sparkSession)
    found = F.pandas_udf(_runs, RESULT)(F.col(text).cast("binary"))
    return docs.drop(out).withColumn(out, found)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+", -1), lambda w: w != "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in about one text in ten, for a test of the detector.

    With h the CRC-32 of the id as text, g = h div 10 and n words: if h is a multiple of 10, the words from a = g mod n on are replaced by the p = 1 + (n - a) div (3 + g mod 8)
    words from a on, repeated to the text's length. A null id leaves its text as it is; so does a text without words.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    marked = docs.withColumn("__w", F.when(h % 10 == 0, words_of(F.col(text))))
    n = F.size("__w").cast("long")
    marked = marked.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", (F.lit(1) + F.floor((n - F.col("__a")) / (g % 8 + 3))).cast("long"))
    root = F.slice("__w", (F.col("__a") + 1).cast("int"), F.col("__p").cast("int"))
    rest = n - F.col("__a")
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("__p")).cast("int"))), F.lit(1), rest.cast("int"))
    planted = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a").cast("int")), tail), " ")
    return marked.withColumn(text, F.when(F.col("__a").isNotNull(), planted).otherwise(F.col(text))).drop("__w", "__a", "__p")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with their runs cut to one period; a text without runs stays as it is, white space included. ``n_chars`` follows where the table has it."""
    mark = "__periodic"
    found = with_runs(docs, text, mark).withColumn(text, F.when(F.col(mark)["n_runs"] > 0, F.col(mark)["collapsed"]).otherwise(F.col(text))).drop(mark)
    return found.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else found

