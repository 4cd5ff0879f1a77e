"""Operator 13: language identification by cross-parsing: how few phrases of a language's text a document needs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Training text: bytes of a sampled piece, most bytes for a language and for all together, documents that are drawn for a language (in the mean), languages learned.
PIECE, EACH, ALL, DRAWN, LANGUAGES = 1024, 48 << 10, 256 << 10, 300, 256
#: Bytes of a text that are parsed in one go; a phrase ends where they end.
STRETCH = 512
#: Stands between pieces of training text, and in no text that is parsed.
GAP = b"\n"
#: The answer where there is nothing to go by.
NONE = "und"

_others = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text in lower case, all that is no letter as one space, in UTF-8; empty if it has no letter."""
    found = _others.sub(" ", text.lower()).strip() if text else ""
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


# --- the automata -----------------------------------------------------------------------------------------------


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``: state 0 is the root, and the strings that can be read from it are those of the text."""
    steps: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
        last = new
    return steps


class Parser:
    """Phrases of texts in the words of each language, all texts and languages a byte at a time.

    A phrase is the longest string from here on that the language's text has, or one byte that it does not. Of a state and a byte the table has the state
    that follows, times the width of a row, times 4, plus the phrases that end: none while the automaton goes on, else one, and one more for a byte that the language lacks.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        used = sorted(set(b"".join(texts.values())) - set(GAP))
        self.code = np.full(256, len(used), np.int64)
        self.code[used] = range(len(used))
        width, base, tables, self.roots = len(used) + 1, 0, [], []
        for name in self.languages:
            steps = automaton(texts[name])
            table = np.zeros((len(steps), width), np.int32)
            root = base * width << 2
            table[:] = root + 2
            for c, to in steps[0].items():
                if c not in GAP:
                    table[:, self.code[c]] = ((base + to) * width << 2) + 1
            table[0, table[0] == root + 2] = root + 1
            from_ = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
            by = np.fromiter((c for s in steps for c in s), np.int64, len(from_))
            to = np.fromiter((t for s in steps for t in s.values()), np.int64, len(from_))
            real = by != GAP[0]
            table[from_[real], self.code[by[real]]] = (base + to[real]) * width << 2
            tables.append(table.ravel())
            self.roots.append(base * width)
            base += len(steps)
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        self.bits = np.log2(np.maximum(2, [len(texts[x]) for x in self.languages]))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by language and text: every text whole, in stretches."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        cuts = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(texts)), cuts)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * STRETCH
        left = np.minimum(STRETCH, sizes[of] - at)
        order = np.argsort(-left, kind="stable")
        start, left = (np.cumsum(sizes) - sizes)[of[order]] + at[order], left[order]
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(of), axis=1)
        ended = np.zeros((len(self.languages), len(of)), np.int32)
        width = np.searchsorted(-left, -np.arange(STRETCH), "left")  # stretches that have a byte at each place
        for t, n in enumerate(width):
            if not n:
                break
            step = self.table[state[:, :n] + codes[start[:n] + t]]
            ended[:, :n] += step & 3
            state[:, :n] = step >> 2
        ended += state != roots
        return np.stack([np.bincount(of[order], row, len(texts)) for row in ended])

    def best(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language that needs the fewest bits, and one less its share of the bits of the next one; ties go to the first by code point."""
        if not self.languages or not texts:
            return [NONE] * len(texts), np.zeros(len(texts))
        bits = self.phrases(texts) * self.bits[:, None]
        first = np.argmin(bits, axis=0)
        low = bits[first, np.arange(len(texts))]
        bits[first, np.arange(len(texts))] = np.inf
        known = np.fromiter((bool(t) for t in texts), bool, len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(known, 1 - low / bits.min(axis=0), 0.0)
        return [self.languages[k] if t else NONE for k, t in zip(first, texts, strict=True)], score


# --- the operator -----------------------------------------------------------------------------------------------


def is_held_out(id_col: str, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of ``folds``; that of a null id is that of an empty text, 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of training text with a number that orders them."""
    for batch in batches:
        for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            body = letters(text)
            for k in range(0, len(body), PIECE << 10):
                parts = [body[j : j + PIECE] for j in range(k, min(len(body), k + (PIECE << 10)), PIECE)]
                ranks = [xxhash.xxh64_intdigest(x) >> 1 for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(ranks, pa.int64()), pa.array(parts, pa.binary())], ["lang", "rank", "piece"])


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Training text by language: pieces of labelled documents in random, repeatable order.

    The bounds are parameters of this module. Some ``DRAWN`` documents of a language are drawn by a hash of id and text (equal rows are one), cut in pieces of ``PIECE`` bytes, and the
    pieces with the least hashes fill ``EACH`` bytes, or fewer where there are many languages: all together hold at most ``ALL``. The ``LANGUAGES`` most frequent labels are
    learned. Null texts and labels teach nothing; so does a text without letters. Rows of a language are counted and drawn where they lie, so a language of most rows is no hot group.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("u"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    each = min(EACH, ALL // len(counts)) // PIECE
    rates = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, DRAWN / r["count"]) * (1 << 62))) for r in counts], "lang string, most long")
    drawn = known.join(F.broadcast(rates), "lang").where(F.shiftrightunsigned("u", 2) <= F.col("most")).groupBy("lang", "u").agg(F.first("text").alias("text"))
    pieces = drawn.select("lang", "text").mapInArrow(_pieces, "lang string, rank long, piece binary").dropDuplicates(["lang", "rank"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    least = pieces.withColumn("n", order).where(F.col("n") <= max(1, each)).orderBy("lang", "n")
    found: dict[str, list[bytes]] = {}
    for r in least.collect():
        found.setdefault(r["lang"], []).append(bytes(r["piece"]))
    return {name: GAP.join(parts) for name, parts in found.items()}


_ready: list[tuple[dict, Parser]] = []


def parser(texts: dict[str, bytes]) -> Parser:
    """The parser of these texts; a worker keeps its last."""
    if not _ready or _ready[0][0] != texts:
        _ready[:] = [(texts, Parser(texts))]
    return _ready[0][1]


def with_language(docs: DataFrame, texts: dict[str, bytes], text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score.

    ``texts`` is training text by language, from :func:`learn`. A document's whole text, as lower-case letters and spaces, is parsed from left to right into the longest phrases that a language's
    text holds (stretches of ``STRETCH`` bytes, at whose ends phrases end). Phrases times log2 of the length of the language's text are its cross-parsing entropy; the
    least wins, the first name by code point if equal. ``score`` is one less the ratio of the least to the next (0: equal; 1: only one language is known). A null text, or one without a letter, is ``und`` with
    score 0, and so are all if no language is known. Rows are not shuffled. An existing column ``out`` is replaced, others pass through.
    """
    scratch.bound_batches(docs.sparkSession)

    def name(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = parser(texts)
        for batch in batches:
            langs, score = model.best([letters(t) for t in batch])
            yield pd.DataFrame({"lang": langs, "score": score})

    return docs.drop(out).withColumn(out, F.pandas_udf(name, "lang string, score double")(F.col(text)))
