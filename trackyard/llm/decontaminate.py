"""Operator 7: benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Bytes to bytes: A-Z lower-cased, other ASCII that is no letter or digit to a space, the rest unchanged.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
STATE = "struct<n: long, hit: binary, items: array<string>>"


def words(text: bytes | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of all other characters above ASCII."""
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Multi-pattern search over word sequences.

    Patterns are the distinct windows of the items: ``window`` consecutive words, or the whole item if it has fewer. Patterns of
    one length form a class. A class has a shift table over blocks of up to ``block`` words (how far the end of the
    search window may move when it ends in that block) and, for blocks that end a pattern, the bucket of patterns
    with that suffix, by their words; a comparison word by word confirms the one that the bucket selects. A pattern lists its items, however often each repeats it.
    """

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = 13, block: int = 3):
        self.classes: dict[int, tuple[int, dict, dict]] = {}
        one: dict[bytes, bytes] = {}
        for name, text in items:
            if not (found := [one.setdefault(w, w) for w in words(text)]):
                continue
            m = min(window, len(found))
            size, shift, bucket = self.classes.setdefault(m, (min(block, m), {}, {}))
            for start in range(len(found) - m + 1):
                # Blocks of the windows before have been entered with smaller steps, but for the last one of this window.
                for end in range(size, m + 1) if start == 0 else (m,):
                    key = tuple(found[start + end - size : start + end])
                    shift[key] = min(shift.get(key, m), m - end)
                owners = bucket.setdefault(tuple(found[start + m - size : start + m]), {}).setdefault(tuple(found[start : start + m]), [])
                if not owners or owners[-1] != name:
                    owners.append(name)

    def search(self, doc: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Mark in ``hit`` each word of ``doc`` inside an occurrence, and add the items found to ``items``."""
        for m, (size, shift, bucket) in self.classes.items():
            far, end, n = m - size + 1, m, len(doc)
            seen: set[int] = set()
            while end <= n:
                key = tuple(doc[end - size : end])
                step = shift.get(key, far)
                if step:
                    end += step
                    continue
                owners = bucket[key].get(tuple(doc[end - m : end]))
                if owners:
                    hit[end - m : end] = b"\1" * m
                    if id(owners) not in seen:
                        seen.add(id(owners))
                        items.update(owners)
                end += 1


def _searcher(sent, window: int):
    """For the blocks of items that are ``sent`` to the tasks. Tables of a single block are made once a task; of several, each is made for every batch of texts and then let go, so a task holds the tables of one."""

    @F.pandas_udf(STATE)
    def search(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        blocks = sent.value
        only = WuManber(blocks[0], window) if len(blocks) == 1 else None
        for texts, hits, names in parts:
            rows = []
            for text, old, known in zip(texts, hits, names, strict=True):
                doc = words(text)
                rows.append((doc, bytearray(old) if old is not None else bytearray(len(doc)), set(known) if known is not None else set()))
                if only:
                    only.search(*rows[-1])
                    rows[-1] = (len(doc), *rows[-1][1:])
            if not only:
                for block in blocks:
                    tables = WuManber(block, window)
                    for row in rows:
                        tables.search(*row)
                rows = [(len(doc), hit, items) for doc, hit, items in rows]
            yield pd.DataFrame([(n, bytes(hit), sorted(items)) for n, hit, items in rows], columns=["n", "hit", "items"])

    return search


def _verdict(state: Column) -> Column:
    @F.pandas_udf(RESULT)
    def verdict(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for counts, hits, names in parts:
            rows = []
            for n, hit, items in zip(counts, hits, names, strict=True):
                found = sum(hit)
                digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                rows.append((n, found, len(items), digest, found > 0 and 20 * found >= n))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return verdict(state["n"], state["hit"], state["items"])


def with_contamination(docs: DataFrame, benchmark: DataFrame, out: str = "contamination", text: str = "text", window: int = 13, block_bytes: int = 1 << 20, pass_blocks: int = 32) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, n_items, items_sha256, contaminated.

    ``benchmark`` (item_id, text) is cut in blocks of about ``block_bytes`` of text, dealt by hash of the item: one block
    in the usual case. A pass over the documents searches up to ``pass_blocks`` of them, which are sent to the tasks and searched one after the other in each batch of texts. A benchmark
    above that takes more passes, each of which adds to the hit words kept from the pass before, so any size of benchmark gives the whole result. No shuffle of documents.

    A null or empty text has no words: zero counts, the digest of no items, not contaminated. Items without words
    match nothing; a null item_id counts as the empty string; items that share an id count once. An existing column
    named ``out`` is replaced; all other columns pass through.
    """
    spark = docs.sparkSession
    scratch.bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("item"))
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    body = F.col(text).cast("binary")
    docs = docs.withColumn(out, F.lit(None).cast(STATE))
    passes = -(-blocks // pass_blocks)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "item"), F.lit(blocks)).cast("int"))
    for k in range(passes):
        own = range(k * pass_blocks, min(blocks, (k + 1) * pass_blocks))
        groups: dict[int, list] = {b: [] for b in own}
        for r in dealt.where(F.col("block").between(own[0], own[-1])).collect():
            groups[r["block"]].append((r["name"], bytes(r["item"]) if r["item"] is not None else None))
        sent = spark.sparkContext.broadcast(list(groups.values()))
        docs = docs.withColumn(out, _searcher(sent, window)(body, F.col(out)["hit"], F.col(out)["items"]))
        if k + 1 < passes:
            before = scratch.mark() - (k > 0)
            docs = scratch.save(docs, "decontaminate")
            scratch.drop_since(spark, before, docs)
            sent.unpersist()
    return docs.withColumn(out, _verdict(F.col(out)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    mark = "__contamination"
    return with_contamination(docs, benchmark, mark, **options).where(~F.col(mark)["contaminated"]).drop(mark)
