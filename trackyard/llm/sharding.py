"""Operator 4: shards balanced in bytes, words and rows by vector bin packing of groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackyard.llm import scratch

LAW = "bytes"
#: Bundles of small groups, by hash: (bundles, share of the hash range). The last ones are small, to even out what is left.
BUNDLES = ((1536, 900), (768, 90), (768, 10))


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: vectors in the order given go where the dot product with the residual capacity is highest.

    ``items`` (n, d) are in units of the totals; each shard's capacity is 1 / shards in each dimension. Ties go to the lower shard.
    """
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    place = np.empty(len(items), np.int32)
    for k, item in enumerate(items):
        best = int(np.argmax(left @ item))
        left[best] -= item
        place[k] = best
    return settle(items, place, left)


def settle(items: np.ndarray, place: np.ndarray, left: np.ndarray, moves: int = 5000) -> np.ndarray:
    """Move items from the shard with least to the one with most residual bytes while that brings all residuals nearer to 0, bytes counted eightfold."""
    scale = np.array([8.0] + [1.0] * (items.shape[1] - 1))
    size, left = items * scale, left * scale
    for _ in range(moves):
        full, free = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        own = np.flatnonzero(place == full)
        change = (size[own] ** 2).sum(axis=1) - size[own] @ (left[free] - left[full]) if len(own) else np.zeros(0)
        if not len(own) or change.min() > -1e-16:
            break
        k = own[int(np.argmin(change))]
        left[full] += size[k]
        left[free] -= size[k]
        place[k] = free
    return place


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __size, __crc, shard, slot) for each row of ``docs``.

    Groups of equal texts are the items. A group over a 16th of a shard in any dimension is split into parts by row, whatever the ids (it may hold a third of all
    rows, and they may all have one id); a group over a 512th of a shard is placed by itself; all others go into :data:`BUNDLES` by hash of the text. Thus the driver
    places at most some 40,000 vectors, whatever the size of the data: 3,072 bundles, and 3 dimensions x 24 x 512 groups and their parts, of which
    there cannot be more as each is over that share of a total. Largest first; bundles of the last, small class even out the rest.

    Slots: rows of a shard are dealt to cells by hash of the row, cells in order follow each other, rows of a cell are in order of id. No task holds more than one cell.

    A null text is as an empty one: 8 bytes, no words, one group with the empty texts. Null ids and repeated rows are rows like others, told apart by their place in the
    table kept in the shared folder. An empty table gives an empty one. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(body) + 8).cast("long").alias("__size"),
        F.crc32(body.cast("binary")).alias("__crc"),
        F.regexp_count(body, F.lit(r"[^ \t-\r]+")).cast("long").alias("__words"),
        F.xxhash64(body).alias("__group"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = scratch.save(rows, "shards-rows")
    groups = scratch.save(rows.groupBy("__group").agg(F.sum("__size").alias("b"), F.sum("__words").alias("w"), F.count("*").alias("n")), "shards-groups")
    total = groups.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "bwn"]).first()
    total = {x: max(1, total[x]) for x in "bwn"}
    share = F.greatest(*[F.col(x) / F.lit(float(total[x])) for x in "bwn"])
    groups = groups.withColumn("share", share)

    part = 1.0 / (16 * shards)
    large = groups.where(F.col("share") > part / 32)
    split = large.select("__group", F.ceil(F.greatest(F.lit(1.0), F.col("share") / part)).cast("int").alias("__parts"))
    n_rows = total["n"]
    # At most 3 * 512 * shards rows, since each has over 1 / (512 * shards) of one of three totals.
    rows = rows.join(F.broadcast(split), "__group", "left")
    bins = sum(n for n, _ in BUNDLES)
    point = F.pmod(F.xxhash64("__group", F.lit("bundle")), F.lit(1000 * 1536))
    bundle, low, first = None, 0, 0
    for n, width in BUNDLES:
        x = first + F.floor((point - low * 1536) * n / F.lit(width * 1536)).cast("long")
        bundle = F.when(point < (low + width) * 1536, x) if bundle is None else bundle.when(point < (low + width) * 1536, x)
        low, first = low + width, first + n
    item = F.when(F.col("__parts").isNull(), F.struct(bundle.alias("a"), F.lit(-1).cast("long").alias("p"))).otherwise(
        F.struct(F.col("__group").alias("a"), F.pmod(F.xxhash64("__row", "__group"), F.col("__parts").cast("long")).alias("p"))
    )
    rows = rows.withColumn("__item", item)
    items = rows.groupBy("__item").agg(F.sum("__size").alias("b"), F.sum("__words").alias("w"), F.count("*").alias("n")).collect()
    items.sort(key=lambda r: (-max(r[x] / total[x] for x in "bwn"), r["__item"]["p"], r["__item"]["a"]))
    place = pack(np.array([[r[x] / total[x] for x in "bwn"] for r in items], float).reshape(-1, 3), shards)
    table = [(r["__item"]["a"], r["__item"]["p"], int(s)) for r, s in zip(items, place, strict=True)]
    assert len(table) <= bins + 3 * shards * (512 + 16) + 3 * 512 * shards
    placed = spark.createDataFrame(table, "__a long, __p long, shard int")
    rows = rows.join(F.broadcast(placed), (F.col("__item")["a"] == F.col("__a")) & (F.col("__item")["p"] == F.col("__p")))

    cells = max(1, n_rows // (shards * 2000))
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("__row", "__group"), F.lit(cells)))
    counts = rows.groupBy("shard", "__cell").agg(F.count("*").alias("n"))
    run = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("n").over(run), F.lit(0)).cast("long").alias("__start"))
    within = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__id", "__group", "__row"))
    rows = rows.withColumn("__at", within).join(starts, ["shard", "__cell"])
    return rows.select("__id", "__size", "__crc", "__group", "shard", (F.col("__start") + F.col("__at") - 1).cast("long").alias("slot"))
