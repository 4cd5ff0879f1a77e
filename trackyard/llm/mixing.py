"""Operator 10: mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackyard.llm import scratch
from trackyard.operators.prefix import running_sums

#: Most times that a source, and so a document, may be repeated.
MOST = 3


def words_in(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """Per source: source_size and its target, from rows (source, size).

    Sources in order of code points, null last, take ``weights`` in turn and share the sum of all sizes. No target is over ``most`` times its
    source's size; what is cut is shared again by weight until none is above. In closed form: with sources in order of size by
    weight, the cut ones come first, and the first source that stands its share of the rest ends them.
    Ranks and sums over sources are running sums, so many sources are no load of one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_sums(per, [F.col("source").asc_nulls_last()], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"w": weight, "cap": (most * F.col("source_size")).cast("double")}).withColumn("by", F.col("cap") / F.col("w"))
    sums = running_sums(ranked, [F.col("by"), F.col("source").asc_nulls_last()], {"caps": "cap", "ws": "w"})
    sums = scratch.save(sums.select("source", "source_size", "w", "cap", "by", "caps", "ws"), "mix-caps")
    total = sums.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("all_w"))
    # One row: the sums of all sources.
    levels = sums.crossJoin(F.broadcast(total)).withColumn("level", (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w"))))
    stands = levels.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("by", "level"))["level"].alias("stands"))
    share = F.coalesce(F.col("stands") * F.col("w"), F.col("cap"))
    return sums.crossJoin(F.broadcast(stands)).select("source", "source_size", F.least(F.col("cap"), share).alias("target"))


def expected_copies(classes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """Per (source, bits) of ``classes`` (with words): whole, the certain copies of a document, and p, the odds of one more; and of the source its target, source_size and rest.

    A document's expected copies are level * bits, bits being the binary digits of its number of words, and at most ``most``; the level is the
    one at which a source's expected words are its target. In closed form, as the longest classes reach ``most`` first. rest is the words expected of the last copies.
    The windows run over the classes of a source, of which there are at most 63.
    """
    down = Window.partitionBy("source").orderBy(F.desc("bits"))
    before = F.coalesce(F.sum(most * F.col("words")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("bits") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    own = classes.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    own = own.withColumn("level", (F.col("target") - before) / after)
    level = F.max(F.when(F.col("level") * F.col("bits") <= most, F.struct("bits", "level"))).over(Window.partitionBy("source"))["level"]
    own = own.withColumn("copies", F.least(F.lit(float(most)), F.coalesce(level * F.col("bits"), F.lit(float(most)))))
    own = own.withColumn("whole", F.floor(F.col("copies") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")).cast("double")
    return own.select("source", "bits", "source_size", "target", "whole", "p", rest.alias("rest"))


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 from the MD5 of a key: 48 bits, the same in every run and engine."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", out: str = "mix", buckets: int = 4096, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``out``: size, source_size, target, copies, taken (size times copies).

    A document's expected copies rise with the binary digits of its size (:func:`expected_copies`). The whole part is certain, the rest is its own inclusion
    probability p of one more. Documents of a source rank by Pareto's number, the odds u / (1 - u) of a random u over the odds p / (1 - p);
    the lowest ranks are taken while their words stay within the rest of the target (a document goes in if over half of it fits).
    So each source meets its target to within a document, whatever the draw.

    Ranks r become ``buckets`` equal cells of r / (1 + r) for each source, whose sizes are summed (one shuffle of sums); only the cell in which the target ends is ranked,
    one row for all rows that are equal in id and text. A hot source is thus spread over its cells. u comes from the id and the text, so reruns agree. Rows equal in
    id and text draw one number; where the target ends within them, as many of them go in as fit, the first in the order in which they were read.
    Null texts have size 0 and take nothing; a null source is the last source; an empty table gives an empty one. Rows are kept in the shared folder with their size and u, without
    the text unless ``keep_text``. An existing column ``out`` is replaced; names that begin with __ are for this function.
    """
    key = F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    docs = docs.drop(out)
    size = F.col("__size")
    wide = docs.withColumns({"__size": words_in(F.col(text)), "__u": uniform(key)}).withColumns({"__bits": F.length(F.bin(size)), "__tie": F.monotonically_increasing_id()})
    wide = scratch.save(wide if keep_text else wide.drop(text), "mix-rows")
    rows = wide.select(F.col(source).alias("source"), size.alias("size"), F.col("__u").alias("u"), F.col("__bits").alias("bits"), F.col("__tie").alias("tie"))
    classes = scratch.save(rows.groupBy("source", "bits").agg(F.sum("size").alias("words")), "mix-classes")
    goals = source_targets(classes.select("source", F.col("words").alias("size")), weights).where(F.col("source_size") > 0)
    # A row for each source and length in binary digits.
    plan = expected_copies(classes.where("words > 0"), goals)
    plan = scratch.lookup(plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns]), "mix-plan")

    def planned(df: DataFrame, source: Column, bits: Column) -> DataFrame:
        return df.join(plan, source.eqNullSafe(F.col("__p_source")) & (bits == F.col("__p_bits")), "left")

    rank = lambda u: u / (1 - u) / (F.col("__p_p") / (1 - F.col("__p_p")))
    cell = lambda q: F.floor(q / (1 + q) * buckets).cast("int")
    drawn = planned(rows.where("size > 0"), F.col("source"), F.col("bits")).where("__p_p > 0").withColumn("q", rank(F.col("u"))).withColumn("cell", cell(F.col("q"))).withColumnRenamed("__p_rest", "rest")
    sums = drawn.groupBy("source", "rest", "cell").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    ends = sums.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    # One row a source: the cell in which its target ends.
    ends = scratch.lookup(ends.select(F.col("source").alias("e_source"), F.col("cell").alias("e_cell"), F.col("before").alias("e_before")), "mix-ends")
    last = drawn.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("cell") == F.col("e_cell")))
    alike = last.groupBy("source", "q", "u", "size").agg(F.count("*").alias("n"), F.first("e_before").alias("e_before"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("q", "u", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("e_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(upto), F.lit(0))
    fits = F.least(F.col("n"), F.floor((F.col("rest") - before) / F.col("size") + 0.5))
    cuts = alike.withColumn("fits", fits).where("fits > 0").groupBy("source").agg(F.max(F.struct("q", "u", "size", "fits", "n")).alias("cut"))
    cuts = scratch.lookup(cuts.select(F.col("source").alias("c_source"), F.struct("cut.q", "cut.u", "cut.size").alias("cut"), "cut.fits", "cut.n"), "mix-cuts")
    # Where not all of a class of equal rows fit: the place of the last that does, by parts of the table, then within one part.
    tied = last.join(cuts.where("fits < n"), F.col("source").eqNullSafe(F.col("c_source")) & (F.struct("q", "u", "size") == F.col("cut"))).select("source", "tie", F.shiftright("tie", 33).alias("part"), "fits")
    parts = tied.groupBy("source", "fits", "part").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0))).where("start < fits AND start + n >= fits").select(F.col("source").alias("t_source"), F.col("part").alias("t_part"), "start")
    tied = tied.join(parts, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("part") == F.col("t_part")))
    tied = tied.withColumn("k", F.row_number().over(Window.partitionBy("source", "part").orderBy("tie"))).where("k = fits - start").select(F.col("source").alias("t_source"), F.col("tie").alias("__last"))
    edges = ends.join(cuts, F.col("e_source").eqNullSafe(F.col("c_source")), "left").join(tied, F.col("e_source").eqNullSafe(F.col("t_source")), "left")
    edges = scratch.lookup(edges.select(F.col("e_source").alias("__e_source"), F.col("e_cell").alias("__cell"), F.col("cut").alias("__cut"), "__last"), "mix-edges")

    found = planned(wide, F.col(source), F.col("__bits")).join(edges, F.col(source).eqNullSafe(F.col("__e_source")), "left")
    q = rank(F.col("__u"))
    own, c = F.struct(q.alias("q"), F.col("__u").alias("u"), size.alias("size")), F.col("__cell")
    first = (own < F.col("__cut")) | ((own == F.col("__cut")) & (F.col("__last").isNull() | (F.col("__tie") <= F.col("__last"))))
    one_more = F.when((F.col("__p_p") > 0) & ((cell(q) < c) | ((cell(q) == c) & F.coalesce(first, F.lit(False)))), F.lit(1)).otherwise(F.lit(0))
    copies = F.coalesce(F.when(size > 0, F.col("__p_whole") + one_more), F.lit(0)).cast("long")
    per = goals.select(F.col("source").alias("__g_source"), F.col("source_size").alias("__ss"), F.col("target").alias("__target"))
    found = found.join(scratch.lookup(per, "mix-goals"), F.col(source).eqNullSafe(F.col("__g_source")), "left")
    result = F.struct(
        size.alias("size"),
        F.coalesce(F.col("__ss"), F.lit(0)).cast("long").alias("source_size"),
        F.coalesce(F.col("__target"), F.lit(0.0)).alias("target"),
        copies.alias("copies"),
        (size * copies).alias("taken"),
    )
    return found.withColumn(out, result).select(*[F.col(f"`{x}`") for x in docs.columns if keep_text or x != text], out)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was taken, with its own columns."""
    mark = "__mix"
    taken = with_mix(docs, out=mark, **options).where(F.col(mark)["copies"] > 0)
    return taken.withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mark)["copies"]))).drop(mark)
