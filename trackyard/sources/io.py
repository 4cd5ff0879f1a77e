"""Readers and writers of event tables, training sets, scores, metric series and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackyard.functions import columns as C
from trackyard.functions.columns import shuffle_key
from trackyard.sources import tables

METRIC_FILE = "step long, wall_time double, value double"
NO_FOOTER = "no footer can be read"


def read_ntuples(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """A folder of chunked flat-column Parquet."""
    return spark.read.option("mergeSchema", str(merge).lower()).parquet(path)


def read_events(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Event files with the file and the row that each event came from: a key for tables without one. Paths must end in .parquet; a missing one is an error."""
    if wrong := [p for p in paths if not p.rstrip("/").endswith(".parquet")]:
        raise ValueError(f"not Parquet: {wrong}")
    df = spark.read.parquet(*paths)
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))


def write_events(df: DataFrame, path: str, by_sample: bool = False) -> None:
    """Nested records, a folder for each sample if asked for; never over what is there."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy("sample") if by_sample else writer).parquet(path)


def in_hash_buckets(df: DataFrame, seed: int | str, key: str = "event_id", buckets: int | None = None, first: Sequence[str] = ()) -> DataFrame:
    """``df`` in a seeded random order by one shuffle, without the sampling pass of a sort: partition k holds the k-th of ``buckets`` equal ranges of the key's hash.

    Hashes are even whatever the keys are, so the ranges need no sample, and rows are made once. Within a partition rows are sorted by ``first``, hash and key; written files are in order of name.
    A key that is there often has all its rows in one bucket: keys are meant to be unique.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The first 60 bits: their order is that of the hash, and a number sorts faster than its 32 digits.
    mark = F.conv(F.substring(shuffle_key(seed, F.col(key)), 1, 15), 16, 10).cast("long")
    bucket = F.shiftright(F.shiftright(F.col("__h"), 30) * n, 30).cast("int")
    return df.withColumn("__h", mark).repartitionById(n, bucket).sortWithinPartitions(*first, "__h", key).drop("__h")


def write_training_set(df: DataFrame, path: str, seed: int | str = 0, key: str = "event_id", buckets: int | None = None) -> DataFrame:
    """Train and test rows as nested Parquet by ``split``, those of each split in a seeded random order, and their counts as a table beside them, which is returned.

    Rows are dealt by :func:`in_hash_buckets` and sorted by split within each, so a bucket writes its part of every split in one pass. Files of a split follow each other in order of name;
    ``buckets`` beside them tells the rows of each.
    """
    split = F.coalesce("split", F.lit("none"))  # never null, so that the writer takes the column as it is
    rows = in_hash_buckets(df.withColumn("split", split), seed, key, buckets, ["split"])
    rows.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/rows")
    # Files without columns are counted by their footers.
    files = df.sparkSession.read.parquet(f"{path}/rows").groupBy("split", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    files.coalesce(1).write.mode("errorifexists").parquet(f"{path}/buckets")
    counts = df.sparkSession.read.parquet(f"{path}/buckets").groupBy("split").agg(F.sum("rows").alias("rows"))
    counts.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def write_masked(df: DataFrame, path: str, masks: Mapping[str, str]) -> DataFrame:
    """The rows of each named mask (name to boolean column) as a folder ``mask=name``, and the counts of mask and ``split`` beside them, which are returned. A row may be in several masks."""
    own = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in masks.items()]), lambda n: n.isNotNull()))
    df.withColumn("mask", own).write.mode("errorifexists").partitionBy("mask").parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("mask", "split").agg(F.count("*").alias("rows"))
    counts.coalesce(1).write.mode("errorifexists").parquet(f"{path}/counts")
    return df.sparkSession.read.parquet(f"{path}/counts")


def listing(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(path, n_bytes) of each file under the paths: a listing only, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return files.select("path", F.col("length").alias("n_bytes"))


def rename(spark: SparkSession, path: str, target: str) -> None:
    """Move a file within its store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {path} to {target}")


def _even_limit(sizes: list[int], groups: int) -> int:
    """The bytes of a partition at which Spark's packing of these files (pieces of large ones, largest first, one partition after the other) needs no more than ``groups``; the first such from an even share on."""
    total = sum(sizes)
    share, step = -(-total // groups), max(1, total // max(1, 8 * len(sizes)))
    for limit in range(share, total + step, step):
        pieces = sorted((min(limit, n - k) for n in sizes for k in range(0, n, limit)), reverse=True)
        used, held = 1, 0
        for n in pieces:
            if held + n > limit:
                used, held = used + 1, 0
            held += n
        if used <= groups:
            return limit
    return total


def compact_folder(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20) -> int:
    """The files of a folder as larger ones of about ``target_bytes`` each, under the schema that Spark reads from the folder; returns how many there are.

    The bytes of the listed files are shared evenly over as many groups as they need, and Spark packs whole small files, and row groups of large ones, into a partition for each group. So a task reads its group and writes one file, and no
    row is shuffled. The driver sees a size for each file. The packing is set in a session of its own, which has the caller's other settings. Rows of a file stay in order.
    """
    sizes = [r["n_bytes"] for r in listing(spark, source, "*.parquet").select("n_bytes").collect()]
    groups = max(1, round(sum(sizes) / target_bytes))
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in {"files.maxPartitionBytes": max(1, _even_limit(sizes, groups)), "files.openCostInBytes": 0, "files.minPartitionNum": 1, "adaptive.enabled": "false"}.items():
        own.conf.set(f"spark.sql.{key}", str(value))
    own.read.option("mergeSchema", "false").parquet(source).write.mode("errorifexists").parquet(target)
    return listing(spark, target, "*.parquet").count()


def standardize_schema(df: DataFrame) -> DataFrame:
    """Array columns with nullable elements and the common element name, so that files agree."""

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType), True)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType), True) for f in t])
        return t

    return df.select(*[F.col(f"`{f.name}`").cast(plain(f.dataType)).alias(f.name) for f in df.schema])


def merge_shards(shards: Sequence[DataFrame], strict: bool = True, fixed: Sequence[str] = (), seed: str | None = None) -> DataFrame:
    """Shards one after the other. Strict: missing or extra columns and other types are errors; arrays of ``fixed`` columns must have one length over all shards, else a row is an error."""
    first = {f.name: f.dataType for f in shards[0].schema}
    for k, s in enumerate(shards[1:], 1):
        own = {f.name: f.dataType for f in s.schema}
        if strict and (missing := set(first) - set(own)):
            raise ValueError(f"shard {k} lacks {sorted(missing)}")
        if strict and (extra := set(own) - set(first)):
            raise ValueError(f"shard {k} also has {sorted(extra)}")
        if other := [c for c in first if c in own and own[c].simpleString() != first[c].simpleString()]:
            raise ValueError(f"shard {k} has other types in {other}")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=not strict)
    for c in fixed:
        n = shards[0].agg(F.max(F.size(c))).first()[0]
        out = out.withColumn(c, F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs in length"))))
    return out if seed is None else out.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.to_json(F.struct(*out.columns)))))


def read_metric_series(spark: SparkSession, path: str) -> DataFrame:
    """Per-tag CSV files (step, wall_time, value); the tag comes from the file's name, '__' read as '/'."""
    df = spark.read.schema(METRIC_FILE).option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"tag=([^/]+)/", 1).alias("__folder"), C.tag_of_file(F.col("_metadata.file_path")).alias("__file"), "*").select(
        F.when(F.col("__folder") != "", F.replace(F.url_decode("__folder"), F.lit("__"), F.lit("/"))).otherwise(F.col("__file")).alias("tag"), "step", "wall_time", "value"
    )


def write_metric_series(df: DataFrame, path: str) -> None:
    """A CSV folder for each tag, rows in order of step and time over its files in order of name, and a JSON summary of the tags.

    Rows are range-partitioned by tag, step and time: small tags share a task, and a tag of most rows is many tasks and files.
    """
    rows = df.select(C.file_of_tag(F.col("tag")).alias("tag"), "step", "wall_time", "value")
    order = ("tag", "step", "wall_time", "value")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", True).partitionBy("tag").csv(f"{path}/series")
    summary = df.groupBy("tag").agg(F.count("*").alias("n"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))
    summary.coalesce(1).write.mode("errorifexists").json(f"{path}/summary")


def write_scored_events(df: DataFrame, path: str, collections: Sequence[str], derived: Sequence[str]) -> None:
    """Collections, scores and derived scores as one nested table."""
    df.select("event_id", *collections, "scores", F.struct(*derived).alias("outputs")).write.mode("errorifexists").parquet(path)


def _schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a Parquet file, by its footer; None if it has none that can be read."""
    try:
        return spark.read.parquet(path).schema
    except (PySparkException, Py4JJavaError):
        return None


def file_health(spark: SparkSession, root: str) -> DataFrame:
    """(file, n_bytes, ok, n_rows, n_read, error) of each Parquet file under ``root``: all that are bad, not only the first.

    Footers tell the rows that a file should have (a scan without columns); a scan of all columns that skips what it can't read tells how many it gives. Both are jobs over all files, and a row a file is left.
    Files that give no row at all are empty or have no footer: their footers are tried one by one. A file with fewer rows read than its footer says has a bad page. Columns are those of the first file that
    has a footer; other columns of other files are not looked at.
    """
    files = listing(spark, root, "*.parquet")
    same = lambda c: F.regexp_replace(F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    schema = next((x for r in files.orderBy("path").toLocalIterator() if (x := _schema(spark, r["path"])) is not None), None)
    if schema is None:
        return files.select(F.col("path").alias("file"), "n_bytes", F.lit(False).alias("ok"), F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("n_read"), F.lit(NO_FOOTER).alias("error"))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    at = F.col("_metadata.file_path").alias("p")
    told = rows.groupBy(at).agg(F.count("*").alias("n_rows"))
    # A hash of all columns: every page is decoded.
    read = rows.select(at, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("h")).groupBy("p").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"))
    counts = told.join(read.select("p", F.when(F.col("h").isNotNull(), F.col("n")).alias("n_read")), "p", "left").withColumn("f", same("p"))
    both = tables.cut(files.withColumn("f", same("path")).join(counts, "f", "left").select("path", "n_bytes", "n_rows", "n_read"))
    empty = [(r["path"], 0) for r in both.where("n_rows IS NULL").toLocalIterator() if _schema(spark, r["path"]) is not None]
    both = both.join(F.broadcast(spark.createDataFrame(empty, "path string, none long")), "path", "left").withColumns({c: F.coalesce(c, "none") for c in ("n_rows", "n_read")}) if empty else both
    ok = F.coalesce(F.col("n_read") == F.col("n_rows"), F.lit(False))
    error = F.when(F.col("n_rows").isNull(), F.lit(NO_FOOTER)).when(~ok, F.concat(F.coalesce("n_read", F.lit(0)).cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows can be read")))
    return both.select(F.col("path").alias("file"), "n_bytes", ok.alias("ok"), "n_rows", "n_read", error.alias("error"))


def dataset_health(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(dataset, ok, n_files, n_bad, n_rows, error) of each folder: whether all its files can be read to the end, and the first error in order of name. :func:`file_health` lists them all."""
    found = None
    for root in roots:
        try:
            files = file_health(spark, root)
        except AnalysisException as e:
            files = spark.createDataFrame([(None, False, None, str(e).splitlines()[0][:200])], "file string, ok boolean, n_rows long, error string")
        first = F.min(F.when(~F.col("ok"), F.struct("file", "error")))["error"]
        own = files.groupBy(F.lit(root).alias("dataset")).agg(F.every("ok").alias("ok"), F.count("file").alias("n_files"), F.count_if(~F.col("ok")).alias("n_bad"), F.sum(F.when(F.col("ok"), F.col("n_rows"))).alias("n_rows"), first.alias("error"))
        found = own if found is None else found.unionByName(own)
    return found


def _counted(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, rows, before) of the Parquet files of ``path`` in order of name, by their footers (a scan without columns), with the rows of the files before each: a row a file."""
    counts = spark.read.parquet(*([path] if isinstance(path, str) else path)).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.where("rows > 0").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def _placed(spark: SparkSession, path: str | Sequence[str]):
    """A reader of some of the files of ``path``, with ``path`` and ``row_index`` of each row; none gives an empty table."""
    paths = [path] if isinstance(path, str) else list(path)
    schema = spark.read.parquet(*paths).schema
    base = {} if len(paths) > 1 else {"basePath": paths[0]}

    def read(files: Sequence[str]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], schema).select("*", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("row_index"))
        rows = spark.read.schema(schema).options(**base).parquet(*map(unquote, files))
        return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))

    return read


def first_rows(spark: SparkSession, path: str | Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows over the Parquet files of ``path`` in order of name, with ``path`` and ``row_index``; files beyond the budget are not opened.

    Footers give the rows of each file; their running sum tells the files that are needed. Those before the last are read whole, and of the last the rows
    up to the end of the budget. The driver gets the names of the files that are read, as any reader does.
    """
    read = _placed(spark, path)
    needed = _counted(spark, path).where(F.col("before") < n).orderBy("file").collect()
    if not needed:
        return read([])
    cut = read([needed[-1]["file"]]).where(F.col("row_index") < n - needed[-1]["before"])
    return read([r["file"] for r in needed[:-1]]).unionByName(cut) if len(needed) > 1 else cut


def first_kept(spark: SparkSession, path: str | Sequence[str], n: int, keep: Column) -> DataFrame:
    """The first ``n`` rows that ``keep`` holds for, over files in order of name as in :func:`first_rows`; files beyond those are not opened.

    How many rows of a file are kept only its rows tell, so files are counted in runs: as many as have ``n`` rows, then twice as many rows, until enough are kept. A count reads the columns of ``keep`` alone,
    and no file twice. Of the file in which the budget ends, row numbers are ranked: one file's numbers, whatever the size of the table.
    """
    read, files = _placed(spark, path), _counted(spark, path).orderBy("file").collect()
    kept, whole, at, budget = 0, [], 0, n
    while at < len(files) and kept < n:
        run = [r["file"] for r in files[at:] if r["before"] < files[at]["before"] + budget]
        counts = {r["path"]: r["kept"] for r in read(run).where(keep).groupBy("path").agg(F.count("*").alias("kept")).collect()}
        for name in run:
            if kept + counts.get(name, 0) > n:
                last = read([name]).where(keep)
                end = last.select("row_index").orderBy("row_index").limit(n - kept).agg(F.max("row_index")).first()[0]
                cut = last.where(F.col("row_index") <= (-1 if end is None else end))
                return read(whole).where(keep).unionByName(cut) if whole else cut
            kept += counts.get(name, 0)
            whole.append(name)
        at, budget = at + len(run), 2 * budget
    return read(whole).where(keep)


def capped_sources(spark: SparkSession, sources: Mapping[str, str | Sequence[str]], fractions: Mapping[str, float], keep: Column, column: str = "source") -> DataFrame:
    """Of each source (name to files) the first int(fraction * raw rows) rows that ``keep`` holds for, with the source's name in ``column``. Sources without a fraction are whole; raw rows are those of the footers."""
    out = None
    for name, path in sources.items():
        if name in fractions:
            raw = _counted(spark, path).agg(F.sum("rows")).first()[0] or 0
            rows = first_kept(spark, path, raw * round(fractions[name] * 1_000_000) // 1_000_000, keep)
        else:
            rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).where(keep).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
        rows = rows.withColumn(column, F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small table of statistics as one JSON or CSV file."""
    writer = df.coalesce(1).write.mode("errorifexists")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
