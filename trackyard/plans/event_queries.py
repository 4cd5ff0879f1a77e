"""Queries of sources and sinks, event building, tensors, filters, order and set operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators import build, order, select, stats, tensors
from trackyard.operators.prefix import running_sums
from trackyard.plans import views as V
from trackyard.plans.register import register
from trackyard.sources import io, tables

JETS, EV, PER, TGT, SC, MET = V.JETS, V.EV, V.PER, V.TGT, V.SC, V.MET
r6 = lambda c, n=None: F.round(F.col(c) if isinstance(c, str) else c, 7).alias(n or c)
CAP = 8


def _elements(df, *keep):
    """A row for each jet of flat columns, to compare contents."""
    zipped = F.posexplode(F.arrays_zip(F.col("JetGood_pt").alias("pt"), F.col("JetGood_prov").alias("prov")))
    return df.select("event_id", *keep, zipped.alias("pos", "j")).select("event_id", *keep, "pos", r6("j.pt", "pt"), "j.prov")


def _flat(spark, d):
    """Flat ntuple columns: an array for each jet field, one event a row."""
    n = V.nested(spark, d)
    return n.select("event_id", "sample", "weight", *[F.col(f"jets.{f}").alias(f"JetGood_{f}") for f in ("pt", "eta", "phi", "prov")])


# --- sources and sinks


@register("s1_read_ntuples", V.sql("SELECT event_id, njet AS jets FROM per", JETS, EV, PER))
def s1(spark, d):
    path = tables.workspace(spark)
    _flat(spark, d).write.parquet(path)
    return io.read_ntuples(spark, path).select("event_id", F.size("JetGood_pt").alias("jets"))


@register("s2_read_events", "SELECT o_orderkey AS event_id, CAST(1 AS BIGINT) AS keys, TRUE AS named FROM orders")
def s2(spark, d):
    rows = io.read_events(spark, [f"{d}/orders.parquet"])
    keys = rows.groupBy("path", "row_index").agg(F.count("*").alias("keys"), F.min("o_orderkey").alias("event_id"))
    return keys.select("event_id", "keys", F.col("path").endswith(".parquet").alias("named"))


@register("s3_write_events", V.sql("SELECT event_id, sample, njet AS jets FROM per", JETS, EV, PER))
def s3(spark, d):
    path = tables.workspace(spark)
    io.write_events(V.nested(spark, d), path, by_sample=True)
    return spark.read.parquet(path).select("event_id", "sample", F.size("jets.pt").alias("jets"))


def _placed(rows, groups=()):
    """Rows read from files with their place in them, from 1: files in order of name, then rows."""
    rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"), F.lit(1).cast("long").alias("__one"))
    return running_sums(rows, [F.col("__file"), F.col("__row")], {"place": "__one"}, list(groups)).drop("__file", "__row", "__one")


SPLIT = "spl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sample ORDER BY event_id) <= (count(*) OVER (PARTITION BY sample)) * 800000 // 1000000 THEN 'train' ELSE 'test' END AS split FROM ev)"


def _training(spark, d):
    n = tensors.assign_targets(V.nested(spark, d), CAP)
    n = tensors.object_features(n, {"Jet": ["pt", "eta", "phi", "MASK"], "Event": ["ht"]}, CAP)
    return tensors.training_row(tensors.classification_columns(n, ["signal", "dctr"]), keep=["sample"])


@register("s4_write_training_set", V.sql("SELECT event_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('7-' || CAST(event_id AS VARCHAR)), event_id) AS place, count(*) OVER (PARTITION BY split) AS rows FROM spl", EV, SPLIT))
def s4(spark, d):
    rows = order.train_test_split(_training(spark, d), "sample", keys=V.events(spark, d).select("sample", "event_id"))
    path = tables.workspace(spark)
    counts = io.write_training_set(rows, path, seed=7)
    return _placed(spark.read.parquet(f"{path}/rows").select("event_id", "split", "_metadata"), ["split"]).join(counts, "split").select("event_id", "split", "place", "rows")


@register("s5_compact_folder", V.sql("SELECT count(*) AS events, ROUND(sum(weight), 7) AS weight FROM ev", EV))
def s5(spark, d):
    a, b = tables.workspace(spark), tables.workspace(spark)
    V.events(spark, d).repartition(12).write.parquet(a)
    io.compact_folder(spark, a, b)
    return spark.read.parquet(b).agg(F.count("*").alias("events"), r6(F.sum("weight"), "weight"))


@register("s5_compact_by_bytes", V.sql("SELECT event_id, sample, ROUND(weight, 7) AS weight, 4 AS files, TRUE AS even FROM ev", EV))
def s5_bytes(spark, d):
    """All rows after 40 files have become four, and whether each has the mean size to within 20 %."""
    a, b = tables.workspace(spark), tables.workspace(spark)
    V.events(spark, d).repartition(40, "event_id").write.parquet(a)
    total = io.listing(spark, a, "*.parquet").agg(F.sum("n_bytes")).first()[0]
    files = io.compact_folder(spark, a, b, -(-total // 4))
    size = io.listing(spark, b, "*.parquet").agg(((F.max("n_bytes") <= 1.2 * F.avg("n_bytes")) & (F.min("n_bytes") >= 0.8 * F.avg("n_bytes"))).alias("even"))
    return spark.read.parquet(b).select("event_id", "sample", r6("weight"), F.lit(files).alias("files")).crossJoin(F.broadcast(size))


@register("s6_standardize_schema", V.sql("SELECT count(*) AS events, CAST(2 * sum(njet) AS BIGINT) AS jets FROM per WHERE event_id % 2 = 0 UNION ALL SELECT count(*), CAST(sum(njet) AS BIGINT) FROM per WHERE event_id % 2 = 1", JETS, EV, PER))
def s6(spark, d):
    n = _flat(spark, d)
    even, odd = n.where("event_id % 2 = 0"), n.where("event_id % 2 = 1").withColumn("JetGood_pt", F.coalesce("JetGood_pt", F.array(F.lit(0.0))))
    both = order.union_events(io.standardize_schema(even), io.standardize_schema(odd))
    return both.groupBy((F.col("event_id") % 2).alias("k")).agg(F.count("*").alias("events"), F.sum(F.size("JetGood_pt") * F.when(F.col("event_id") % 2 == 0, 2).otherwise(1)).alias("jets")).drop("k")


@register("s6_standard_rows", V.sql("SELECT event_id, pos, ROUND(CAST(pt AS DOUBLE), 7) AS pt, prov FROM jets", JETS))
def s6_rows(spark, d):
    """Files of two schemas, one without nulls in its arrays, one with, under one schema: all their jets."""
    n, path = _flat(spark, d), tables.workspace(spark)
    io.standardize_schema(n.where("event_id % 2 = 0")).write.parquet(f"{path}/k=0")
    odd = n.where("event_id % 2 = 1").withColumn("JetGood_pt", F.transform("JetGood_pt", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))
    io.standardize_schema(odd.withColumn("JetGood_pt", F.col("JetGood_pt").cast(n.schema["JetGood_pt"].dataType))).write.parquet(f"{path}/k=1")
    return _elements(io.read_ntuples(spark, path))


@register("s7_merge_shards", V.sql("SELECT ev.event_id, 8 AS width, ROUND(coalesce(sum(pt), 0), 4) AS total FROM ev LEFT JOIN jets ON ev.event_id = jets.event_id AND pos < 8 GROUP BY ev.event_id", JETS, EV))
def s7(spark, d):
    rows = V.nested(spark, d).select("event_id", C.pad_clip(F.col("jets.pt"), CAP, 0.0).alias("pt"))
    merged = io.merge_shards([rows.where("event_id % 3 = 0"), rows.where("event_id % 3 > 0")], fixed=["pt"])
    return merged.select("event_id", F.size("pt").alias("width"), F.round(C.total(F.col("pt")), 4).alias("total"))


def _series(spark, d):
    path = tables.workspace(spark)
    io.write_metric_series(V.metrics(spark, d), path)
    return path


@register("s8_read_metric_series", V.sql("SELECT tag, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps, ROUND(sum(value), 4) AS total FROM met GROUP BY tag", MET))
def s8(spark, d):
    rows = io.read_metric_series(spark, f"{_series(spark, d)}/series")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.round(F.sum("value"), 4).alias("total"))


@register("s9_write_metric_series", V.sql("SELECT tag, count(*) AS n, min(step) AS min_step, max(step) AS max_step FROM met GROUP BY tag", MET))
def s9(spark, d):
    return spark.read.schema("tag string, n long, min_step long, max_step long").json(f"{_series(spark, d)}/summary")


@register("s9_series_order", V.sql("SELECT tag, step, ROUND(wall_time, 6) AS wall_time, ROUND(value, 7) AS value, row_number() OVER (PARTITION BY tag ORDER BY step, wall_time, value) AS place FROM met", MET))
def s9_order(spark, d):
    """Every row of every tag with its place over the files of its tag in order of name."""
    path = _series(spark, d)
    rows = spark.read.schema("step long, wall_time double, value double, tag string").option("header", True).csv(f"{path}/series")
    lines = rows.select("tag", "step", "wall_time", "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    counted = running_sums(lines.withColumn("one", F.lit(1).cast("long")), [F.col("file"), F.col("at"), F.col("line")], {"place": "one"}, ["tag"])
    return counted.select("tag", "step", F.round("wall_time", 6).alias("wall_time"), r6("value"), "place")


@register("s10_write_scored_events", V.sql("SELECT count(*) AS events, ROUND(sum(tthbb/(tthbb+ttbb+1e-6::DOUBLE)), 4) AS derived FROM wide", EV, SC))
def s10(spark, d):
    path = tables.workspace(spark)
    io.write_scored_events(tensors.derived_scores(V.wide(spark, d)), path, ["sample"], ["tthbb_vs_ttbb", "tthbb_vs_qcd_ttbb"])
    return spark.read.parquet(path).agg(F.count("*").alias("events"), F.round(F.sum("outputs.tthbb_vs_ttbb"), 4).alias("derived"))


@register("s10_scored_rows", V.sql("SELECT event_id, sample, ROUND(tthbb, 7) AS tthbb, 10 AS classes, ROUND(tthbb/(tthbb+ttbb+1e-6::DOUBLE), 7) AS derived FROM wide", EV, SC))
def s10_rows(spark, d):
    path = tables.workspace(spark)
    io.write_scored_events(tensors.derived_scores(V.wide(spark, d)), path, ["sample"], ["tthbb_vs_ttbb"])
    return spark.read.parquet(path).select("event_id", "sample", r6(F.get("scores", F.lit(1)), "tthbb"), F.size("scores").alias("classes"), r6("outputs.tthbb_vs_ttbb", "derived"))


@register("s11_dataset_health", "SELECT 'orders' AS dataset, TRUE AS ok, count(*) AS n_rows FROM orders UNION ALL SELECT 'nothing', FALSE, NULL")
def s11(spark, d):
    found = io.dataset_health(spark, [f"{d}/orders.parquet", f"{d}/nothing.parquet"])
    return found.select(F.regexp_extract("dataset", r"(\w+)\.parquet$", 1).alias("dataset"), "ok", "n_rows")


@register("s11_file_health", "SELECT TRUE AS ok, 4 AS files, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM orders UNION ALL SELECT FALSE, 2, NULL, 'no footer can be read'")
def s11_files(spark, d):
    """A folder of four good files and two that are no Parquet: all six are told."""
    path = tables.workspace(spark)
    orders = V.table(spark, d, "orders")
    orders.repartition(4).write.parquet(f"{path}/good")
    made = orders.select(F.col("o_orderkey").cast("string")).repartition(2)
    made.write.text(f"{path}/texts")
    for k, name in enumerate(sorted(r["path"] for r in io.listing(spark, f"{path}/texts", "*.txt").collect())):
        io.rename(spark, name, f"{path}/bad-{k}.parquet")
    found = io.file_health(spark, path).groupBy("ok").agg(F.count("*").cast("int").alias("files"), F.sum("n_rows").alias("n_rows"), F.max("error").alias("error"))
    return found.select("ok", "files", "n_rows", "error")


@register("s12_write_report", V.sql("SELECT sample, count(*) AS events FROM ev GROUP BY sample", EV))
def s12(spark, d):
    path = tables.workspace(spark)
    io.write_report(V.events(spark, d).groupBy("sample").agg(F.count("*").alias("events")), path)
    return spark.read.schema("sample string, events long").json(path)


# --- event building


@register("p1_select_features", V.sql("SELECT event_id, ROUND(sum(pt), 7) AS pt, ROUND(sum(eta), 7) AS rapidity FROM jets GROUP BY event_id", JETS))
def p1(spark, d):
    flat = build.select_features(_flat(spark, d), {"JetGood": {"pt": "pt", "eta": "eta"}}, {"JetGood": {"rapidity": "eta"}})
    return flat.where(F.size("JetGood_pt") > 0).select("event_id", r6(C.total(F.col("JetGood_pt")), "pt"), r6(C.total(F.col("JetGood_rapidity")), "rapidity"))


@register("p2_first_existing", V.sql("SELECT prov, count(*) AS n FROM jets GROUP BY prov", JETS))
def p2(spark, d):
    flat = _flat(spark, d)
    return flat.select(F.explode(build.first_existing(flat, ["JetGoodMatched_provenance", "JetGood_prov"])).alias("prov")).groupBy("prov").agg(F.count("*").alias("n"))


@register("p3_pad_fields", V.sql("SELECT event_id, njet, CAST(0 AS DOUBLE) AS mass FROM per", JETS, EV, PER))
def p3(spark, d):
    flat = build.pad_fields(_flat(spark, d), "JetGood", {"m": 0.0}, "pt")
    return flat.select("event_id", F.size("JetGood_m").alias("njet"), C.total(F.col("JetGood_m")).alias("mass"))


@register("p4_zip_collection", V.sql("SELECT event_id, pos, ROUND(pt, 7) AS pt, prov FROM jets", JETS))
def p4(spark, d):
    z = build.zip_collection(_flat(spark, d), "JetGood", ["pt", "prov"])
    return z.select("event_id", F.posexplode("JetGood").alias("pos", "j")).select("event_id", "pos", r6("j.pt", "pt"), "j.prov")


@register("p5_nest_objects", V.sql("SELECT event_id, njet, ROUND(ht, 7) AS ht FROM per", JETS, EV, PER))
def p5(spark, d):
    return V.nested(spark, d).select("event_id", F.size("jets.pt").alias("njet"), r6(C.total(F.col("jets.pt")), "ht"))


@register("p6_to_singleton", V.sql("SELECT event_id, ROUND(pt, 7) AS pt FROM jets WHERE pos = 0", JETS))
def p6(spark, d):
    one = order.leading_k(select.min_jets(V.nested(spark, d), 1), 1)
    return build.to_singleton(one, "jets").select("event_id", r6("jets.pt", "pt"))


@register("p7_attach_matching", V.sql("SELECT event_id, pos, prov > 0 AS matched, CASE WHEN prov > 0 THEN prov ELSE -1 END AS prov FROM jets", JETS))
def p7(spark, d):
    n = V.nested(spark, d)
    matched = F.transform("jets", lambda j: F.struct(F.when(j["prov"] > 0, j["pt"]).otherwise(F.lit(float(build.UNMATCHED))).alias("pt"), j["prov"].alias("prov")))
    n = build.attach_matching(n.withColumn("matched", matched))
    return n.select("event_id", F.posexplode("jets").alias("pos", "j")).select("event_id", "pos", "j.matched", "j.prov")


SUMS = "sums AS (SELECT sample AS dataset, sum(abs(weight)) AS value FROM ev GROUP BY sample)"


@register("p8_normalize_genweights", V.sql("SELECT event_id, ROUND(CASE WHEN sample LIKE 'DATA%' THEN weight ELSE weight / value END, 9) AS weight FROM ev JOIN sums ON sample = dataset", EV, SUMS))
def p8(spark, d):
    e = V.events(spark, d)
    sums = e.groupBy(F.col("sample").alias("dataset")).agg(F.sum(F.abs("weight")).alias("value"))
    return build.normalize_genweights(e.withColumn("dataset", F.col("sample")), sums).select("event_id", F.round("weight", 9).alias("weight"))


@register("p9_assemble_event", V.sql("SELECT event_id, ROUND(weight, 7) AS weight, njet FROM per", JETS, EV, PER))
def p9(spark, d):
    return build.assemble_event(V.nested(spark, d), ["jets"], {"event": ["weight"], "metadata": ["year"]}).select("event_id", r6("event.weight", "weight"), F.size("jets.pt").alias("njet"))


PATH = "'/store/' || year || '/' || sample || '/part.parquet'"


def _paths(spark, d):
    return V.events(spark, d).select("event_id", F.concat(F.lit("/store/"), "year", F.lit("/"), "sample", F.lit("/part.parquet")).alias("path"))


@register("p10_source_sample", V.sql("SELECT event_id, sample FROM ev", EV))
def p10(spark, d):
    return build.source_sample(_paths(spark, d), V.SAMPLES).select("event_id", "sample")


@register("p11_source_year", V.sql("SELECT event_id, year FROM ev", EV))
def p11(spark, d):
    return build.source_year(_paths(spark, d)).select("event_id", "year")


@register("p12_build_labels", V.sql("SELECT event_id, CAST(sample = 'TTH_Hto2B' AS INT) AS tthbb, CAST(sample LIKE 'TTto4Q%' AS INT) AS ttlight, CAST(sample = 'QCD' AS INT) AS qcd FROM ev", EV))
def p12(spark, d):
    labels = {"tthbb": ["TTH_Hto2B"], "ttlight": ["TTto4Q_ttLF", "TTto4Q_ttC"], "qcd": ["QCD"]}
    return build.build_labels(V.events(spark, d), labels).select("event_id", *labels)


@register("p13_encode_class", V.sql("SELECT event_id, signal FROM ev", EV))
def p13(spark, d):
    codes = {s: k for k, s in enumerate(V.SAMPLES, 1)}
    return build.encode_class(V.events(spark, d).drop("signal"), {"signal": codes}).select("event_id", "signal")


@register("p14_scale_weights", V.sql("SELECT event_id, ROUND(weight * CASE sample WHEN 'QCD' THEN -1.0 WHEN 'TTH_Hto2B' THEN 0.5 ELSE 1.0 END, 9) AS weight FROM ev", EV))
def p14(spark, d):
    factors = {s: 1.0 for s in V.SAMPLES} | {"QCD": -1.0, "TTH_Hto2B": 0.5}
    return build.scale_weights(V.events(spark, d), factors).select("event_id", F.round("weight", 9).alias("weight"))


@register("p15_default_weight", V.sql("SELECT sample, CAST(count(*) AS DOUBLE) AS weight FROM ev GROUP BY sample", EV))
def p15(spark, d):
    return build.default_weight(V.events(spark, d).drop("weight")).groupBy("sample").agg(F.sum("weight").alias("weight"))


@register("p16_btag_collection", V.sql("SELECT event_id, nb, ROUND(weight, 7) AS weight_original FROM per", JETS, EV, PER))
def p16(spark, d):
    return build.btag_collection(V.nested(spark, d)).select("event_id", F.size("bjets").alias("nb"), r6("weight_original"))


# --- tensors


PAD = f"slots AS (SELECT event_id, p AS pos FROM ev, (SELECT unnest(range({CAP})) AS p)), padded AS (SELECT s.event_id, CAST(s.pos AS INT) AS pos, coalesce(j.pt, 0) AS pt, coalesce(j.eta, 0) AS eta, coalesce(j.phi, 0) AS phi FROM slots s LEFT JOIN jets j ON s.event_id = j.event_id AND s.pos = j.pos)"


@register("t1_pad_clip", V.sql("SELECT event_id, pos, ROUND(pt, 7) AS pt FROM padded", JETS, EV, PAD))
def t1(spark, d):
    n = V.nested(spark, d).select("event_id", C.pad_clip(F.col("jets.pt"), CAP, 0.0).alias("pt"))
    return n.select("event_id", F.posexplode("pt").alias("pos", "pt")).select("event_id", "pos", r6("pt"))


@register("t2_mask_from_pt", V.sql("SELECT event_id, pos, pt <> 0 AS mask FROM padded", JETS, EV, PAD))
def t2(spark, d):
    n = V.nested(spark, d).select("event_id", C.mask_from_pt(C.pad_clip(F.col("jets.pt"), CAP, 0.0)).alias("mask"))
    return n.select("event_id", F.posexplode("mask").alias("pos", "mask"))


@register("t3_sin_cos_phi", V.sql("SELECT event_id, pos, ROUND(sin(phi), 7) AS s, ROUND(cos(phi), 7) AS c FROM jets", JETS))
def t3(spark, d):
    n = tensors.sin_cos_phi(V.nested(spark, d), "jets.phi").select("event_id", F.posexplode(F.arrays_zip("sin_phi", "cos_phi")).alias("pos", "v"))
    return n.select("event_id", "pos", r6("v.sin_phi", "s"), r6("v.cos_phi", "c"))


@register("t4_is_electron", "SELECT c_custkey, CASE WHEN (CASE c_custkey % 4 WHEN 0 THEN 11 WHEN 1 THEN -11 WHEN 2 THEN 13 ELSE -13 END) IN (11, -11) THEN 1 ELSE 0 END AS is_electron FROM customer")
def t4(spark, d):
    k = F.col("c_custkey") % 4
    pdg = F.when(k == 0, 11).when(k == 1, -11).when(k == 2, 13).otherwise(-13)
    return V.table(spark, d, "customer").select("c_custkey", tensors.is_electron(pdg).alias("is_electron"))


@register("t5_event_ht", V.sql("SELECT event_id, ROUND(ht, 7) AS ht FROM per", JETS, EV, PER))
def t5(spark, d):
    return tensors.event_ht(V.nested(spark, d)).select("event_id", r6("ht"))


@register("t6_event_features", V.sql("SELECT e.event_id, ROUND(coalesce(sum(CASE WHEN btag_M = 1 THEN pt END), 0), 7) AS bjets_ht, coalesce(max(pos) + 1, 0) AS njet FROM ev e LEFT JOIN jets j ON e.event_id = j.event_id GROUP BY e.event_id", JETS, EV))
def t6(spark, d):
    n = build.btag_collection(V.nested(spark, d)).withColumn("events", F.struct(C.total(F.col("bjets.pt")).alias("bjets_ht"), F.size("jets.pt").alias("njet")))
    n = n.select("event_id", "events.*")
    return n.select("event_id", r6("bjets_ht"), "njet")


@register("t7_object_features", V.sql("SELECT p.event_id, ROUND(sum(CAST(pt AS FLOAT)), 2) AS pt, CAST(sum(CASE WHEN pt <> 0 THEN 1 ELSE 0 END) AS INT) AS n FROM padded p GROUP BY p.event_id", JETS, EV, PAD))
def t7(spark, d):
    n = tensors.object_features(V.nested(spark, d), {"Jet": ["pt", "sin_phi", "MASK"], "Event": ["ht"]}, CAP)
    return n.select("event_id", F.round(C.total(F.col("inputs.Jet.pt").cast("array<double>")), 2).alias("pt"), C.count_true(F.col("inputs.Jet.MASK")).alias("n"))


TCOLS = ("b1", "b2", "t1q1", "t1q2", "t1b", "t2q1", "t2q2", "t2b")
TPATH = ("h.b1", "h.b2", "t1.q1", "t1.q2", "t1.b", "t2.q1", "t2.q2", "t2.b")


@register("t8_assign_targets", V.sql("SELECT event_id, " + ", ".join(f"CAST(CASE WHEN {c} >= {CAP} THEN -1 ELSE {c} END AS BIGINT) AS {c}" for c in TCOLS) + " FROM tgt", JETS, EV, TGT))
def t8(spark, d):
    n = tensors.assign_targets(V.nested(spark, d), CAP)
    return n.select("event_id", *[F.col(f"targets.{p}").alias(c) for p, c in zip(TPATH, TCOLS, strict=True)])


@register("t9_unlabelled_targets", V.sql("SELECT event_id, CAST(-1 AS BIGINT) AS b1, CAST(-1 AS BIGINT) AS t2b FROM ev", EV))
def t9(spark, d):
    return tensors.unlabelled_targets(V.events(spark, d)).select("event_id", F.col("targets.h.b1").alias("b1"), F.col("targets.t2.b").alias("t2b"))


@register("t10_cap_index", V.sql("SELECT event_id, CAST(CASE WHEN pos >= 3 THEN -1 ELSE pos END AS BIGINT) AS pos FROM jets", JETS))
def t10(spark, d):
    return V.jets(spark, d).select("event_id", C.cap_index(F.col("pos").cast("long"), 3).alias("pos"))


@register("t11_classification_columns", V.sql("SELECT event_id, CAST(signal AS BIGINT) AS signal, CAST(dctr AS BIGINT) AS dctr FROM ev", EV))
def t11(spark, d):
    return tensors.classification_columns(V.events(spark, d), ["signal", "dctr"]).select("event_id", "classifications.event.*")


@register("t12_cast_tensor_types", V.sql("SELECT event_id, ROUND(CAST(CAST(weight AS FLOAT) AS DOUBLE), 7) AS weight, CAST(signal AS BIGINT) AS signal FROM ev", EV))
def t12(spark, d):
    rows = _training(spark, d)
    return rows.select("event_id", r6(F.col("weights.weight").cast("double"), "weight"), F.col("classifications.event.signal").alias("signal"))


def _stacked(spark, d):
    n = tensors.object_features(V.nested(spark, d), {"Jet": ["pt", "eta", "MASK"], "Event": ["ht"]}, CAP)
    return tensors.stack_features(n, {"Jet": ["eta", "pt"]}, {"Event": ["ht"]})


@register("t13_stack_features", V.sql("SELECT event_id, pos, ROUND(CAST(CAST(eta AS FLOAT) AS DOUBLE), 4) AS first, ROUND(CAST(CAST(pt AS FLOAT) AS DOUBLE), 2) AS second FROM padded", JETS, EV, PAD))
def t13(spark, d):
    n = _stacked(spark, d).select("event_id", F.posexplode("Jet_data").alias("pos", "v"))
    return n.select("event_id", "pos", F.round(F.col("v")[0].cast("double"), 4).alias("first"), F.round(F.col("v")[1].cast("double"), 2).alias("second"))


@register("t14_log_normalize", V.sql("SELECT event_id, pos, CAST(floor(CAST(CAST(ln(1 + CAST(CAST(pt AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE) * 100 + 0.137::DOUBLE) AS BIGINT) AS pt FROM padded", JETS, EV, PAD))
def t14(spark, d):
    n = tensors.log_normalize(_stacked(spark, d), {"Jet": {"eta": "normalize", "pt": "log_normalize"}})
    return n.select("event_id", F.posexplode("Jet_data").alias("pos", "v")).select("event_id", "pos", F.floor(F.col("v")[1].cast("double") * 100 + 0.137).alias("pt"))


@register("t15_unstack_features", V.sql("SELECT event_id, pos, ROUND(CAST(CAST(pt AS FLOAT) AS DOUBLE), 2) AS pt FROM padded", JETS, EV, PAD))
def t15(spark, d):
    n = tensors.unstack_features(_stacked(spark, d), "Jet", ["eta", "pt"])
    return n.select("event_id", F.posexplode("Jet_pt").alias("pos", "v")).select("event_id", "pos", F.round(F.col("v").cast("double"), 2).alias("pt"))


@register("t16_node_scores", V.sql("SELECT event_id, ROUND(tthbb, 7) AS tthbb, ROUND(qcd, 7) AS qcd, ROUND(tthnonbb, 7) AS tthnonbb FROM wide", EV, SC))
def t16(spark, d):
    return V.wide(spark, d).select("event_id", r6("tthbb"), r6("qcd"), r6("tthnonbb"))


@register("t17_derived_scores", V.sql("SELECT event_id, ROUND(tthbb/(tthbb+ttbb+1e-6::DOUBLE), 7) AS a, ROUND(tthbb/(tthbb+ttbb+qcd+1e-6::DOUBLE), 7) AS b, ROUND(tthbb/(tthbb+ttbb+qcd+ttlf+ttcc+1e-6::DOUBLE), 7) AS c, ROUND(tthbb/(tthbb+ttbb), 7) AS plain FROM wide", EV, SC))
def t17(spark, d):
    w = tensors.derived_scores(V.wide(spark, d))
    return w.select("event_id", r6("tthbb_vs_ttbb", "a"), r6("tthbb_vs_qcd_ttbb", "b"), r6("tthbb_vs_qcd_ttbar", "c"), r6("tthbb_vs_ttbb_plain", "plain"))


@register("t18_argmax_class", V.sql("SELECT event_id, predicted FROM wide", EV, SC))
def t18(spark, d):
    return V.wide(spark, d).select("event_id", "predicted")


@register("t19_truth_prediction", V.sql("SELECT event_id, CAST(i AS INT) AS class, signal = i AS is_true, ROUND(s, 7) AS score FROM sc WHERE i > 0", EV, SC))
def t19(spark, d):
    return tensors.truth_prediction(V.scored(spark, d)).select("event_id", "class", "is_true", r6("score"))


@register("t20_score_sum", V.sql("SELECT event_id, ROUND(sum(s), 7) AS total FROM sc WHERE i > 0 GROUP BY event_id", EV, SC))
def t20(spark, d):
    return V.scored(spark, d).select("event_id", r6(C.total(F.slice("scores", 2, 9)), "total"))


# --- filters


@register("f1_min_jets", V.sql("SELECT event_id, njet FROM per WHERE njet >= 6", JETS, EV, PER))
def f1(spark, d):
    return select.min_jets(V.nested(spark, d), 6).select("event_id", F.size("jets.pt").alias("njet"))


@register("f2_fully_matched", V.sql("""SELECT event_id, CAST(count(*) AS INT) AS njet FROM jets GROUP BY event_id
  HAVING count(*) FILTER (prov IN (1,2,3,5,6)) >= 6 AND count(*) FILTER (prov = 1) = 2 AND count(*) FILTER (prov IN (5,2)) = 3 AND count(*) FILTER (prov IN (6,3)) = 3""", JETS))
def f2(spark, d):
    return select.fully_matched(V.nested(spark, d)).select("event_id", F.size("jets.pt").alias("njet"))


@register("f3_apply_mask", V.sql("SELECT event_id FROM per WHERE njet >= 4 AND nb >= 2", JETS, EV, PER))
def f3(spark, d):
    n = V.counted(spark, d).withColumn("mask_control", (F.col("njet") >= 4) & (F.col("nb") >= 2))
    return select.apply_mask(n, "control").select("event_id")


@register("f4_source_filter", V.sql("SELECT event_id, CASE WHEN sample = 'QCD' THEN 'background' ELSE 'signal' END AS \"group\" FROM ev WHERE sample IN ('TTH_Hto2B', 'QCD')", EV))
def f4(spark, d):
    return select.source_filter(_paths(spark, d), {"signal": "TTH_Hto2B", "background": "QCD"}).select("event_id", "group")


@register("f5_true_class_subset", V.sql("SELECT event_id, signal FROM ev WHERE signal IN (1, 5)", EV))
def f5(spark, d):
    return select.true_class_subset(V.events(spark, d), [1, 5]).select("event_id", "signal")


@register("f6_score_slices", V.sql("SELECT event_id, CAST(k AS INT) AS slice FROM wide, (SELECT unnest([0, 1, 2]) AS k, unnest([0.0, 0.1, 0.3]::DOUBLE[]) AS lo, unnest([0.1, 0.3, 1.0]::DOUBLE[]) AS hi) WHERE tthbb > lo AND tthbb < hi", EV, SC))
def f6(spark, d):
    return select.score_slices(V.wide(spark, d), [0.0, 0.1, 0.3, 1.0], "tthbb").select("event_id", "slice")


REGIONS = """regions AS (SELECT *, 'inclusive' AS region, 1 AS target FROM wide UNION ALL SELECT *, 'QCD veto', 1 FROM wide WHERE qcd < 0.1::DOUBLE
UNION ALL SELECT *, 'SR ttHbb', 1 FROM wide WHERE qcd < 0.1::DOUBLE AND ttlf < 0.2::DOUBLE AND tthbb > 0.2::DOUBLE UNION ALL SELECT *, 'CR ttlf', 3 FROM wide WHERE qcd < 0.1::DOUBLE AND ttlf > 0.15::DOUBLE AND tthbb < 0.6::DOUBLE)"""
CUTS = {"qcd_high": 0.1, "tthbb_high": 0.2, "ttlf_high": 0.15}


@register("f7_cut_regions", V.sql("SELECT event_id, region, target FROM regions", EV, SC, REGIONS))
def f7(spark, d):
    return select.cut_regions(V.wide(spark, d), CUTS).select("event_id", "region", "target")


@register("f8_region_grid", V.sql("""SELECT kind, a AS ttlf_cut, b AS tthbb_cut, count(*) AS n FROM wide, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS a), (SELECT unnest([0.1, 0.2, 0.4]::DOUBLE[]) AS b), (SELECT unnest(['SR', 'CR']) AS kind)
  WHERE qcd < 0.1::DOUBLE AND CASE kind WHEN 'SR' THEN ttlf < a AND tthbb > b ELSE ttlf > a AND tthbb < b END GROUP BY ALL""", EV, SC))
def f8(spark, d):
    return select.region_grid(V.wide(spark, d), [0.1, 0.2, 0.3], [0.1, 0.2, 0.4], 0.1).groupBy("kind", "ttlf_cut", "tthbb_cut").agg(F.count("*").alias("n"))


@register("f9_epoch_cap", V.sql("SELECT version, step, epoch FROM marks WHERE epoch <= 3", MET))
def f9(spark, d):
    return select.epoch_cap(V.epoch_marks(spark, d), 3)


BAD = "bad AS (SELECT event_id, pos, CASE event_id % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE btag END AS value FROM jets)"


def bad_values(spark, d):
    k = F.col("event_id") % 11
    inf = float("inf")
    return V.jets(spark, d).select("event_id", "pos", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(inf)).when(k == 2, F.lit(-inf)).otherwise(F.col("btag")).alias("value"))


@register("f10_is_nonfinite", V.sql("SELECT event_id, pos FROM bad WHERE isnan(value) OR isinf(value)", JETS, BAD))
def f10(spark, d):
    return bad_values(spark, d).where(C.is_nonfinite(F.col("value"))).select("event_id", "pos")


@register("f11_filter_tags", V.sql("SELECT event_id, tag FROM met WHERE contains(tag, 'click') OR contains(tag, 'view')", MET))
def f11(spark, d):
    return select.filter_tags(V.metrics(spark, d), ["click", "view"]).select("event_id", "tag")


@register("fill_nonfinite", V.sql("SELECT event_id, ROUND(sum(CASE WHEN isnan(value) OR isinf(value) THEN 0 ELSE value END), 7) AS total, CAST(sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS INT) AS repaired FROM bad GROUP BY event_id", JETS, BAD))
def fill(spark, d):
    n = bad_values(spark, d).groupBy("event_id").agg(F.collect_list("value").alias("v"))
    return n.select("event_id", r6(C.total(F.array_sort(C.fill_nonfinite(F.col("v")))), "total"), F.size(F.filter("v", C.is_nonfinite)).alias("repaired"))


@register("fill_nonfinite_dry_run", V.sql("SELECT CASE WHEN pos = 0 THEN 'leading' ELSE 'others' END AS dataset, count(*) AS n_values, count(*) FILTER (isnan(value) OR isinf(value)) AS n_filled FROM bad GROUP BY 1", JETS, BAD))
def fill_dry_run(spark, d):
    return stats.fill_counts(bad_values(spark, d).withColumn("dataset", F.when(F.col("pos") == 0, "leading").otherwise("others")))


@register("fn_strings", r"""SELECT DISTINCT event_type AS tag, lower(trim(regexp_replace(event_type || ' (A/B)', '[^0-9A-Za-z]+', '_', 'g'), '_')) AS slug, replace(event_type || '/x', '/', '__') AS file,
  event_type || '/x' AS back, 'version_' || CAST(event_id % 3 AS VARCHAR) AS run, CAST(event_id % 3 AS BIGINT) AS number FROM events""")
def strings(spark, d):
    tag = F.concat("event_type", F.lit("/x"))
    path = F.concat(F.lit("/logs/version_"), (F.col("event_id") % 3).cast("string"))
    file = C.file_of_tag(tag)
    return V.table(spark, d, "events").select(F.col("event_type").alias("tag"), C.slug(F.concat("event_type", F.lit(" (A/B)"))).alias("slug"), file.alias("file"), C.tag_of_file(F.concat(F.lit("/m/"), file, F.lit(".csv"))).alias("back"), C.run_label(path).alias("run"), C.run_number(path).alias("number")).distinct()


# --- order, first rows, sets


@register("w1_train_test_split", V.sql("SELECT event_id, split FROM spl", EV, SPLIT))
def w1(spark, d):
    return order.train_test_split(V.events(spark, d), "sample").select("event_id", "split")


CAPPED = V.sql("""SELECT event_id FROM (SELECT p.event_id, p.sample, row_number() OVER (PARTITION BY p.sample ORDER BY p.event_id) AS r FROM per p WHERE njet >= 5) x
  JOIN (SELECT sample, count(*) * CASE sample WHEN 'QCD' THEN 50000 WHEN 'TTH_Hto2B' THEN 200000 ELSE 1000000 END // 1000000 AS cap FROM ev GROUP BY sample) c ON x.sample = c.sample WHERE r <= cap""", JETS, EV, PER)


@register("w2_cap_fraction", CAPPED)
def w2(spark, d):
    n = V.jet_counts(spark, d).select("event_id", "sample", "njet")
    return order.cap_fraction(n, n.where("njet >= 5"), {"QCD": 0.05, "TTH_Hto2B": 0.2}, "sample").select("event_id")


@register("w2_capped_sources", CAPPED)
def w2_files(spark, d):
    """The same over files, some three of each sample or more: of a capped sample only those are read that fill its budget. Jets are counted once, and all samples are sorted and written at once."""
    n, path = tables.cut(V.jet_counts(spark, d).select("event_id", "sample", "njet")), tables.workspace(spark)
    parts = max(3 * len(V.SAMPLES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n.repartitionByRange(parts, "sample", "event_id").sortWithinPartitions("sample", "event_id").write.partitionBy("sample").parquet(path)
    # A sample without events has no folder.
    sources = {r["sample"]: f"{path}/sample={r['sample']}" for r in spark.read.schema(n.schema).parquet(path).select("sample").distinct().collect()}
    return io.capped_sources(spark, sources, {"QCD": 0.05, "TTH_Hto2B": 0.2}, F.col("njet") >= 5, "sample").select("event_id") if sources else n.select("event_id")


@register("w3_entry_stop", V.sql("SELECT event_id FROM ev ORDER BY sample, event_id LIMIT 700", EV))
def w3(spark, d):
    return order.entry_stop(V.events(spark, d), 700, "sample").select("event_id")


@register("w3_first_rows", V.sql("SELECT event_id, row_number() OVER (PARTITION BY sample ORDER BY event_id) - 1 AS row_index FROM ev QUALIFY row_number() OVER (ORDER BY sample, event_id) <= 700", EV))
def w3_files(spark, d):
    """The budget over files, a sample in each: those beyond it are not opened."""
    path = tables.workspace(spark)
    V.events(spark, d).repartition("sample").sortWithinPartitions("sample", "event_id").write.partitionBy("sample").parquet(path)
    return io.first_rows(spark, path, 700).select("event_id", "row_index")


@register("w4_stitch_versions", V.sql("""SELECT version, step, epoch + coalesce(sh, 0) AS global_epoch FROM marks JOIN (SELECT version AS v, CAST(sum(n) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS sh
  FROM (SELECT version, max(epoch) + 1 AS n FROM marks GROUP BY version)) ON version = v""", MET))
def w4(spark, d):
    return order.stitch_versions(V.epoch_marks(spark, d)).select("version", "step", "global_epoch")


@register("w5_shuffle", V.sql("SELECT event_id, row_number() OVER (ORDER BY md5('7-' || CAST(event_id AS VARCHAR)), event_id) AS place FROM ev", EV))
def w5(spark, d):
    path = tables.workspace(spark)
    order.shuffle(V.events(spark, d).select("event_id"), 7).write.parquet(path)
    return _placed(spark.read.parquet(path))


@register("w6_contiguous_slices", V.sql("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) * 10 - 1) // (SELECT count(*) FROM ev) AS INT) AS slice FROM ev", EV))
def w6(spark, d):
    return order.contiguous_slices(V.events(spark, d), 10).select("event_id", "slice")


@register("w7_local_index", V.sql("SELECT event_id, pos, prov FROM jets", JETS))
def w7(spark, d):
    return order.local_index(V.nested(spark, d), "jets.prov", value="prov")


@register("k1_first_n", V.sql("SELECT event_id, sample FROM ev ORDER BY event_id LIMIT 100", EV))
def k1(spark, d):
    return order.first_n(V.events(spark, d), 100).select("event_id", "sample")


@register("k1_first_n_audit", V.sql("SELECT 'orders' AS source, CAST(100 AS BIGINT) AS requested, least(100, count(*)) AS kept, count(*) AS total FROM ev", EV))
def k1_audit(spark, d):
    return order.first_n_audit(V.events(spark, d), 100, "orders")


@register("k2_stable_metric_order", V.sql("SELECT event_id, tag, step, row_number() OVER (ORDER BY tag, step, wall_time, event_id) AS place FROM met", MET))
def k2(spark, d):
    path = tables.workspace(spark)
    order.stable_metric_order(V.metrics(spark, d)).select("event_id", "tag", "step").write.parquet(path)
    return _placed(spark.read.parquet(path))


NEWEST = "files AS (SELECT *, 'f' || CAST(event_id % 4 AS VARCHAR) AS file, (event_id % 4) * 7 % 5 AS modified FROM met)"


@register("k3_latest_file_rows", V.sql("SELECT f.event_id, f.file FROM files f JOIN (SELECT version, arg_max(file, modified) AS file FROM files GROUP BY version) n ON f.version = n.version AND f.file = n.file", MET, NEWEST))
def k3(spark, d):
    e = F.col("event_id") % 4
    m = V.metrics(spark, d).withColumns({"file": F.concat(F.lit("f"), e.cast("string")), "modified": e * 7 % 5})
    return order.latest_file_rows(m, ["version"]).select("event_id", "file")


@register("k5_leading_k", V.sql("SELECT event_id, pos, ROUND(pt, 7) AS pt FROM jets WHERE pos < 3", JETS))
def k5(spark, d):
    return order.leading_k(V.nested(spark, d), 3).select("event_id", F.posexplode("jets.pt").alias("pos", "pt")).select("event_id", "pos", r6("pt"))


@register("k6_sort_jets", V.sql("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY -btag, pos) - 1 AS INT) AS place, ROUND(btag, 7) AS btag, prov FROM jets", JETS))
def k6(spark, d):
    n = order.sort_jets(V.nested(spark, d), "btag")
    return n.select("event_id", F.posexplode(F.arrays_zip("jets.btag", "jets.prov")).alias("place", "j")).select("event_id", "place", r6("j.btag", "btag"), "j.prov")


@register("u1_union_events", V.sql("SELECT event_id, sample, 2 * count(*) AS n FROM ev GROUP BY event_id, sample", EV))
def u1(spark, d):
    e = V.events(spark, d)
    return order.union_events(e, e).groupBy("event_id", "sample").agg(F.count("*").alias("n"))


@register("u2_full_from_splits", V.sql("SELECT spl.event_id, split, nb >= 2 AS mask FROM spl JOIN per ON spl.event_id = per.event_id", JETS, EV, PER, SPLIT))
def u2(spark, d):
    s = order.train_test_split(V.counted(spark, d).select("event_id", "sample", "nb"), "sample")
    full = order.full_from_splits(s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"))
    return full.select("event_id", "split", (F.col("nb") >= 2).alias("mask"))


@register("u2_masked_counts", V.sql("SELECT 'all' AS mask, split, count(*) AS rows FROM spl GROUP BY split UNION ALL SELECT 'btag', split, count(*) FROM spl JOIN per ON spl.event_id = per.event_id WHERE nb >= 2 GROUP BY split", JETS, EV, PER, SPLIT))
def u2_masked(spark, d):
    s = order.train_test_split(V.counted(spark, d).select("event_id", "sample", "nb"), "sample").withColumns({"mask_all": F.lit(True), "mask_btag": F.col("nb") >= 2})
    return io.write_masked(s, tables.workspace(spark), {"all": "mask_all", "btag": "mask_btag"})


@register("u4_merge_eras", V.sql("SELECT year AS era, count(*) AS n FROM ev GROUP BY year", EV))
def u4(spark, d):
    e = V.events(spark, d)
    return order.merge_eras({y: e.where(F.col("year") == y) for y in ("2022_preEE", "2023_preBPix", "2024")}).groupBy("era").agg(F.count("*").alias("n"))


@register("u4_era_rows", V.sql("SELECT event_id, year AS era, sample, ROUND(weight, 7) AS weight FROM ev", EV))
def u4_rows(spark, d):
    e = V.events(spark, d)
    return order.merge_eras({y: e.where(F.col("year") == y).drop("year") for y in ("2022_preEE", "2023_preBPix", "2024")}).select("event_id", "era", "sample", r6("weight"))
